"""Packing along a space-filling curve.

Each document becomes a signed, hashed vector of its tokens, which a fixed random
projection takes to three dimensions.  Documents are sorted by their Hilbert key, so that
neighbours on the curve have similar tokens, and laid one behind the other; sequences are
equal stretches of that line.  Only the very last one can have padding.

Texts are read and tokenised once; their ids go to a table in the shared folder, and the
small rows (key, length) alone are range-sorted.  A document's place is the length of
what lies before it in its range, plus the totals of earlier ranges, one number for each
range.  Equal keys are sorted by row, so copies spread over ranges.  The ids meet their
places by row number and are cut where they are: no group of documents is ever collected.

Null and empty texts are documents of the end id alone.  A text of any length is cut
freely.  Every row is packed, whatever its id, repeated rows too; an empty table gives no
piece.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bounds, chunks, release, released, written
from topicloom.llm.token_count import Merges, byte_letters
from topicloom.session import ship_package

LENGTH = 2048
WIDTH, DIMENSIONS, BITS = 64, 3, 16
#: Entries of the memo, and bytes of their words.
WORD_MEMO, MEMO_BYTES = 100_000, 8 * 2**20
#: Words whose encodings the tokenizer returns at once, each an object of some size.
LEARN = 2_000
#: Text whose words and ids a worker holds in arrays at once.
STEP_BYTES = 2**20



def hilbert_keys(places: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points, after Skilling (2004)."""
    axes = [column.astype(np.int64) for column in places.T]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i, axis in enumerate(axes):
            flip = (axis & bit) != 0
            swap = np.where(flip, 0, (axes[0] ^ axis) & low)
            axes[i] = axis ^ swap
            axes[0] = axes[0] ^ np.where(flip, low, swap) if i else axes[0] ^ np.where(flip, low, 0)
        bit >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn, bit = np.zeros(len(places), np.int64), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(axes[-1] & bit, bit - 1, 0)
        bit >>= 1
    key = np.zeros(len(places), np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> b & 1)
    return key


@functools.cache
def _projection() -> np.ndarray:
    """WIDTH x DIMENSIONS, orthonormal columns, always the same."""
    q, _ = np.linalg.qr(np.random.default_rng(20240229).standard_normal((WIDTH, DIMENSIONS)))
    return q


def curve_keys(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents, given their ids one behind the other."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    cell = (mixed >> np.uint64(40)).astype(np.int64) % WIDTH
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    vectors = np.bincount(doc * WIDTH + cell, weights=sign, minlength=(len(edges) - 1) * WIDTH)
    vectors = vectors.reshape(-1, WIDTH)
    norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    wide = (vectors / norms) @ _projection() * 4
    unit = 0.5 + 0.5 * wide / np.sqrt(1 + wide * wide)
    return hilbert_keys((unit * (2**BITS - 1)).astype(np.int64), BITS)


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str):
    # Spark's tasks share out the cores; threads of each worker would only contend for them.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


@functools.lru_cache(maxsize=2)
def split_letters(definition: str) -> str:
    """A character class of the letters that the tokenizer parts from a stop or comma behind.

    Letters that its normaliser takes apart end in a mark, which goes with the stop; asked of
    the tokenizer itself, letter by letter.
    """
    tokenizer = _tokenizer(definition)
    normal, parts = tokenizer.normalizer, tokenizer.pre_tokenizer

    def pieces(text):
        text = normal.normalize_str(text) if normal else text
        return [p for p, _ in parts.pre_tokenize_str(text)] if parts else [text]

    def parted(letters):
        """Those of the letters, asked all at once and by halves where one is not parted."""
        alone = pieces(" ".join(letters))
        for stop in ".,":
            found, own = pieces(" ".join(x + stop for x in letters)), pieces(stop)
            if [p for p in found if p not in own] != alone or len(found) != len(alone) + len(letters):
                half = len(letters) // 2
                return parted(letters[:half]) + parted(letters[half:]) if half else []
        return letters

    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    ranges: list[list[int]] = []
    for a in range(0, len(every), 1024):
        for code in map(ord, parted(every[a : a + 1024])):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]" if ranges else ""


class WordMerges:
    """Ids of plain words (Latin letters in lower case) by merging all of them at once, for
    byte-level BPE with word ends; None for other tokenizers."""

    plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch

    @classmethod
    @functools.lru_cache(maxsize=2)
    def of(cls, definition: str):
        whole = json.loads(definition)
        model, kinds = whole["model"], json.dumps([whole.get("normalizer"), whole.get("pre_tokenizer")])
        end = model.get("end_of_word_suffix")
        if not end or "Lowercase" not in kinds or "ByteLevel" not in kinds or "NFC" not in kinds:
            return None
        self, vocabulary = cls(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = sorted((b, c) for c, b in byte_letters().items())
        self.merges = Merges(
            [vocabulary[c] for _, c in letters],
            [(vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)],
            [],
        )
        self.last = np.array([vocabulary[c + end] for _, c in letters], np.int64)
        return self

    def encode(self, words: list[bytes]) -> list[bytes]:
        edges = bounds([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.merges.symbols[raw]
        symbols[edges[1:] - 1] = self.last[raw[edges[1:] - 1]]
        symbols, owner = self.merges.merge(symbols, np.repeat(np.arange(len(words)), np.diff(edges)))
        cuts = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        ids = symbols.astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Ids of texts by a ``tokenizers`` definition that drops white space and case.

    Such a tokenizer works on each part between ASCII white space by itself, and keeps
    most letters (``letters``, of ``split_letters``) apart from full stops and commas behind
    them.  Ids of frequent parts are remembered, in lower case.
    """

    def __init__(self, definition: str, end_id: int, letters: str | None = None):
        self.letters = split_letters(definition) if letters is None else letters
        self.tokenizer, self.words = _tokenizer(definition), WordMerges.of(definition)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0
        self.end = np.array([end_id], "<u4").tobytes()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower() for t in added]

    def _learn(self, words: set[bytes]) -> None:
        if self.words:
            plain = list(filter(self.words.plain, words))
            self.known.update(zip(plain, self.words.encode(plain)))
            words = words.difference(plain)
        rest = list(words)
        for a in range(0, len(rest), LEARN):
            some = rest[a : a + LEARN]
            encoded = self.tokenizer.encode_batch_fast(
                [w.decode() for w in some], add_special_tokens=False
            )
            self.known.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in encoded)))

    def _recall(self, words: set[bytes]) -> None:
        self.known.update((w, self.before[w]) for w in words.intersection(self.before))

    def _each(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) > WORD_MEMO or self.held > MEMO_BYTES:
            self.known, self.before, self.held = {}, self.known, 0
        unknown = set(words).difference(self.known)
        self.held += sum(map(len, unknown))
        self._recall(unknown)
        if new := unknown.difference(self.before):
            self._learn(new)
        return list(map(self.known.__getitem__, words))

    def _prepared(self, texts: pa.Array) -> pa.Array:
        """In lower case, unless that could write a special token that was none, and with a
        space between a letter and a stop or comma, where tokens never go on."""
        lowered = pc.ascii_lower(texts)
        for special in self.special:
            lowered = pc.if_else(pc.match_substring(lowered, special), texts, lowered)
        if not self.letters:
            return lowered
        return pc.replace_substring_regex(lowered, f"({self.letters})([.,])", r"\1 \2")

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, each text's with the end id, and where texts end.

        Words are numbered by Arrow, so that only distinct ones are looked up.
        """
        array = self._prepared(pa.array(texts, pa.binary()).cast(pa.string()))
        lists = pc.ascii_split_whitespace(array)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        filled = [w for w in distinct if w]
        found = iter(self._each(filled))
        each = [next(found) if w else b"" for w in distinct] + [self.end]
        ends = bounds(pc.list_value_length(lists).to_numpy())[1:]
        number = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(distinct))
        ends = ends + np.arange(1, len(ends) + 1)
        size = np.fromiter((len(e) // 4 for e in each), np.int64, len(each))
        start, table = bounds(size), np.frombuffer(b"".join(each), "<u4")
        many = size[number]
        places = bounds(many)
        ids = table[np.repeat(start[number] - places[:-1], many) + np.arange(places[-1])]
        return ids, np.concatenate([[0], places[ends]])


@functools.lru_cache(maxsize=2)
def _told(definition: str) -> tuple[int, str]:
    """The largest id and the ``split_letters``; the driver keeps these, not the tokenizer, which
    takes tens of megabytes."""
    last_id = max(_tokenizer(definition).get_vocab(with_added_tokens=True).values(), default=0)
    letters = split_letters(definition)
    _tokenizer.cache_clear()
    release()
    return last_id, letters


def tokenised(docs: DataFrame, id_col: str, text_col: str, definition: str, end_id: int) -> DataFrame:
    """(uid, id, key, n, ids): ids as little-endian numbers of 16 bits, or 32 if need be."""
    ship_package(docs.sparkSession)
    last_id, letters = _told(definition)
    narrow = max(last_id, end_id) < 2**16
    send = docs.sparkSession.sparkContext.broadcast((definition, letters))

    @released
    def encode(batches):
        known, letters = send.value
        encoder = Encoder(known, end_id, letters)
        for batch in batches:
            for part, texts in chunks(batch, "text", most=STEP_BYTES):
                ids, edges = encoder.encode(texts)
                width = 2 if narrow else 4
                raw, cuts = ids.astype(f"<u{width}").tobytes(), (width * edges).tolist()
                each = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(curve_keys(ids, edges)),
                        pa.array(np.diff(edges)), pa.array(each, pa.binary()),
                    ],
                    ["uid", "id", "key", "n", "ids"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"uid long, id {kind}, key long, n long, ids binary")


def _running(batches):
    """The sum of ``n`` before each row of a partition, and the partition's number."""
    done, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        ends = done + np.cumsum(batch.column("n").to_numpy())
        done = int(ends[-1]) if len(ends) else done
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array(np.full(len(ends), part)), pa.array(ends)],
            ["uid", "part", "end"],
        )


def places(rows: DataFrame) -> DataFrame:
    """(uid, stop): where each row of (uid, key, n) ends on the curve."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.select("uid", "key", "n").repartitionByRange(ranges, "key", "uid")
    sorted_rows = sorted_rows.sortWithinPartitions("key", "uid")
    running = written(sorted_rows.mapInArrow(_running, "uid long, part long, end long"), "places")
    totals = running.groupBy("part").agg(F.max("end")).collect()  # one row for each range
    starts, before = [], 0
    for part, total in sorted((r[0], r[1]) for r in totals):
        starts.append((part, before))
        before += total
    shift = spark.createDataFrame(starts, "part long, before long")
    return running.join(F.broadcast(shift), "part").select(
        "uid", (F.col("before") + F.col("end")).alias("stop")
    )


def _cut(length: int):
    @released
    def cut(batches):
        for batch in batches:
            n, stop = (batch.column(c).to_numpy() for c in ("n", "stop"))
            first, last = (stop - n) // length, (stop - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = np.repeat(first - bounds(count)[:-1], count) + np.arange(len(row))
            begin = np.maximum(sequence * length, (stop - n)[row])
            end = np.minimum((sequence + 1) * length, stop[row])
            start = begin - (stop - n)[row]
            sizes, ids = end - begin, batch.column("ids")
            pieces = []
            for r, a, size in zip(row.tolist(), start.tolist(), sizes.tolist()):
                raw = ids[r].as_buffer() if a == 0 else raw
                width = raw.size // int(n[r])
                piece = np.frombuffer(raw, f"<u{width}", size, a * width)
                pieces.append(piece.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(row)), pa.array(start), pa.array(sizes),
                    pa.array(pieces, pa.binary()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                    pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * length),
                ],
                ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return cut


def pack(
    docs: DataFrame, definition: str, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", length: int = LENGTH,
) -> DataFrame:
    """Per piece: id, start, length, ids (unsigned 32-bit, little-endian), ids_crc32,
    doc_tokens, sequence_id and offset.

    ``definition`` is the JSON text of a tokenizer that drops white space.
    """
    table = written(tokenised(docs, id_col, text_col, definition, end_id), "tokens")
    placed = table.drop("key").join(places(table), "uid")
    kind = table.schema["id"].dataType.simpleString()
    pieces = placed.mapInArrow(
        _cut(length),
        f"id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n, ids): whole sequences, at most ``length`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), parts.alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda done, ids: F.concat(done, ids))
    return grouped.select("sequence_id", "n", joined.alias("ids"))
