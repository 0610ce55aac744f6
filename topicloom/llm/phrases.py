"""Substring dedup with sharded Aho-Corasick automata of recurring passages.

A window is ``window`` consecutive words of a document; a word is removed if a window
covers it whose word sequence starts anywhere else too.  Documents are dealt to blocks of
about ``BLOCK_BYTES`` of text, in one shuffle that all passes share:

1. Each block reports the anchors of its windows: of the phrases of ``PHRASE`` words in a
   window the one with the smallest hash, so equal windows have equal anchors.  Only
   anchors that occur twice are candidates; they are a fraction of all windows.
2. Each block reports 128-bit hashes of the windows with such anchors; those that occur
   twice are confirmed to recur.
3. Runs of confirmed windows are a block's passages.  They are compiled to automata of at
   most ``SHARD_CHARS`` characters, and all documents of the block are streamed through
   them; what an occurrence covers is removed.

Reports are packed numpy arrays, combined within a block before they are shuffled: a
phrase that a third of all documents have is one entry a block.  Passages shared by
blocks are compiled in each, so no document travels to the patterns of others.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Null and empty texts have none;
documents shorter than a window lose nothing.  Repeated rows are occurrences of their own
and get a result each, whatever their ids.  Extra columns are ignored by
``find_repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bounds, mixed, release, window_hashes, word_hashes
from topicloom.session import ship_package

WINDOW, PHRASE = 35, 12
#: A task holds some 80 bytes for each byte of its block, words and window hashes together.
BLOCK_BYTES = 2 * 2**20
#: About 80 bytes of automaton for each character.
SHARD_CHARS = 400_000


class Block:
    """The documents of a block in order of ``uid``, their words one behind the other."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.sort_by("uid").combine_chunks()
        texts = self.table.column("text").cast(pa.binary()).to_pylist()
        self.words = [(t or b"").split() for t in texts]
        self.edges = bounds([len(w) for w in self.words])
        hashes = word_hashes([w for own in self.words for w in own])
        self.hashes, self.window = mixed(hashes), window
        size = max(0, len(hashes) - window + 1)
        inside = np.zeros(len(hashes) + 1, np.int64)
        long = np.diff(self.edges) >= window
        np.add.at(inside, self.edges[:-1][long], 1)
        np.add.at(inside, self.edges[1:][long] - window + 1, -1)
        #: First words of the windows that lie within one document.
        self.starts = np.flatnonzero(np.cumsum(inside)[:size])

    def anchors(self, phrase: int) -> np.ndarray:
        """(value, place) of the anchor of each window; of equal values the first."""
        values = mixed(window_hashes(self.hashes, phrase, 1))
        best, width, goal = np.arange(len(values)), 1, self.window - phrase + 1
        while width < goal:
            step = min(width, goal - width)
            left, right = best[: len(best) - step], best[step:]
            best, width = np.where(values[left] <= values[right], left, right), width + step
        place = best[self.starts]
        return values[place], place

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of the hashes of the windows at ``starts``."""
        halves = (window_hashes(self.hashes, self.window, s) for s in (2, 3))
        high, low = (mixed(h[starts]) if len(starts) else np.zeros(0, np.uint64) for h in halves)
        return high, low


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows together, and the starts of their runs in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[order][1:] != column[order][:-1]
    return order, np.flatnonzero(new)


_REPORT = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64()), ("high", pa.binary()), ("low", pa.binary()),
     ("twice", pa.binary())]
)
_REPORT_SQL = "bucket long, block long, high binary, low binary, twice binary"
_FOUND = pa.schema([("block", pa.int64()), ("high", pa.binary()), ("low", pa.binary())])
_FOUND_SQL = "block long, high binary, low binary"


def _report(block: int, high, low, buckets: int) -> pa.Table:
    """The distinct keys of a block, each marked if it occurs twice, dealt to buckets."""
    order, first = _runs(high, low)
    twice = np.diff(np.append(first, len(order))) > 1
    high, low = high[order[first]], low[order[first]]
    bucket = (high % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[by], return_index=True)
    rows = [
        [int(name), block, high[own].tobytes(), low[own].tobytes(), twice[own].tobytes()]
        for name, own in zip(names.tolist(), np.split(by, at[1:]))
    ]
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, _REPORT.types)],
        schema=_REPORT,
    )


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _confirm(table: pa.Table) -> pa.Table:
    """Of the keys of a bucket, those that occur in two blocks, or twice in one, by block."""
    high, low = _joined(table.column("high"), np.uint64), _joined(table.column("low"), np.uint64)
    twice = _joined(table.column("twice"), bool)
    order, first = _runs(high, low)
    size = np.diff(np.append(first, len(order)))
    recurs = np.zeros(len(high), bool)
    if len(order):
        recurs[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], first), size)
    edges = bounds([len(h.as_py()) // 8 for h in table.column("high")]).tolist()
    rows = [
        (block, high[a:b][recurs[a:b]].tobytes(), low[a:b][recurs[a:b]].tobytes())
        for block, a, b in zip(table.column("block").to_pylist(), edges, edges[1:])
        if recurs[a:b].any()
    ]
    columns = zip(*rows) if rows else [()] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)


def _number(table: pa.Table) -> int:
    return table.column("block")[0].as_py() if table.num_rows else 0


def _anchor_report(window: int, phrase: int, buckets: int):
    def report(table: pa.Table) -> pa.Table:
        value, place = Block(table, window).anchors(phrase)
        new = np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
        value = value[new]
        release()
        return _report(_number(table), value, np.zeros(len(value), np.uint64), buckets)

    return report


def _window_report(window: int, phrase: int, buckets: int):
    def report(table: pa.Table, candidates: pa.Table) -> pa.Table:
        if not table.num_rows or not candidates.num_rows:
            return _REPORT.empty_table()
        block = Block(table, window)
        known = np.sort(_joined(candidates.column("high"), np.uint64))
        value, _ = block.anchors(phrase)
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        release()
        return _report(_number(table), *block.keys(block.starts[known[at] == value]), buckets)

    return report


def _recurring(block: Block, confirmed: pa.Table) -> np.ndarray:
    """Starts of the confirmed windows."""
    if not confirmed.num_rows:
        return block.starts[:0]
    high, low = (_joined(confirmed.column(c), np.uint64) for c in ("high", "low"))
    order = np.argsort(high, kind="stable")
    high, low = high[order], low[order]
    own_high, own_low = block.keys(block.starts)
    at = np.searchsorted(high, own_high)
    found = np.zeros(len(at), bool)
    while True:  # equal first halves are next to each other
        open_at = np.flatnonzero(~found & (at < len(high)))
        open_at = open_at[high[at[open_at]] == own_high[open_at]]
        if not len(open_at):
            return block.starts[found]
        found[open_at] = low[at[open_at]] == own_low[open_at]
        at[open_at] += 1


def _automata(passages: set[str]):
    """Automata of all passages, each of bounded size; the value is the length."""
    automaton, size = ahocorasick.Automaton(), 0
    for passage in sorted(passages):
        automaton.add_word(passage, len(passage))
        size += len(passage)
        if size >= SHARD_CHARS:
            automaton.make_automaton()
            yield automaton
            automaton, size = ahocorasick.Automaton(), 0
    if size:
        automaton.make_automaton()
        yield automaton


def _covered(block: Block, starts: np.ndarray) -> np.ndarray:
    """Marks the words that an occurrence of a passage covers."""
    covered = np.zeros(int(block.edges[-1]), bool)
    if not len(starts):
        return covered
    lines = [" " + b" ".join(w).decode("utf-8", "surrogateescape") + " " for w in block.words]
    sizes = np.fromiter((len(w.decode("utf-8", "surrogateescape")) for own in block.words for w in own),
                        np.int64, int(block.edges[-1]))
    begins = bounds(sizes + 1)  # place of each word in all lines without their first spaces
    doc = np.searchsorted(block.edges, starts, side="right") - 1
    breaks = np.flatnonzero((np.diff(starts) != 1) | (np.diff(doc) != 0)) + 1
    passages = set()
    for a, b, d in zip(
        starts[np.append(0, breaks)].tolist(),
        (starts[np.append(breaks, len(starts)) - 1] + block.window).tolist(),
        doc[np.append(0, breaks)].tolist(),
    ):
        base = begins[block.edges[d]]
        passages.add(lines[d][begins[a] - base : begins[b] - base + 1])
    for automaton in _automata(passages):
        for d, line in enumerate(lines):
            hits = np.array(list(automaton.iter(line)), np.int64).reshape(-1, 2)
            if len(hits):
                base, first = begins[block.edges[d]], block.edges[d]
                # A hit ends with the space behind its last word and starts with one.
                last = np.searchsorted(begins, base + hits[:, 0], side="left")
                start = np.searchsorted(begins, base + hits[:, 0] - hits[:, 1] + 1, side="left")
                change = np.zeros(block.edges[d + 1] - first + 1, np.int64)
                np.add.at(change, start - first, 1)
                np.add.at(change, last - first, -1)
                covered[first : block.edges[d + 1]] |= np.cumsum(change[:-1]) > 0
    return covered


def _remove(window: int):
    def remove(table: pa.Table, confirmed: pa.Table) -> pa.Table:
        block = Block(table, window)
        kind = table.schema.field("row").type
        row = pa.struct([kind.field(i).with_nullable(True) for i in range(kind.num_fields)])
        covered = _covered(block, _recurring(block, confirmed))
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[block.edges])
        kept = []
        for words, a, n in zip(block.words, block.edges.tolist(), removed.tolist()):
            left = words if not n else [w for w, c in zip(words, covered[a : a + len(words)]) if not c]
            kept.append(b" ".join(left))
        release()
        return pa.Table.from_arrays(
            [
                block.table.column("row").cast(row), block.table.column("text"), pa.array(np.diff(block.edges)),
                pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["row", "text", "n_words", "n_removed", "kept"],
        )

    return remove


def _repeats(docs: DataFrame, row, text_col: str, window: int, phrase: int) -> DataFrame:
    """row, text, n_words, n_removed, kept for each row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    buckets = max(1, blocks // 8)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), text.alias("text"), row.alias("row"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    kind = rows.schema["row"].dataType.simpleString()

    def confirmed(reports: DataFrame) -> DataFrame:
        return reports.groupBy("bucket").applyInArrow(_confirm, _FOUND_SQL).groupBy("block")

    of_block = rows.groupBy("block")
    anchors = confirmed(of_block.applyInArrow(_anchor_report(window, phrase, buckets), _REPORT_SQL))
    windows = of_block.cogroup(anchors).applyInArrow(
        _window_report(window, phrase, buckets), _REPORT_SQL
    )
    return of_block.cogroup(confirmed(windows)).applyInArrow(
        _remove(window), f"row {kind}, text string, n_words long, n_removed long, kept string"
    )


def find_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    phrase: int = PHRASE,
) -> DataFrame:
    """Per document: id, n_words, n_removed and ``kept``, the words that stay, joined by spaces."""
    found = _repeats(docs, F.struct(F.col(id_col).alias("id")), text_col, window, phrase)
    return found.select(F.col("row.id").alias(id_col), "n_words", "n_removed", "kept")


def without_repeats(
    docs: DataFrame, text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE
) -> DataFrame:
    """All rows and columns of ``docs``; a text that loses words is what stays of it."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("end"))
    found = _repeats(docs, row, text_col, window, phrase)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.select(
        *[
            text.alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c)
            for c in docs.columns
        ]
    )
