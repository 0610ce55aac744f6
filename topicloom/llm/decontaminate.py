"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items become one automaton over word numbers.  Training documents are
streamed through it; the state gives at each word the longest suffix that is part of an
item.  Words in a match of at least ``window`` words (or of a whole shorter item) are hit.

Items travel in shards of at most ``SHARD_WORDS`` words, each broadcast on its own, so
what a task holds does not depend on the benchmark; the usual benchmark is one shard.
Documents are never shuffled for one shard, and only short lists are for several.

Nulls and texts without words have no words: as documents they are not contaminated, as
items they have no window.  Rows are judged one by one, so repeated rows and repeated or
null ids get a result each.  Equal items are all reported.  With an empty benchmark
nothing is hit.  Extra columns are ignored by ``find_contamination`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import bounds, chunks, released, with_uid
from topicloom.session import ship_package

WINDOW = 13
#: A document is contaminated if one in so many of its words is hit, or more.
ONE_IN = 20
#: About 100 bytes of automaton for each word.
SHARD_WORDS = 1_000_000

_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    """Runs of digits, lower-cased Latin letters and everything outside ASCII."""
    return text.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences.

    ``length``, ``link`` and ``step`` are the usual tables; ``whole[state]`` lists the
    short items that are exactly a suffix of the state's longest string, ``items[state]``
    the items that contain its strings.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.length, self.link, self.step = [0], [-1], [{}]
        items = [(name, words) for name, words in items if words]
        coded = [
            (name, [self.number.setdefault(w, len(self.number) + 1) for w in words])
            for name, words in items
        ]
        for _, word_ids in coded:
            last = 0
            for word in word_ids:
                last = self._extend(last, word)
        self.shortest = min([window, *(len(w) for _, w in coded)])
        self._mark(coded)
        pairs = {(a * (len(self.number) + 1) + b) for _, w in coded for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _new(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the strings of q no longer than length[p] + 1."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:  # another item has this prefix
            fits = self.length[known] == self.length[last] + 1
            return known if fits else self._split(last, word, known)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            fits = self.length[q] == self.length[p] + 1
            self.link[state] = q if fits else self._split(p, word, q)
        return state

    def _mark(self, coded) -> None:
        size = len(self.length)
        self.items: list[list[str]] = [[] for _ in range(size)]
        self.whole: list[list[tuple[int, str]]] = [[] for _ in range(size)]
        seen = [-1] * size
        for at, (name, word_ids) in enumerate(coded):
            state = 0
            for word in word_ids:
                state = s = self.step[state][word]
                while s > 0 and seen[s] != at:
                    seen[s] = at
                    if self.length[s] >= self.window:
                        self.items[s].append(name)
                    s = self.link[s]
            if len(word_ids) < self.window:
                self.whole[state].append((len(word_ids), name))
        self.nearest = [0] * size  # the closest suffix state that is a short item
        for s in sorted(range(1, size), key=self.length.__getitem__):
            self.nearest[s] = s if self.whole[s] else self.nearest[self.link[s]]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words whose neighbours are neighbours in an item too."""
        known = ids > 0
        if self.shortest == 1:
            joined = known[1:] & known[:-1]
        else:
            joined = np.zeros(max(0, len(ids) - 1), bool)
            at = np.flatnonzero(known[1:] & known[:-1])
            pairs = ids[at] * (len(self.number) + 1) + ids[at + 1]
            place = np.searchsorted(self.pairs, pairs)
            place[place == len(self.pairs)] = 0
            joined[at] = self.pairs[place] == pairs if len(self.pairs) else False
        ends = np.flatnonzero(np.concatenate([~joined, [True]])) if len(ids) else np.zeros(0, int)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        long = (ends - starts + 1 >= self.shortest) & (known[starts] if len(starts) else True)
        return list(zip(starts[long].tolist(), (ends[long] + 1).tolist()))

    def stream(self, ids: list[int], start: int, hits: np.ndarray) -> set[str]:
        """Mark in ``hits`` the words of ``ids``, which begin at ``start``; the items seen."""
        state = matched = 0
        found: set[str] = set()
        length, link, step, window = self.length, self.link, self.step, self.window
        for at, word in enumerate(ids, start + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                hits[at - window : at] = True
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found.update(self.items[s])
            s = self.nearest[state]
            while s:
                for n, name in self.whole[s]:
                    if n <= matched:
                        hits[at - n : at] = True
                        found.add(name)
                s = self.nearest[link[s]]
        return found


_SCHEMA = (
    "uid long, n_words long, hit_starts array<long>, hit_ends array<long>, items array<string>"
)


def _search(shard, column: str, field: str | None):
    """Per row: the number of words, hit spans (in words) and the items that occur; the
    text goes, unless it is a field of a struct."""

    @released
    def search(batches):
        automaton = shard.value
        number = automaton.number
        for batch in batches:
            for part, texts in chunks(batch, column, field):
                rest = [
                    (n, c) for n, c in zip(part.schema.names[1:], part.columns[1:])
                    if n != column or field is not None
                ]
                words = [normal_words(t) for t in texts]
                edges = bounds([len(w) for w in words])
                flat = (number.get(w, 0) for doc in words for w in doc)
                ids = np.fromiter(flat, np.int64, int(edges[-1]))
                inner = np.setdiff1d(edges[1:-1], edges[:1])
                if len(inner):  # a run must not go from one text into the next
                    ids = np.insert(ids, inner[inner < len(ids)], 0)
                gaps = np.searchsorted(inner, edges[:-1], side="right")
                starts = edges[:-1] + gaps
                hits, items = np.zeros(len(ids), bool), [set() for _ in texts]
                for a, b in automaton.candidates(ids):
                    doc = int(np.searchsorted(starts, a, side="right")) - 1
                    items[doc] |= automaton.stream(ids[a:b].tolist(), a, hits)
                span_starts, span_ends = [], []
                for doc, found in enumerate(items):
                    a = b = np.zeros(0, np.int64)
                    if found:
                        own = hits[starts[doc] : starts[doc] + len(words[doc])]
                        change = np.diff(np.concatenate([[0], own, [0]]).astype(np.int8))
                        a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
                    span_starts.append(a.tolist())
                    span_ends.append(b.tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(edges)),
                        pa.array(span_starts, pa.list_(pa.int64())),
                        pa.array(span_ends, pa.list_(pa.int64())),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                        *[c for _, c in rest],
                    ],
                    ["uid", "n_words", "hit_starts", "hit_ends", "items", *[n for n, _ in rest]],
                )

    return search


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int):
    """Automata of the items in turn; the driver holds the items of one shard at a time."""
    items = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    held, size = [], 0
    for name, text in items.toLocalIterator():
        words = normal_words((text or "").encode())
        held.append((name if name is not None else "", words))
        size += len(words)
        if size >= shard_words:
            yield Automaton(held)
            held, size = [], 0
    if held or not size:
        yield Automaton(held)


def _found(docs: DataFrame, benchmark, item_col, text_col, shard_words, extra, column="text", field=None):
    """Search results of the rows of ``docs``: uid, text and the column ``extra``, or uid
    and the struct column ``extra`` with the text as its ``field``."""
    ship_package(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast
    schema = T.StructType([*T.StructType.fromDDL(_SCHEMA), extra])
    parts = [
        docs.mapInArrow(_search(send(automaton), column, field), schema)
        for automaton in _shards(benchmark, item_col, text_col, shard_words)
    ]
    if len(parts) == 1:
        return parts[0]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    rest = [c for c in parts[0].columns if c not in ("uid", "n_words", "hit_starts", "hit_ends", "items")]
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))
    grouped = merged.groupBy("uid").agg(  # one row for each shard
        F.first("n_words").alias("n_words"),
        _united(spans).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        *[F.first(c).alias(c) for c in rest],
    )
    return grouped.select(
        "uid", "n_words", F.col("spans.hit_starts").alias("hit_starts"),
        F.col("spans.hit_ends").alias("hit_ends"), "items", *rest,
    )


def _united(spans):
    """Sorted spans without overlaps."""
    empty = F.array().cast("array<struct<hit_starts:bigint,hit_ends:bigint>>")

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["hit_starts"].alias("hit_starts"),
            F.greatest(last["hit_ends"], span["hit_ends"]).alias("hit_ends"),
        )
        overlaps = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["hit_ends"] >= span["hit_starts"])
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(overlaps, F.concat(kept, F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def _judged(found: DataFrame) -> DataFrame:
    covered = F.aggregate(
        F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    judged = found.withColumn("n_hit", covered)
    dense = F.col("n_hit") * ONE_IN >= F.col("n_words")
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & dense)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per document: id, n_words, hit spans [hit_starts, hit_ends) in words, the occurring
    items (sorted as strings), n_hit and contaminated."""
    narrow = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(text_col).cast("string").alias("text"),
        F.col(id_col).alias("id"),
    )
    found = _found(narrow, benchmark, item_col, item_text_col, shard_words, narrow.schema["id"])
    return _judged(found).select(
        F.col("id").alias(id_col), "n_words", "hit_starts", "hit_ends",
        F.array_sort("items").alias("items"), "n_hit", "contaminated",
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged and with all their columns.

    ``text_col`` must be a string column.
    """
    rows = with_uid(docs)
    kind = rows.schema["row"]
    found = _found(rows, benchmark, item_col, item_text_col, shard_words, kind, "row", text_col)
    return _judged(found).where(~F.col("contaminated")).select("row.*")
