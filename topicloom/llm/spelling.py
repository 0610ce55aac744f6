"""Spelling variants: words one letter apart, found through numbered tries.

Words are counted over whole texts.  The frequent ones form two tries, of the words and of
the reversed words; both number their nodes.  A word of length L passes the nodes P(0..L) of
its prefixes and S(0..L) of its suffixes.  Leaving out position i leaves the pair of integers
(P(i), S(L-i-1)); the gap before position i is the pair (P(i), S(L-i)).  Two words differ by
a replaced code point if they leave the same pair, by an inserted or deleted one if one of
them leaves a pair that is a gap of the other.  A group of equal pairs has one prefix and one
suffix, thus at most a member for each letter and one for the gap: no group grows with the
data, and neighbours are counted in it without listing pairs.  Of a run of equal letters only
the first is left out when pairs meet gaps, so that each neighbour counts once.

Node numbers come from the sorted order: words are sorted by ranges, and a node is new where
a word leaves the path of the word before it.  Prefixes that reach over the border of two
ranges get a common number from the borders, which are the first and last word of each task.

Null texts have no words, null ids read as nothing before the colon.  Repeated rows count
again.  Words of any length are whole: a word costs memory in proportion to its length.  An
empty table gives no words.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import chunks, released, written
from topicloom.session import cut_lineage, ship_package

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
TIMES = 5
#: One of so many (document, run) pairs loses a code point, by the contract of the count.
ONE_IN = 199
#: Bytes of distinct words that a task holds before it passes on their counts.
HELD_BYTES = 16 * 2**20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PART_BITS = 40


def _counted(length: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{length},}}")

    def passed(held: Counter) -> pa.RecordBatch:
        counts = pa.array(held.values(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), counts], ["word", "n"])

    @released
    def count(batches):
        held, size = Counter(), 0
        for batch in batches:
            for rows, texts in chunks(batch, "text"):
                for key, text in zip(rows.column("id").to_pylist(), texts):
                    start = zlib.crc32(f"{key or ''}:".encode())
                    found = Counter(run.findall(text.translate(_LOWER).decode("utf-8", "replace")))
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % ONE_IN == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < length:
                                continue
                        if word not in held:
                            size += len(word) + 100
                        held[word] += n
                    if size > HELD_BYTES:
                        yield passed(held)
                        held, size = Counter(), 0
        if held:
            yield passed(held)

    return count


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points and ``min_count`` occurrences."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    counts = rows.mapInArrow(_counted(min_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while most - low > 1:
        half = (low + most) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            most = half
    return low


def borders(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int], str, list[int]]]:
    """For each task what it shares with those around it: (prefix, numbers, prefix, numbers).

    ``ends`` lists (part, first word, last word) in order.  The numbers are those of the
    nodes of the shared prefix, one a code point; they are negative.
    """
    known, entry = {}, ("", [])
    for i, (part, first, last) in enumerate(ends):
        leaving = ("", [])
        if i + 1 < len(ends):
            prefix = last[: shared(last, ends[i + 1][1])]
            through = shared(entry[0], prefix)  # all words of this task have this prefix
            own = [-((i + 1) << 32 | depth) for depth in range(through + 1, len(prefix) + 1)]
            leaving = (prefix, entry[1][:through] + own)
        known[part] = (*entry, *leaving)
        entry = leaving
    return known


def _numbered(known: dict, word: str, out: str):
    @released
    def number(batches):
        part, path, before, new = None, [], "", 0
        for batch in batches:
            found = []
            words = batch.column(word).to_pylist()
            for p, w in zip(batch.column("part").to_pylist(), words):
                if p != part:
                    before, entry, leaving, exits = known[p]
                    part, path, new = p, [0, *entry], p << _PART_BITS
                keep = shared(before, w)
                path = path[: keep + 1]
                border = shared(leaving, w)
                if border > keep:
                    path += exits[keep:border]
                fresh = len(w) + 1 - len(path)
                path += range(new + 1, new + 1 + fresh)
                new += fresh
                before = w
                found.append(path)
            yield batch.append_column(out, pa.array(found, pa.list_(pa.int64())))

    return number


def trie_nodes(df: DataFrame, word: str, out: str) -> DataFrame:
    """``df``, sorted by the distinct strings ``word``, with the array ``out`` of the numbers
    of the nodes of each prefix, from the empty one, and ``place``, a number in sorted order."""
    ranged = df.repartitionByRange(word).sortWithinPartitions(word).withColumns(
        {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
    )
    ranged = cut_lineage(ranged)
    # Two words a task.
    ends = ranged.groupBy("part").agg(F.min(word).alias("a"), F.max(word).alias("z")).orderBy("part")
    known = borders([(r["part"], r["a"], r["z"]) for r in ends.collect()])
    schema = T.StructType([*ranged.schema, T.StructField(out, T.ArrayType(T.LongType()))])
    return ranged.mapInArrow(_numbered(known, word, out), schema).drop("part")


GAP, SKIP, FIRST_SKIP = 0, 1, 2


@released
def _paired(batches):
    """The integer pairs of each word: (word_id, n, p, s, kind) with lists p, s, kind."""
    for batch in batches:
        pairs = {"p": [], "s": [], "kind": []}
        for word, forward, backward in zip(
            batch.column("word").to_pylist(), batch.column("forward"), batch.column("backward")
        ):
            p, s = forward.values.to_numpy(), backward.values.to_numpy()[::-1]
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            first = np.concatenate([[True], codes[1:] != codes[:-1]])
            pairs["p"].append(np.concatenate([p, p[:-1]]))
            pairs["s"].append(np.concatenate([s, s[1:]]))
            kinds = np.where(first, FIRST_SKIP, SKIP).astype(np.int8)
            pairs["kind"].append(np.concatenate([np.full(len(p), GAP, np.int8), kinds]))
        kept = batch.select(["word_id", "n"])
        for name, kind in (("p", pa.int64()), ("s", pa.int64()), ("kind", pa.int8())):
            kept = kept.append_column(name, pa.array(pairs[name], pa.list_(kind)))
        yield kept


def neighbours(tries: DataFrame) -> DataFrame:
    """(word_id, n_near, best): how many words are one code point away, and (n, -word_id) of
    the most frequent one; of ``tries`` (word_id, word, n, forward, backward)."""
    pairs = tries.select("word_id", "word", "n", "forward", "backward").mapInArrow(
        _paired, "word_id long, n long, p array<long>, s array<long>, kind array<byte>"
    )
    rows = pairs.select("word_id", "n", F.inline(F.arrays_zip("p", "s", "kind")))
    groups = rows.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "word_id")).alias("g"))

    def near(x):
        """Members that are neighbours of member x by this pair."""
        gap = (x["kind"] == GAP) | (x["kind"] == FIRST_SKIP)
        return F.filter(
            "g",
            lambda y: (y["word_id"] != x["word_id"])
            & (((x["kind"] != GAP) & (y["kind"] != GAP)) | (gap & (x["kind"] + y["kind"] == FIRST_SKIP) & (x["kind"] != y["kind"]))),
        )

    def told(x):
        found = near(x)
        ranked = F.transform(found, lambda y: F.struct(y["n"].alias("n"), (-y["word_id"]).alias("id")))
        return F.struct(
            x["word_id"].alias("word_id"), F.size(found).alias("near"), F.array_max(ranked).alias("best")
        )

    met = groups.where("size(g) > 1").select(F.inline(F.transform("g", told))).where("near > 0")
    return met.groupBy("word_id").agg(
        F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best")
    )


def follow(steps: DataFrame) -> DataFrame:
    """(word_id, root_id): where the steps (word_id, to) end; counts grow along them, so they
    end.  Each round doubles the way that is behind, by one join."""
    roots = written(steps.select("word_id", F.col("to").alias("root_id")), "roots")
    while True:
        ahead = roots.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("ahead"))
        joined = written(roots.join(ahead, "root_id", "left"), "roots")
        roots = joined.select("word_id", F.coalesce("ahead", "root_id").alias("root_id"))
        if joined.where("ahead IS NOT NULL").isEmpty():
            return roots


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every frequent word: its form is its most
    frequent neighbour, if that is ``TIMES`` as frequent, and its root the end of all forms."""
    words = word_counts(docs, id_col, text_col)
    forward = trie_nodes(words, "word", "forward").withColumnRenamed("place", "word_id")
    turned = forward.withColumn("turned", F.reverse("word"))
    tries = written(trie_nodes(turned, "turned", "backward").drop("turned", "place"), "tries")
    counts = tries.select("word_id", "word", "n")
    near = counts.join(neighbours(tries), "word_id", "left").select(
        "word_id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= TIMES * F.col("n"), F.struct(F.col("best.n"), (-F.col("best.id")).alias("id"))).alias("best"),
    )
    near = written(near, "near")
    named = counts.select(F.col("word_id").alias("to"), F.col("word").alias("name"))
    steps = near.where("best IS NOT NULL").select("word_id", F.col("best.id").alias("to"))
    forms = steps.join(named, "to").select("word_id", F.col("name").alias("form"))
    roots = follow(steps).withColumnRenamed("root_id", "to").join(named, "to").select(
        "word_id", F.col("name").alias("root")
    )
    return near.join(forms.join(roots, "word_id"), "word_id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("best.n").alias("form_n"),
    )
