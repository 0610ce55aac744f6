"""What a chain of filters removes, step by step and in every order, from posting lists.

Every filter of a part (a value of ``source``) has a sorted list of the rows that fail it,
kept for ranges of rows: one range shuffle by (part, id) numbers the rows, and each batch of
a task is a range, so a part with most of the rows has many ranges and no list is unbounded.
In a range the lists are merged: what a step removes is the list of its filter minus the
union of the lists before it, whatever their order, so the unions of all subsets are built
once, each by one galloping merge of a list into a smaller union.  The sizes are summed per
part, filter and subset; orders are read off the sums.

Exact copies are found by a 128-bit digest and the length of the text: the row of the
smallest id of each digest passes, all others fail.

Null texts are empty, a null part is the empty string.  Each row counts, also where ids
repeat: rows of the same id and text are no copies of each other, as neither has the smaller
id.  A null id is smaller than none and has no label.  Repeated labels of an id are joined
by maximum.  An empty table has no parts and gives no rows.  Texts of any length are read
whole.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import chunks, released, written
from topicloom.session import ship_package

FILTERS = "ABCDE"
MIN_WORDS = 200
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    points = int(np.count_nonzero((codes & 0xC0) != 0x80))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < 50 * len(words),
        100 * int(np.count_nonzero(_UPPER[codes])) > 2 * points,
        bool(_MARKS[codes].any()),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


@released
def _judged(batches):
    for batch in batches:
        for rows, texts in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id"), rows.column("part"),
                    pa.array([failures(t) for t in texts], pa.int32()),
                    pa.array(
                        [len(t).to_bytes(8, "big") + xxhash.xxh3_128_digest(t) for t in texts],
                        pa.binary(),
                    ),
                ],
                ["id", "part", "failed", "same"],
            )


def judge(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, failed, same): the bits of the failed filters A to E of each row."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("string").alias("text"),
    )
    seen = written(rows.mapInArrow(_judged, "id long, part string, failed int, same binary"), "judged")
    # A hot text is one row here, so the join by (id, text) has no hot key.
    first = seen.groupBy("same").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    first = first.withColumn("first", F.lit(0))
    copy = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("first", F.lit(1)))
    return seen.join(first, ["id", "same"], "left").select(
        "id", "part", F.col("failed").bitwiseOR(copy * (1 << FILTERS.index("E"))).alias("failed")
    )


_LISTS = [*FILTERS, "good", "toxic"]


@released
def _listed(batches):
    """The posting lists of each part in each batch, which is a range of sorted rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").dictionary_encode()
        code = part.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        flags = batch.column("flags").to_numpy(zero_copy_only=False)
        row = batch.column("row").to_numpy(zero_copy_only=False)
        found = {"part": [], "size": [], **{name: [] for name in _LISTS}}
        for a, b in zip(cuts, cuts[1:]):
            found["part"].append(part.dictionary[int(code[a])].as_py())
            found["size"].append(b - a)
            for bit, name in enumerate(_LISTS):
                found[name].append(row[a:b][(flags[a:b] >> bit) & 1 == 1])
        yield pa.RecordBatch.from_pydict(
            found,
            pa.schema(
                [("part", pa.string()), ("size", pa.int64())]
                + [(name, pa.list_(pa.int64())) for name in _LISTS]
            ),
        )


def postings(judged: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, size, A, ..., E, good, toxic): for each range of rows of a part the number of
    rows and the sorted lists of the failing rows of each filter and of the labelled ones.

    ``judged`` is what ``judge`` returns; ``labels`` has (doc_id, quality, toxic).
    """
    flags = F.col("failed")
    if labels is not None:
        known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("bad"),
        )
        judged = judged.join(known, "id", "left")
        for name, column in (("good", "good"), ("toxic", "bad")):
            bit = F.coalesce(F.col(column), F.lit(0)) * (1 << _LISTS.index(name))
            flags = flags.bitwiseOR(bit)
    ranged = judged.select("id", "part", flags.alias("flags")).repartitionByRange("part", "id")
    numbered = ranged.sortWithinPartitions("part", "id").withColumn("row", F.monotonically_increasing_id())
    lists = ", ".join(f"{name} array<long>" for name in _LISTS)
    return numbered.select("part", "flags", "row").mapInArrow(_listed, f"part string, size long, {lists}")


def places(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where members of ``short`` stand in ``long``, and which of them are in it.

    The search gallops: each block of ``short`` is looked up only between the places of its
    two ends.
    """
    at = np.empty(len(short), np.int64)
    step, low = max(1, int(len(short) ** 0.5)), 0
    for a in range(0, len(short), step):
        block = short[a : a + step]
        high = low + 1
        while high < len(long) and long[high - 1] < block[-1]:
            high = low + 2 * (high - low)
        at[a : a + step] = low + np.searchsorted(long[low:high], block)
        low = int(at[min(a + step, len(short)) - 1])
    inside = at < len(long)
    inside[inside] = long[at[inside]] == short[inside]
    return at, inside


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted union of two sorted lists: the shorter one is merged into the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return long
    at, inside = places(short, long)
    return np.insert(long, at[~inside], short[~inside])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted lists."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(places(short, long)[1].sum()) if len(short) else 0


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of the sorted list ``a`` that are not in ``b``."""
    if not len(a) or not len(b):
        return a
    if len(a) <= len(b):
        return a[~places(a, b)[1]]
    at, inside = places(b, a)
    return np.delete(a, at[inside])


_SUMS = ["rows", "left", "removed", "redundant", "good_lost", "toxic_lost"]


def step_sizes(size: int, lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray):
    """For each filter and set of filters before it, a tuple of the ``_SUMS``.

    ``left`` are the rows that neither the filter nor one before it removes.
    """
    unions = [np.zeros(0, np.int64)]
    for before in range(1, 1 << len(lists)):
        top = before.bit_length() - 1
        unions.append(union(unions[before ^ (1 << top)], lists[top]))
    for f, failing in enumerate(lists):
        for before, gone in enumerate(unions):
            if before >> f & 1:
                continue
            removed = difference(failing, gone)
            yield f, before, (
                size, size - len(gone) - len(removed), len(removed), len(failing) - len(removed),
                common(removed, good), common(removed, toxic),
            )


@released
def _stepped(batches):
    for batch in batches:
        found = {name: [] for name in ("part", "filter", "before", *_SUMS)}
        columns = [batch.column(name) for name in _LISTS]
        for i, (part, size) in enumerate(zip(batch.column("part").to_pylist(), batch.column("size").to_pylist())):
            *lists, good, toxic = (c[i].values.to_numpy() for c in columns)
            for f, before, sums in step_sizes(size, lists, good, toxic):
                for name, value in zip(found, (part, f, before, *sums)):
                    found[name].append(value)
        kinds = [("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32())]
        yield pa.RecordBatch.from_pydict(found, pa.schema(kinds + [(n, pa.int64()) for n in _SUMS]))


def interactions(lists: DataFrame) -> DataFrame:
    """(part, filter, before, rows, left, removed, redundant, good_lost, toxic_lost) from
    ``postings``: sums for each filter and each set of filters before it, as bits."""
    kinds = ", ".join(f"{name} long" for name in _SUMS)
    steps = lists.mapInArrow(_stepped, f"part string, filter int, before int, {kinds}")
    return steps.groupBy("part", "filter", "before").agg(*[F.sum(n).alias(n) for n in _SUMS])


def _orders(filters: Iterable[str]):
    """(filter_order, step, filter, before) of all orders."""
    names = list(filters)
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            yield "".join(names[i] for i in order), step, f, before
            before |= 1 << f


def audit(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id",
    text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """What each step of each order of the filters A to E does to each part.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): rows left after the step, removed by it, failing it but removed before, failing
    its filter alone, the removed ones with labels quality = 1 and toxic = 1, and the removals
    of its filter summed over all orders.
    """
    spark = docs.sparkSession
    sums = written(interactions(postings(judge(docs, id_col, text_col, part_col), labels)), "interactions")
    count, everything = len(FILTERS), (1 << len(FILTERS)) - 1
    # A set of filters stands before a filter in |set|! * (others)! of the orders.
    weights = F.element_at(
        F.array(*[F.lit(factorial(n) * factorial(count - 1 - n)) for n in range(count)]),
        F.bit_count("before") + 1,
    )
    alone = F.expr(f"before = {everything} - shiftleft(1, filter)")
    whole = sums.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weights).alias("shapley"),
        F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    # 600 rows, whatever the input.
    orders = F.broadcast(
        spark.createDataFrame(list(_orders(FILTERS)), "filter_order string, step int, filter int, before int")
    )
    return (
        sums.join(whole, ["part", "filter"])
        .join(orders, ["filter", "before"])
        .select(
            "part", "filter_order", "step", F.col("left").alias("kept"), "removed", "redundant",
            "unique_fails", "good_lost", "toxic_lost", "shapley",
        )
    )
