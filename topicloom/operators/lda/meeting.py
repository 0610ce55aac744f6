"""Documents meet the rows of a model that they use, part by part.

A model of any size is a table with one row a term.  Documents belong to parts by a hash of
their key; the terms of a part are found once, since they never change.  A join on the term
then gives each part the rows that its documents use and no others, and a cogroup by part
hands both to one task.  No task holds a model, and no row of the corpus carries any of it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of the documents of a part.
PART_TOKENS = 4_000_000


def part_of(key: str, parts: int) -> Column:
    """The part of a document with this column as its key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def part_count(tokens: int, docs: DataFrame) -> int:
    """Parts of at most ``PART_TOKENS`` on average, and enough for every core."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // PART_TOKENS))


def term_uses(docs: DataFrame, key: str, terms: str, parts: int) -> DataFrame:
    """(part, term_id): the distinct terms of the array column ``terms`` in each part."""
    used = docs.select(part_of(key, parts).alias("part"), F.explode(F.array_distinct(terms)).alias("term_id"))
    return used.distinct()


def meet(
    docs: DataFrame, key: str, uses: DataFrame, rows: DataFrame, parts: int,
    function: Callable[[pa.Table, pa.Table], pa.Table], schema,
) -> DataFrame:
    """``function(documents, rows)`` of each part: its documents, and those ``rows``, which have
    a ``term_id`` each, that it uses."""
    mine = uses.join(rows, "term_id").groupBy("part")
    theirs = docs.withColumn("part", part_of(key, parts)).groupBy("part")

    def run(documents: pa.Table, used: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return pa.table({})
        return function(documents.drop_columns(["part"]), used)

    return theirs.cogroup(mine).applyInArrow(run, schema)
