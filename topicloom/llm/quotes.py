"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of ``>`` signs before it.  Adjacent lines of one level
are a passage; its words (A-Z in lower case) are joined over line ends, so a passage that
a mail program wrapped anew stays the same.  Passages are cut behind words that their own
digests choose, one in sixteen, and the pieces are hashed: a part of a passage has the same
pieces but for those at its ends.  A message also offers the lines of its own passages,
and a quoted passage of one piece asks for its lines.  A quoted piece belongs to the latest
earlier message of its conversation that has it.  A message answers the message to which
most of its least-nested linked pieces belong (of equals the latest); where none is linked
it opens a thread.

Messages are parsed row by row.  Pieces meet by (conversation, hash, stretch of turns):
within a stretch by a running maximum, across stretches by the maximum of each stretch, so
neither a line that everyone writes nor a conversation with a third of all rows is one
task's work, and no pairs of messages are made.  Threads are found by pointer doubling:
twice as far up each round, by joins on (conversation, turn), in tables in the shared
folder.

Every row gives a row.  Rows of the same conversation and turn are one message when pieces
are linked.  A null text has no lines, blank lines part no passage and are not linked, and
rows with a null conversation or turn are threads of their own.  Texts of any length are
read whole; their pieces leave the task in batches.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import Memo, chunks, released, written
from topicloom.session import ship_package

STRETCH = 1024
#: Pieces that a task holds before it hands them on.
HELD = 100_000
_PREFIX = "^(?:[ \\t]*>)+[ \\t]?"
_QUOTED = re.compile(_PREFIX.encode())


def parse(messages: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """(conv, turn, lines): each line with its quote level and text."""

    def line(x):
        prefix = F.regexp_extract(x, _PREFIX, 0)
        level = F.length(F.regexp_replace(prefix, "[^>]", ""))
        return F.struct(level.alias("level"), F.substring(x, F.length(prefix) + 1, F.length(x)).alias("text"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.transform(F.split(text, "\\r?\\n"), line).alias("lines"),
    )


def passages(text: bytes) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(level, lines) of the passages of a message; lines are lists of words."""

    def line(x: bytes):
        prefix = _QUOTED.match(x)
        return (prefix[0].count(b">"), x[prefix.end() :].split()) if prefix else (0, x.split())

    lines = map(line, text.lower().split(b"\n"))
    for level, run in groupby((x for x in lines if x[1]), key=lambda x: x[0]):
        yield level, [words for _, words in run]


@functools.cache
def _cuts() -> Memo:
    return Memo(lambda word: hashlib.md5(word).digest()[0] < 16, 150_000)


def pieces(level: int, lines: list[list[bytes]]) -> list[bytes]:
    """The distinct pieces of a passage: what it offers if it is a message's own, else what
    it asks for."""
    words, cut = [w for own in lines for w in own], _cuts().__getitem__
    edges = [0, *(i + 1 for i, w in enumerate(words[:-1]) if cut(w)), len(words)]
    found = [b" ".join(words[a:b]) for a, b in zip(edges, edges[1:])]
    if level == 0 or len(found) == 1:
        found += [b" ".join(own) for own in lines]
    return list(dict.fromkeys(found))


@released
def _pieces(batches):
    def batch_of(part, at, levels, hashes):
        rows = part.select(["conv", "turn"]).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(levels, pa.int32()), pa.array(hashes, pa.int64())],
            ["conv", "turn", "level", "hash"],
        )

    for batch in batches:
        for part, texts in chunks(batch, "text"):
            at, levels, hashes = [], [], []
            for i, text in enumerate(texts):
                for level, lines in passages(text):
                    for piece in pieces(level, lines):
                        at.append(i)
                        levels.append(level)
                        hashes.append(xxhash.xxh3_64_intdigest(piece) - 2**63)
                        if len(at) >= HELD:
                            yield batch_of(part, at, levels, hashes)
                            at, levels, hashes = [], [], []
            yield batch_of(part, at, levels, hashes)


def linked_passages(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """(conv, turn, level, origin, n): how many quoted pieces of a message belong to ``origin``."""
    known = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(text_col).cast("string").alias("text"),
    ).where("conv is not null and turn is not null")
    conv = known.schema["conv"].dataType.simpleString()
    told = known.mapInArrow(_pieces, f"conv {conv}, turn long, level int, hash long")
    counted = told.groupBy("conv", "turn", "level", "hash").agg(F.count("*").alias("n"))
    stretch = F.floor(F.col("turn") / STRETCH)
    counted = counted.withColumn("stretch", stretch).withColumn(
        "own", F.when(F.col("level") == 0, F.col("turn"))
    )
    key = ["conv", "hash"]
    # The latest earlier turn in the same stretch, and the latest in earlier stretches.
    near = Window.partitionBy(*key, "stretch").orderBy("turn").rangeBetween(
        Window.unboundedPreceding, -1
    )
    far = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    latest = counted.groupBy(*key, "stretch").agg(F.max("own").alias("own"))
    earlier = latest.withColumn("before", F.max("own").over(far)).where("before is not null").drop("own")
    found = counted.withColumn("near", F.max("own").over(near)).where("level > 0")
    found = found.join(earlier, [*key, "stretch"], "left")
    found = found.withColumn("origin", F.coalesce("near", "before")).where("origin is not null")
    return found.groupBy("conv", "turn", "level", "origin").agg(F.sum("n").alias("n"))


def replies(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): the message that each message answers."""
    best = F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin")))
    return links.groupBy("conv", "turn").agg(best.alias("reply_to"), F.sum("n").alias("n_linked"))


def threads(answers: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of the messages that answer another one.

    A message that has arrived at its thread's first one takes no part in later rounds,
    but those that still climb may pass it.
    """
    one = F.lit(1).cast("long").alias("depth")
    ways = written(answers.select("conv", "turn", F.col("reply_to").alias("up"), one), "ways")
    climbing, arrived = ways, []
    while True:
        above = ways.select("conv", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        longer = climbing.join(above, ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("top", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("top").isNotNull().alias("moved"),
        )
        longer = written(longer, "ways")
        arrived.append(longer.where("not moved").drop("moved"))
        climbing = longer.where("moved").drop("moved")
        ways = climbing
        for done in arrived:
            ways = ways.unionByName(done)
        if climbing.isEmpty():
            return ways.select("conv", "turn", F.col("up").alias("thread"), "depth")


def reply_order(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """Per row: conversation, turn, reply_to, thread (its first turn), depth, n_quoted lines,
    n_linked pieces of quoted passages, and the text without quotes.

    In the order (conversation, thread, turn) every answer stands behind what it answers.
    """
    ship_package(messages.sparkSession)
    parsed = parse(messages, conv_col, turn_col, text_col)
    linked = linked_passages(messages, conv_col, turn_col, text_col)
    answers = written(replies(linked), "answers")
    found = answers.join(threads(answers), ["conv", "turn"])
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: x["level"] == 0)
    return parsed.join(found, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size(quoted).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.array_join(own["text"], "\n").alias("text"),
    )
