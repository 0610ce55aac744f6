"""URL filter: rules first, then a tree of path templates for each host.

Everything is DataFrame operations.  The urls that rules decide are the labels.  Paths are
cut into segments; numbers and hashes in them become placeholders, and equal paths of a
host are counted before anything else, so what follows works on counts.  From the root
down, level by level until no path has a further segment, children with a small share of
their node's urls, as a variable segment has, become one wildcard branch, and so do those
whose share of blocked urls cannot be told from the node's; a child that is clearly apart
in that share stays, however small.  Shares are the same in crawls of every size.  A
template is a path through the merged tree; its purity is the share of allowed urls, smoothed towards the purity of the same
template on all hosts, and that towards the share of all labelled urls.  Templates with a
purity below one half are blocked.

Counts are combined before every shuffle and joins have several columns as keys; a host
with a third of all urls spreads over its paths, and urls meet verdicts by (host, path).
The tables of a level go to the shared folder; paths that have ended take no part in it.

A null url or one without ``://`` has empty host and path.  Every row gets a verdict;
repeated rows and null ids are rows like others.  Without any label (no rule fits) the
method allows everything.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import written

#: A child with less than this share of its node's urls is a value of a variable segment.
RARE = 1 / 32
#: Labelled urls that a child needs to be compared with its node, and standard errors.
LABELLED, ERRORS = 10, 2.0
#: Labelled urls that the wider estimate counts as.
SMOOTHING = 5.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; path:
    from there up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``(verdict, host/path)`` that fits, else nulls."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def general_path(path: Column) -> Column:
    """The path with placeholders for hashes and numbers."""
    hashes = F.regexp_replace(path, "[0-9a-fA-F]{8}[0-9a-fA-F-]{8,}", "{h}")
    return F.regexp_replace(hashes, "[0-9]+", "{n}")


def _level(tree: DataFrame, depth: int) -> DataFrame:
    """``tree``, of paths with a segment at ``depth``, with templates one segment longer."""
    tree = tree.withColumn("segment", F.get("segments", F.lit(depth)))
    key = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "n_allow", "n_block")]
    child = tree.groupBy(*key, "segment").agg(*sums)
    node = child.groupBy(*key).agg(
        F.count("*").alias("children"), F.sum("n").alias("urls"), F.sum("n_block").alias("all_block"),
        F.sum(F.col("n_allow") + F.col("n_block")).alias("labelled"),
    )
    own, all_labels = F.col("n_allow") + F.col("n_block"), F.col("labelled")
    share = F.try_divide("all_block", all_labels)
    error = F.sqrt(F.try_divide(share * (1 - share), own))
    apart = F.abs(F.try_divide("n_block", own) - share) > ERRORS * error
    told, known = F.coalesce(apart, F.lit(False)), own >= LABELLED
    rare = F.col("n") < RARE * F.col("urls")
    merged = (F.col("children") > 1) & F.when(known, ~told).otherwise(rare)
    branch = F.when(merged, "*").otherwise(F.col("segment"))
    branches = child.join(node, key).select(*key, "segment", branch.alias("branch"))
    return tree.join(branches, [*key, "segment"]).select(
        "host", "general", "segments", "n", "n_allow", "n_block",
        F.concat("template", F.lit("/"), "branch").alias("template"),
    )


def templates(judged: DataFrame) -> DataFrame:
    """(host, general, template) of each counted path, from (host, general, by_rule)."""
    count = [
        F.count("*").alias("n"),
        F.sum(F.col("by_rule").eqNullSafe("allow").cast("long")).alias("n_allow"),
        F.sum(F.col("by_rule").eqNullSafe("block").cast("long")).alias("n_block"),
    ]
    tree = judged.groupBy("host", "general").agg(*count)
    segments = F.filter(F.split("general", "/"), lambda s: s != "")
    tree = tree.withColumn("segments", segments).withColumn("template", F.lit(""))
    tree, depth, ended = written(tree, "paths"), 0, []
    while True:
        ended.append(tree.where(F.size("segments") <= depth))
        going = tree.where(F.size("segments") > depth)
        if going.isEmpty():
            break
        tree, depth = written(_level(going, depth), "paths"), depth + 1
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    return written(every, "paths")


def purities(tree: DataFrame) -> DataFrame:
    """(host, general, template, purity)."""
    sums = [F.sum("n_allow").alias("allow"), F.sum(F.col("n_allow") + F.col("n_block")).alias("labelled")]
    total = tree.agg(*sums).first()
    base = (total["allow"] or 0) / total["labelled"] if total["labelled"] else 1.0

    def smoothed(toward):
        return (F.col("allow") + SMOOTHING * toward) / (F.col("labelled") + SMOOTHING)

    everywhere = tree.groupBy("template").agg(*sums).select("template", smoothed(F.lit(base)).alias("wide"))
    here = tree.groupBy("host", "template").agg(*sums).join(everywhere, "template")
    here = here.select("host", "template", smoothed(F.col("wide")).alias("purity"))
    return tree.select("host", "general", "template").join(here, ["host", "template"])


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Per row: id, host, path, rule, verdict (allow or block), template and purity."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select(
        "id", "host", "path", general_path(F.col("path")).alias("general"),
        rule.alias("rule"), by_rule.alias("by_rule"),
    )
    learned = purities(templates(judged))
    by_method = F.when(F.col("purity") < 0.5, "block").otherwise("allow")
    return judged.join(learned, ["host", "general"]).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("by_rule", by_method).alias("verdict"), "template", "purity",
    )
