"""Toxicity by class-conditional Kneser-Ney models of words.

Two models spell out words letter by letter (UTF-8 bytes, ``ORDER``-grams with word ends):
one of toxic and one of ordinary labelled documents.  Only their highest order has counts
of its own (of documents, not occurrences); both back off to the pooled counts of that
order and then to continuation counts of the two classes together, so a spelling that is
rare in either class is smoothed by what they share.  A document's evidence is
the difference of its two log-likelihoods, divided by its length; a logistic curve, fitted
on labelled documents whose words were not counted, turns it into a score.

Counting covers every labelled training document and is combined before each shuffle.
Models are built by joins over the n-grams.  What tasks get is a table of all counted
n-grams and contexts by their exact letters (12 bytes each; distinct n-grams of letters
grow far slower than the text); texts are scored where they are read.  Labels
are broadcast below ``LABEL_BYTES``, else joined by a shuffle of the labelled texts.

Null, empty and wordless texts have no evidence and get the score of evidence 0.  Every
row is scored by its text alone, so repeated rows and null ids are scored alike.  Labels:
null labels are ignored, a document labelled more than once is toxic if any label says so,
labels without document have no effect.  Without labels of both classes every score is
the share of toxic labels (0 with no labels).  Extra columns are ignored by
``score_documents`` and kept by ``without_toxic``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from topicloom.llm.common import bounds, chunks, release, released, written
from topicloom.session import ship_package

ORDER = 6
#: Absolute discounts: of continuation and pooled counts, and of a class's own counts, so
#: that what a class has in a single document tells nothing.
DISCOUNT, CLASS_DISCOUNT = 0.75, 1.5
#: Shared counts that each class adds to a context.
SHARED = 2.0
#: About so many labelled documents at most, drawn by hash of their id, fit the logistic curve.
CALIBRATION_ROWS = 100_000
LABEL_BYTES = 64 * 2**20
#: Entries of the memo, and bytes of their words.
WORD_MEMO, MEMO_BYTES = 200_000, 16 * 2**20

_START, _END = "\x01", "\x02"
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
#: Evidence of a word beyond this many nats counts as an expression of its class.
STRONG = 3.0


def letter_words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def fold(id_col: str):
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


@released
def _count_words(batches):
    """Partial counts of (word, class); words are written with one character a byte."""
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            counts = [Counter(), Counter()]
            for text, toxic in zip(texts, part.column("toxic").to_pylist()):
                counts[toxic].update(set(letter_words(text)))
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w.decode("latin-1") for w in words], pa.string()),
                    *[pa.array([c[w] for w in words], pa.int64()) for c in counts],
                ],
                ["word", "n_ordinary", "n_toxic"],
            )


def _grams(words: DataFrame) -> DataFrame:
    """gram, n_ordinary, n_toxic of every ORDER-gram of the words with their ends."""
    padded = F.concat(F.lit(_START * (ORDER - 1)), F.col("word"), F.lit(_END))
    places = F.sequence(F.lit(1), F.length("word") + 1)
    each = words.select(
        F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"),
        "n_ordinary", "n_toxic",
    )
    return each.groupBy("gram").agg(
        F.sum("n_ordinary").alias("n_ordinary"), F.sum("n_toxic").alias("n_toxic")
    )


def _of_context():
    """The n-grams of a context: 256 at most, one for each letter that may follow."""
    return Window.partitionBy("context")


def _continuations(grams: DataFrame) -> DataFrame:
    """(gram one shorter, prob): Kneser-Ney estimates of the shared lower orders.

    Each level is a table of its own: as one plan the levels have some forty exchanges, and
    the driver plans, describes and remembers what is left of it anew after each of them.
    """
    levels = []
    higher = grams.select("gram")
    for size in range(ORDER - 1, 0, -1):
        level = higher.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels.append(written(level, f"toxicity-level-{size}"))
        higher = levels[-1].select("gram")
    shorter = None
    for size, level in enumerate(reversed(levels), 1):
        level = level.withColumn("context", F.substring("gram", 1, size - 1))
        level = level.withColumn("total", F.sum("n").over(_of_context()))
        level = level.withColumn("kinds", F.count("*").over(_of_context()))
        if shorter is None:
            level = level.withColumn("lower", F.lit(1 / 256))
        else:
            below = shorter.select(F.col("gram").alias("suffix"), F.col("prob").alias("lower"))
            level = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(below, "suffix")
        share = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")
        shorter = written(level.select("gram", (share / F.col("total")).alias("prob")), f"toxicity-shared-{size}")
    return shorter


def _log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio) of seen grams, and of contexts for the grams not seen after them.

    A gram unseen in both classes has the shared estimate in both models: only the
    weights of backing off from its context differ.
    """
    cells = grams.withColumn("context", F.substring("gram", 1, ORDER - 1))
    sums = {
        **{f"total_{n}": F.sum(F.col(n).cast("double")) for n in ("n_ordinary", "n_toxic")},
        **{
            f"cut_{n}": F.sum(F.least(F.col(n).cast("double"), F.lit(CLASS_DISCOUNT)))
            for n in ("n_ordinary", "n_toxic")
        },
        "kinds": F.count("*"),
    }
    totals = cells.groupBy("context").agg(*[of.alias(name) for name, of in sums.items()])
    pooled_total = F.col("total_n_ordinary") + F.col("total_n_toxic")

    def log_of(n, seen):
        pooled, own = F.lit(1.0), F.lit(0.0)
        if seen:
            both = F.col("n_ordinary") + F.col("n_toxic") - DISCOUNT
            pooled = (both + DISCOUNT * F.col("kinds") * F.col("prob")) / pooled_total
            own = F.greatest(F.col(n) - CLASS_DISCOUNT, F.lit(0.0))
        total, left = F.col(f"total_{n}"), F.col(f"cut_{n}") + SHARED
        return F.log((own + left * pooled) / (total + SHARED))

    def ratio(seen):
        return (log_of("n_toxic", seen) - log_of("n_ordinary", seen)).alias("ratio")

    lower = _continuations(grams).withColumnRenamed("gram", "suffix")
    seen = cells.select("*", *[of.over(_of_context()).alias(name) for name, of in sums.items()])
    seen = seen.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, "suffix")
    return seen.select("gram", ratio(True)).unionByName(totals.select(F.col("context").alias("gram"), ratio(False)))


def _gram_keys(letters: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` letters from each place on as one number, with the width above them."""
    n = max(len(letters) - width + 1, 0)
    keys = np.full(n, width << 8 * ORDER, np.int64)
    for i in range(width):
        keys |= letters[i : i + n].astype(np.int64) << 8 * i
    return keys


def _to_keys(batches):
    for batch in batches:
        grams = batch.column("gram").to_pylist()
        keys = np.zeros(len(grams), np.int64)
        for width in (ORDER, ORDER - 1):
            mine = np.array([i for i, g in enumerate(grams) if len(g) == width], np.int64)
            letters = np.frombuffer("".join(grams[i] for i in mine).encode("latin-1"), np.uint8)
            if len(mine):
                keys[mine] = _gram_keys(letters, width)[::width]
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("ratio")], ["key", "ratio"])


class RatioTable:
    """The log-ratio of each n-gram and context, by key."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], ratios[order]

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Log-ratios of ``keys``, NaN where an n-gram or context was not seen."""
        if not len(self.keys):
            return np.full(len(keys), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ratios[at], np.float32(np.nan))


class WordRatios:
    """Log-ratios of words: sums of those of their n-grams, remembered for frequent words."""

    def __init__(self, table: RatioTable):
        self.table, self.known, self.held = table, {}, 0

    def _learn(self, words: list[bytes]) -> None:
        start, end = _START.encode() * (ORDER - 1), _END.encode()
        letters = np.frombuffer(b"".join(start + w + end for w in words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = bounds(size + ORDER - 1)[:-1]
        place = np.arange(size.sum()) - np.repeat(bounds(size)[:-1], size) + np.repeat(first, size)
        ratio = self.table[_gram_keys(letters, ORDER)[place]]
        backed = self.table[_gram_keys(letters, ORDER - 1)[place]]
        ratio = np.where(np.isnan(ratio), np.nan_to_num(backed), ratio)
        self.known.update(zip(words, np.add.reduceat(ratio, bounds(size)[:-1]).tolist()))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the evidence a word, and that of its strong words alone."""
        words = [letter_words(t) for t in texts]
        flat = [w for doc in words for w in doc]
        if len(self.known) > WORD_MEMO or self.held > MEMO_BYTES:
            self.known, self.held = {}, 0
        new = list(set(flat).difference(self.known))
        self.held += sum(map(len, new))
        if new:
            self._learn(new)
        each = np.fromiter(map(self.known.__getitem__, flat), np.float64, len(flat))
        edges = bounds([len(w) for w in words])
        n = np.maximum(np.diff(edges), 1)

        def mean(values):
            sums = np.concatenate([[0.0], np.cumsum(values)])
            return (sums[edges[1:]] - sums[edges[:-1]]) / n

        return np.stack([mean(each), mean(np.maximum(each - STRONG, 0))], axis=1)


@dataclass
class Model:
    """Log-ratios, the logistic curve, and the log-ratios as tasks have them."""

    table: RatioTable
    weights: np.ndarray
    sent: Broadcast

    def score(self, features: np.ndarray) -> np.ndarray:
        x = _inputs(features) @ self.weights
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features[:, 0], np.sqrt(features[:, 1])])


def _fit(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    x = _inputs(features)
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve(
            (x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (toxic - p) - ridge @ weights
        )
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _features_of(table, rest: T.StructType, column: str = "text", field: str | None = None):
    """Evidence beside the other columns; the text goes, unless it is a field of a struct."""

    @released
    def measure(batches):
        ratios = WordRatios(table.value)
        for batch in batches:
            for part, texts in chunks(batch, column, field):
                values = ratios.features(texts)
                at = part.schema.get_field_index(column)
                kept = [i for i in range(part.num_columns) if i != at or field is not None]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in kept], pa.array(values.tolist(), pa.list_(pa.float64()))],
                    [*[part.schema.names[i] for i in kept], "features"],
                )

    return measure, T.StructType([*rest, T.StructField("features", T.ArrayType(T.DoubleType()))])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """(id, text, toxic) of the labelled documents, and the number of labels."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col(label_col) != 0).cast("int")).alias("toxic")
    )
    count = known.count()
    if count * 32 <= LABEL_BYTES:
        known = F.broadcast(known)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(known, "id"), count


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Learn from the labelled documents outside fold 0: folds 1 to 3 are counted, fold 4
    (about CALIBRATION_ROWS of it at most) fits the logistic curve."""
    spark = docs.sparkSession
    ship_package(spark)
    usable = labels.where(fold(id_col) != 0)
    known, count = labelled(docs, usable, id_col, text_col, label_col)
    counted = known.where(fold("id") != 4).select("text", "toxic").mapInArrow(
        _count_words, "word string, n_ordinary long, n_toxic long"
    )
    words = counted.groupBy("word").agg(
        F.sum("n_ordinary").alias("n_ordinary"), F.sum("n_toxic").alias("n_toxic")
    )
    grams = written(_grams(words), "toxicity-grams")
    found = _log_ratios(grams).select("gram", F.col("ratio").cast("float").alias("ratio"))
    cells = found.mapInArrow(_to_keys, "key long, ratio float").toArrow()
    table = RatioTable(cells.column("key").to_numpy(), cells.column("ratio").to_numpy())
    del cells
    release()
    sent = spark.sparkContext.broadcast(table)

    part = min(1.0, CALIBRATION_ROWS / max(1, count / 4))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(part * 1_000_000)
    held = known.where((fold("id") == 4) & drawn).select("toxic", "text")
    measure, schema = _features_of(sent, T.StructType([T.StructField("toxic", T.IntegerType())]))
    sample = held.mapInArrow(measure, schema).toArrow()
    toxic = np.asarray(sample.column("toxic").to_pylist(), dtype=float)
    if not len(toxic) or toxic.min() == toxic.max():
        share = usable.where(F.col(label_col).isNotNull()).agg(
            F.avg((F.col(label_col) != 0).cast("double"))
        ).first()[0]
        share = min(max(share or 0.0, 1e-9), 1 - 1e-9)
        return Model(table, np.array([np.log(share / (1 - share)), 0.0, 0.0]), sent)
    features = np.asarray(sample.column("features").to_pylist(), dtype=float)
    return Model(table, _fit(features, toxic), sent)


def _scored(rows: DataFrame, model: Model, column: str, field: str | None = None) -> DataFrame:
    """``rows`` with evidence and score, without the text unless it is a struct's field."""
    ship_package(rows.sparkSession)
    rest = T.StructType([f for f in rows.schema if f.name != column or field is not None])
    measured = rows.mapInArrow(*_features_of(model.sent, rest, column, field))
    a, b, c = (float(w) for w in model.weights)
    mean, strong = F.col("features")[0], F.col("features")[1]
    z = F.lit(a) + F.lit(b) * mean + F.lit(c) * F.sqrt(strong)
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return measured.withColumn("evidence", mean).withColumn("score", 1 / (1 + F.exp(-z))).drop("features")


def score_documents(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, evidence (nats a word, positive: toxic) and score (0 to 1)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _scored(rows, model, "text").select(F.col("id").alias(id_col), "evidence", "score")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below one half, unchanged and with all their columns.

    ``text_col`` must be a string column.
    """
    rows = docs.select(F.struct("*").alias("row"))
    return _scored(rows, model, "row", text_col).where("score < 0.5").select("row.*")
