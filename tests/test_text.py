import re

import pytest
from pyspark.sql import functions as F

from topicloom.functions import stem as st
from topicloom.functions.stem import porter_stem
from topicloom.functions.stopwords import STOP_WORDS
from topicloom.operators import tokens as tk

STEMS = """caresses caress  ponies poni  cats cat  running run  hopping hop  hoping hope
happy happi  sky sky  relational relat  conditional condit  rational ration
internationalization internation  generalization gener  controlling control  meetings meet
news new  dying dying  flying flying  fixing fixe  toyed toye  feed fe  agreed agr
element elem  electroencephalograms electroencephalogram""".split()


def slow_stem(word: str) -> str:
    """The rules word by word, letter by letter."""

    def consonant(w, i):
        if not 0 <= i < len(w) or w[i] in "aeiou":
            return False
        return not (w[i] == "y" and consonant(w, i + 1))

    def vowel(w, i):
        return not consonant(w, i)

    def m(w):
        return sum(vowel(w, i) and consonant(w, i + 1) for i in range(len(w)))

    def has_vowel(w):
        return any(vowel(w, i) for i in range(len(w)))

    def cvc(w):
        n = len(w)
        ends = n > 2 and consonant(w, n - 1) and vowel(w, n - 2) and consonant(w, n - 3)
        return ends and w[-2] not in "wxy"

    def double(w):
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def apply(w, rules, keep=lambda t, s: True):
        for suffix, new in map(st.rule, rules):
            t = w[: len(w) - len(suffix)]
            if w.endswith(suffix) and keep(t, suffix):
                return t + new
        return w

    w = apply(word.lower(), st.STEP_1A)
    cut = apply(w, ["ed -", "ing -"], lambda t, s: has_vowel(t))
    if cut.endswith("-"):
        w = cut[:-1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    w = apply(w, ["y i"], lambda t, s: has_vowel(t))
    w = apply(w, st.STEP_2, lambda t, s: m(t) > 0)
    w = apply(w, st.STEP_3, lambda t, s: m(t) > 0)
    w = apply(w, st.STEP_4, lambda t, s: m(t) > 1 and (s != "ion" or t.endswith(("s", "t"))))
    t = w[:-1]
    if w.endswith("e") and (m(t) > 1 or (m(t) == 1 and not cvc(t))):
        w = t
    return w[:-1] if w.endswith("ll") and m(w) > 1 else w


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def words_of(df, column="token"):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Don't stop!", ["Don", "t", "stop"]),
        ("U.S.A. café 42x", ["U", "S", "A", "caf", "x"]),
        ("", []),
        ("123 !", []),
        (None, []),
        ("a_b\ncKd", ["a", "b", "c", "d"]),
    ],
)
def test_tokenize(spark, text, tokens):
    assert words_of(tk.tokenize(texts(spark, text))) == tokens


def test_tokenize_keeps_abbreviations(spark):
    df = texts(spark, "U.S.A. rocks, e.g. a. b")
    assert words_of(tk.tokenize_abbrev(df)) == ["U.S.A.", "rocks", "e.g.", "a", "b"]


def test_tokenize_with_a_composite_key(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tokens = tk.tokenize(turns, ["conv_id", "turn"])
    assert tokens.columns == ["conv_id", "turn", "token"]
    want = sum(len(re.findall("[a-zA-Z]+", r.text)) for r in turns.collect())
    assert tokens.count() == want


def test_stop_word_list():
    assert len(STOP_WORDS) == 559
    assert sum("'" in w for w in STOP_WORDS) == 57
    assert {"a", "a's", "thanx", "wherever", "zero", "new", "don't"} <= STOP_WORDS
    assert not {"don", "news", "thank's", ""} & STOP_WORDS


def test_clean_tokens(spark):
    raw = ["The", "Running", "don", "t", "news", "new", "a" * 33, "b" * 32, "wherever"]
    df = spark.createDataFrame([(1, t) for t in raw], "doc_id long, token string")
    assert words_of(tk.clean_tokens(df)) == ["running", "don", "t", "news", "b" * 32]
    own = spark.createDataFrame([("news",), ("t",), ("t",)], "token string")
    assert "news" not in words_of(tk.clean_tokens(df, own))
    assert "the" in words_of(tk.clean_tokens(df, ["don"]))


def test_stems(spark):
    df = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2], strict=True)), "w string, s string")
    assert df.where(porter_stem(F.col("w")) != F.col("s")).collect() == []
    assert all(slow_stem(w) == s for w, s in zip(STEMS[::2], STEMS[1::2], strict=True))


def test_stems_equal_a_slow_stemmer(spark, documents):
    odd = ["yyy", "syzygy", "xyyb", "ayy", "yybed", "y", "a", "ll", "controll", "can't", "éclair"]
    vocabulary = tk.stem_vocabulary(
        tk.tokenize(documents).union(spark.createDataFrame([(0, w) for w in odd]))
    )
    rows = vocabulary.collect()
    assert len(rows) > 5000
    assert [(r.token, r.stem) for r in rows if slow_stem(r.token) != r.stem] == []


@pytest.mark.parametrize("max_rows, share", [(100, 1), (0, 1), (0, 50), (0, 10**9)])
def test_preprocess_chain(spark, max_rows, share, monkeypatch):
    real = tk.broadcast_if_small
    monkeypatch.setattr(tk, "broadcast_if_small", lambda df: real(df, max_rows * 100))
    monkeypatch.setattr(tk.stem_memo, "__defaults__", (share,))
    df = texts(
        spark, "The running cats", "don t", "news new", "feed", "electroencephalograms", "a" * 33
    )
    out = tk.preprocess_tokens(tk.clean_tokens(tk.tokenize(df)))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.stem)
    assert {d: sorted(s) for d, s in got.items()} == {0: ["cat", "run"], 1: ["don"], 2: ["new"]}


def test_memo_is_bounded_and_exact(spark, documents):
    stemmed = tk.stem_vocabulary(tk.clean_tokens(tk.tokenize(documents))).cache()
    total = stemmed.agg(F.sum("n")).first()[0]
    memo = tk.stem_memo(stemmed, 200)
    assert 0 < memo.count() < 200
    assert memo.count() == stemmed.where(F.col("n") * 200 > total).count()


# Examples of Porter (1980), and words that the default variant stems in another way.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv
allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun
activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll dying dy flying fly fixing fix toyed toi element element""".split()


def test_published_stems(spark):
    df = spark.createDataFrame(list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)), "w string, s string")
    got = df.withColumn("got", porter_stem(F.col("w"), "published"))
    assert got.where("got <> s").collect() == []
    other = df.where(porter_stem(F.col("w")) != F.col("s")).select("w").collect()
    assert {"feed", "dying", "fixing", "element"} <= {r.w for r in other}
    cleaned = spark.createDataFrame([("flying",), ("flying",)], "token string")
    assert tk.stem_vocabulary(cleaned, "published").first().stem == "fly"
    assert tk.stem_vocabulary(cleaned).first().stem == "flying"


def test_stem_counts_shuffle_texts_only(spark, monkeypatch):
    """The counts of a document are made where its text is, by tasks of a bounded size."""
    rows = [(1, "cats running, cat ran"), (1, "cats"), (2, None), (None, "the dogs' dog"), (3, "")]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    cleaned = tk.clean_tokens(tk.tokenize(docs))
    plain = tk.preprocess_tokens(cleaned).groupBy("doc_id", "stem").count().collect()
    assert plain
    for most, parts in ((400_000, 1), (1, 21)):  # 21 tokens that are no stop words
        monkeypatch.setattr(tk, "TASK_TOKENS", most)
        found = tk.stem_counts(docs)
        assert set(map(tuple, found.collect())) == set(map(tuple, plain))
        assert found.columns == ["doc_id", "stem", "n"]
        assert found.rdd.getNumPartitions() == max(parts, spark.sparkContext.defaultParallelism)


def test_query_of_stems_shuffles_no_counts(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["preprocess_tokens"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert exchanges and not any("hashpartitioning(doc_id" in e and "stem" in e for e in exchanges)
