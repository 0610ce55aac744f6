"""Operators beside plain brute force, on whole small tables and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from compare import compare, duck
from tokenizers import Tokenizer

from topicloom.functions.html import html_to_text
from topicloom.llm import ann, decontaminate, phrases, queries, quotes, token_count, warc_derive
from topicloom.sources import warc

SPACE = r"[^\x20\x09-\x0D]+"


def frame(spark, rows, extra="'x' AS id, 'y' AS row, 1 AS uid, 2 AS block, 3 AS n_words"):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *extra.split(", "))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, name):
    sql = queries.oracle_sql()[name]
    count, problem = compare(spark, duck(sf_dir), sf_dir, queries.queries()[name], sql)
    assert problem is None and count > 0


# Token counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_token_counts(spark, documents, name):
    rng = random.Random(3)
    letters = " \n\t\r'sdtlm<|endoftext|>aé  漢字1²٣_=-🙂\x1c\x85​"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    odd += ["a" * 4000, "=" * 3333, " " * 999, "<|endoftext|>" * 3, "\n\n a", "word " * 40_000]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + i, t) for i, t in enumerate(odd)]
    rows += [(1, None), (None, ""), (7, "same"), (7, "same")]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = name.endswith("tiktoken")
    encoded = tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    want = sorted(
        (str(i), len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (i, t), e in zip(rows, encoded)
    )
    counted = token_count.token_counts(frame(spark, rows), public_tokenizers.path(name))
    assert sorted((str(r.doc_id), *r[1:]) for r in counted.collect()) == want
    assert token_count.token_counts(frame(spark, rows).where("false"), public_tokenizers.path(name)).isEmpty()


# Repeated phrases


def brute_repeats(texts, window):
    words = [re.findall(SPACE, t or "") for t in texts]
    seen = collections.Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeats_of_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: tuple(r[1:]) for r in phrases.find_repeats(documents).collect()}
    want = brute_repeats([t for _, t in rows], 35)
    assert got == {i: w for (i, _), w in zip(rows, want)}
    assert sum(w[1] for w in want) > 0


def test_repeats_in_odd_texts(spark, monkeypatch):
    """Periodic texts, overlapping passages, copies and short windows, in many automata."""
    monkeypatch.setattr(phrases, "SHARD_CHARS", 50)
    rng = random.Random(9)
    base = [rng.choice(["a", "b", "é", "cc"]) for _ in range(300)]
    texts = [None, "", "und " * 40, "und " * 23, " ".join(base), " ".join(base[50:90]), "a\tb\x0bc\x1cd\x85e f"]
    for _ in range(40):
        start = rng.randrange(280)
        texts.append("x%d " % rng.randrange(9) + "\n".join(base[start : start + rng.randint(1, 30)]))
    texts += [texts[-1], "w " * 30_000]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    got = sorted((str(r.doc_id), *r[1:]) for r in phrases.find_repeats(frame(spark, rows), window=6, phrase=3).collect())
    want = brute_repeats(texts, 6)
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want))
    kept = phrases.without_repeats(frame(spark, rows), window=6, phrase=3)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)
    assert phrases.find_repeats(frame(spark, rows).where("false")).isEmpty()


# Benchmark decontamination


def brute_contamination(docs, items):
    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    windows = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(name))
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def contamination_cases(spark, sf_dir):
    rng = random.Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "one"), (901, "Two three"), (902, None), (903, ""), (904, items[0][1]), (905, "a b " * 30)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(150):
        parts = [rng.choice(items)[1] or "", rng.choice(["one", "x", "two-THREE", "a b a b a"])]
        words = " ".join(rng.sample(parts, 2)).split()
        start = rng.randrange(max(1, len(words)))
        docs.append((5000 + i, " ".join(words[start : start + rng.randint(1, 40)])))
    return docs + [(None, None), (3, ""), (3, ""), (4, "one " * 30_000)], items


@pytest.mark.parametrize("shard_words", [decontaminate.SHARD_WORDS, 300])
def test_contamination(spark, sf_dir, shard_words):
    docs, items = contamination_cases(spark, sf_dir)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, docs), bench, shard_words=shard_words)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
    want = brute_contamination(docs, items)
    assert got == sorted((str(i), *w) for (i, _), w in zip(docs, want))
    kept = decontaminate.decontaminate(frame(spark, docs), bench, shard_words=shard_words)
    assert kept.columns == frame(spark, docs).columns
    assert kept.count() == sum(not w[3] for w in want)


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, [(1, "a b")]), bench).collect()
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in found] == [(2, 0, [], False)]


# Nearest neighbours


def test_neighbours(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    rows += [(9000 + i, rows[20][1]) for i in range(60)]  # copies of a vector that asks
    odd = [(9500, None), (9501, [0.0] * 64), (9502, [float("nan")] * 64), (9503, [1.0]), (None, rows[0][1])]
    odd += [(9504, [None, *rows[0][1][1:]]), (9505, [float("inf"), *rows[0][1][1:]]), rows[3]]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    vectors = vectors.selectExpr("*", "1 AS id", "2 AS node", "3 AS q")
    index = ann.build(vectors, leaf=128)
    asked = vectors.where("vec_id % 20 = 0").selectExpr("vec_id AS id")
    found = collections.defaultdict(dict)
    for r in ann.search_rows(index, asked, 20).collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for query, answers in found.items():
        assert sorted(answers) == list(range(1, 21))
        scores = x @ x[np.flatnonzero(ids == query)[0]]
        exact = dict(zip(ids.tolist(), scores.tolist()))
        order = [(-s, i) for i, s in (answers[r] for r in range(1, 21))]
        assert order == sorted(order) and query not in [i for _, i in order]
        assert all(abs(exact[i] + s) < 1e-9 for s, i in order)
        best = sorted((i for i in exact if i != query), key=lambda i: (-exact[i], i))[:20]
        hits += len(set(best) & {i for _, i in order})
    assert hits >= 0.95 * 20 * len(found)
    outside = ann.search(index, vectors.where("vec_id = 9000"), 5).collect()
    assert sorted(r.vec_id for r in outside) == [20, 9000, 9001, 9002, 9003]


@pytest.mark.parametrize("cosine", [0.9993, 0.9926])
def test_neighbours_in_a_dense_group(spark, cosine):
    """A group of near copies beside strangers: recall against brute force in both."""
    rng = np.random.default_rng(0)
    spread = np.sqrt((1 / cosine - 1) / 64)
    centre = rng.normal(size=64)
    x = np.concatenate([
        rng.normal(size=(700, 64)), centre / np.linalg.norm(centre) + spread * rng.normal(size=(1000, 64))
    ])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in ann.search_rows(ann.build(vectors, leaf=256), spark.range(0, 1700, 20).toDF("id"), 20).collect():
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    products = x @ x.T
    np.fill_diagonal(products, -9)
    for rows in (range(0, 700, 20), range(700, 1700, 20)):
        recall = [len(set(np.argsort(-products[q], kind="stable")[:20]) & found[q]) / 20 for q in rows]
        assert np.mean(recall) >= 0.97


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1.0])], schema)
    found = ann.search_rows(ann.build(two), two.selectExpr("vec_id AS id"), 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 1, 2.0), (1, 1, 0, 2.0)]
    none = spark.createDataFrame([(0, None)], schema)
    assert ann.search_rows(ann.build(none), none.selectExpr("vec_id AS id"), 20).collect() == []


# Archives and conversations


def test_derivatives_of_odd_responses(spark):
    rows = [
        ("<urn:a>", "http://x/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y\r\n\r\n",
         '<html lang="en"><title> A\n b </title><p>t <a href="/u">v</a>'),
        (None, None, None, None, None), (None, None, None, None, None), ("<urn:c>", "", None, "", "w " * 50_000),
    ]
    pages = spark.createDataFrame(rows, "record_id string, target_uri string, date string, http string, html string")
    records = warc_derive.derive(pages.selectExpr("*", "1 AS text", "2 AS block")).collect()
    assert len(records) == 2 * len(rows)
    first = {r.warc_type: r for r in records if r.source_id == "<urn:a>"}
    text, about = first["conversion"], first["metadata"]
    assert text.block == "t v" and text.refers_to == about.refers_to == "<urn:a>"
    assert text.block_digest == "sha256:" + hashlib.sha256(b"t v").hexdigest()
    for line in ("title: A b", "language: en", "source-http: X: y", "outlink: /u",
                 f"conversion-record-id: {text.record_id}"):
        assert line + "\r\n" in about.block
    assert {r.block for r in records if r.target_uri is None and r.warc_type == "conversion"} == {""}
    # The records can be read back as an archive.
    made = warc_derive.as_warc(warc_derive.derive(pages.limit(1))).collect()
    assert all(r.value.startswith("WARC/1.0\r\nWARC-Type: ") for r in made)
    assert all(r.value.split("\r\n\r\n", 1)[1].encode().decode() for r in made)
    undated = warc_derive.as_warc(warc_derive.derive(pages.where("record_id = '<urn:c>'"))).collect()
    assert len(undated) == 2 and all("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in r.value for r in undated)
    assert warc_derive.derive(pages.where("false")).collect() == []


def test_derivatives_keep_the_headers_of_their_source(spark, tmp_path):
    body = "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>one<p>two"
    head = (
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\n"
        "WARC-Date: 2020-02-02T00:00:00Z\r\nWARC-Payload-Digest: sha1:ABC\r\nWARC-Block-Digest: sha1:DEF\r\n"
        f"X-Empty:\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    (tmp_path / "a.warc").write_bytes((head + body + "\r\n\r\n").encode())
    found = warc_derive.responses(warc.read_warc(spark, str(tmp_path / "a.warc")))
    got = {r.warc_type: r for r in warc_derive.derive(found, "headers").collect()}
    about = got["metadata"]
    assert got["conversion"].block == "one two" and about.date == "2020-02-02T00:00:00Z"
    assert about.refers_to == got["conversion"].refers_to == "<urn:uuid:1>"
    for line in ("source-warc: WARC-Payload-Digest: sha1:ABC", "source-warc: WARC-Block-Digest: sha1:DEF",
                 "source-warc: WARC-Date: 2020-02-02T00:00:00Z", "source-http: Server: s"):
        assert line + "\r\n" in about.block
    assert "X-Empty" not in about.block


def test_plain_text_of_broken_pages(spark, sf_dir):
    for page, text in [
        ("", ""), ("a < b &amp; c &lt;d&gt;", "a < b & c <d>"), ("x<b>y</b>z<br>w", "xyz w"),
        ("<a title='>'>t</a><a title=\">\" b=c>u", "tu"), ("a<!-- <p>x</p> -->b<!-->c<!--->d", "abcd"),
        ("a<script>if (a</b) '<p>'</SCRIPT >b<style>x", "a b"), ("<title>no</title>yes<x-y>!</x-y>", "yes!"),
        ("a<!-- open", "a"), ("a<p title='open > b", "a"), ("<", "<"), ("a</>b<?x y?>c<!DOCTYPE html>d", "abcd"),
        ("&am<b>p;", "&amp;"),
    ]:
        assert warc_derive.plain_text(page) == text, page
    for broken in ("<a =" * 100_000, "<!--" * 100_000, "<script>" * 100_000, "<p '" * 100_000, "<" * 400_000):
        warc_derive.plain_text(broken)
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    assert [warc_derive.plain_text(p) for p in pages] == [html_to_text(p) for p in pages]


def test_replies(spark):
    rows = [
        (1, 0, "Shall we meet?\nAt noon."), (1, 1, "> shall  we MEET?\nYes."), (1, 2, "Unrelated."),
        (1, 5, ">> Shall we meet?\n> Yes.\nFine!"), (1, 3000, "> > yes.\n>fine!\nLate."), (2, 0, "> Yes.\nElsewhere"),
        (1, 5, "> At noon.\nTwice the same turn"), (None, 1, "> Yes."), (3, None, "a"), (3, 1, None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "1 AS thread", "2 AS line")
    found = quotes.reply_order(messages).collect()
    got = {(r.conv_id, r.turn, r.text): (r.reply_to, r.thread, r.depth) for r in found}
    assert len(found) == len(rows)
    assert got[1, 1, "Yes."] == (0, 0, 1)
    assert got[1, 2, "Unrelated."] == (None, 2, 0)
    assert got[1, 3000, "Late."][0] == 5 and got[1, 3000, "Late."][1] == 0
    assert got[2, 0, "Elsewhere"] == (None, 0, 0)
    assert got[None, 1, ""] == (None, 1, 0) and got[3, None, "a"] == (None, None, 0)
    assert quotes.reply_order(messages.where("false")).collect() == []


def test_replies_to_passages_wrapped_anew(spark):
    told = [f"w{i}" for i in range(300)]
    wrapped = "\n".join(">> " + " ".join(told[i : i + 7]) for i in range(3, 290, 7))
    rows = [
        (1, 0, "\n".join(" ".join(told[i : i + 11]) for i in range(0, 300, 11))),
        (1, 1, "ok\n\nnever mind this line of words"),
        (1, 2, "> never mind\n>\n> THIS line of words\nA"),
        (1, 3, wrapped + "\n> ok\nB"),
        (1, 4, ">> nothing of the kind was ever said\nC"), (2, 0, "> w0 w1 w2 w3 w4\nD"), (1, 4000, wrapped + "\nF"),
        (1, 5000, " ".join(f"v{i}" for i in range(100_000))),
        (1, 5001, "".join("> " + " ".join(f"v{j}" for j in range(i, i + 5)) + "\r\n" for i in range(500, 600, 5)) + "E"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(messages).collect()}
    assert got[1, 2].reply_to == 1 and got[1, 2].text == "A"
    assert got[1, 3].reply_to == 1 and got[1, 3].text == "B"  # the least nested quote counts
    assert got[1, 3].n_linked >= 2  # pieces of words from the fourth on, and "ok"
    assert got[1, 4000].reply_to == 0 and got[1, 4000].n_linked >= 1
    assert got[1, 4].reply_to is None and got[2, 0].reply_to is None
    assert got[1, 5001].reply_to == 5000 and got[1, 5001].thread == 5000
    assert len(got) == len(rows)


def test_one_line_in_every_message(spark):
    """A line that all write links to the latest before, within and across stretches."""
    messages = spark.range(3000).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 10 = 9, '> so say we all\nI too', 'so say we all') AS text"
    )
    got = quotes.reply_order(messages).where("reply_to is not null").collect()
    assert len(got) == 300 and all(r.reply_to == r.turn - 1 and r.depth == 1 for r in got)


def test_pieces_of_passages():
    found = [(level, [b" ".join(x) for x in lines]) for level, lines in quotes.passages(b"> > A b\n>>\n>>c\nD\n\n> e")]
    assert found == [(2, [b"a b", b"c"]), (0, [b"d"]), (1, [b"e"])]
    words = [f"w{i}".encode() for i in range(200)]
    whole, part = quotes.pieces(1, [words]), quotes.pieces(2, [words[20:90], words[90:170]])
    assert b" ".join(whole).split() == words and b" ".join(part).split() == words[20:170]
    assert 5 < len(part) and set(part[1:-1]) <= set(whole)  # cut alike, but for the ends
    assert quotes.pieces(0, [words[:9], words[9:]]) == [*whole, b" ".join(words[:9]), b" ".join(words[9:])]
    assert quotes.pieces(1, [[b"a"], [b"b"]]) == [b"a b", b"a", b"b"]
