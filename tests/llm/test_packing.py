import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from topicloom.llm import packing
from topicloom.session import ship_package

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def check(pieces, texts, length=packing.LENGTH):
    """Every id lies in one piece, and sequences are gapless and full but for the last."""
    tokenizer = Tokenizer.from_file(PATH)
    encoded = tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False)
    ids = {i: np.array([*e.ids, 1], "<u4") for (i, _), e in zip(texts, encoded)}
    parts, lines = {}, {}
    for p in pieces:
        whole = ids[p.doc_id]
        piece = whole[p.start : p.start + p.length]
        assert len(piece) == p.length and p.doc_tokens == len(whole)
        assert zlib.crc32(piece.tobytes()) == p.ids_crc32
        parts.setdefault(p.doc_id, []).append((p.start, p.length))
        lines.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans, goal in [(parts[i], len(w)) for i, w in ids.items()] + [(s, None) for s in lines.values()]:
        end = 0
        for start, size in sorted(spans):
            assert start == end
            end += size
        assert end == goal if goal is not None else end <= length
    assert sorted(lines) == list(range(len(lines)))
    short = [k for k, s in lines.items() if sum(n for _, n in s) < length]
    assert short in ([], [len(lines) - 1])


def test_odd_texts(spark, definition):
    texts = [
        (1, None), (2, ""), (3, "Word, word. WORD... don't <|ENDOFTEXT|> <|endoftext|>. x."),
        (4, "é É  ŐÀ 漢字 1234 a.b,c \x1c\x85 a b"), (5, "the loser, " * 30_000), (6, "a" * 5000),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'x' AS uid", "1 AS n")
    pieces = packing.pack(docs, definition)
    check(pieces.collect(), texts)
    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(len(s.ids) == 4 * s.n for s in whole)
    assert packing.pack(docs.where("false"), definition).collect() == []


def test_repeated_and_null_ids(spark, definition):
    docs = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "c")], "doc_id long, text string")
    pieces = packing.pack(docs, definition, length=4).collect()
    assert sum(p.length for p in pieces) == 3 + 3 + 2
    assert {p.doc_id for p in pieces} == {7, None}


def test_documents(spark, documents, definition):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    check(packing.pack(documents, definition).collect(), texts)


def test_curve_neighbours_are_near():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_every_letter_before_stops(spark):
    """All assigned letters, marks and numbers before and after full stops and commas."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, definition = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    encoder = packing.Encoder(definition, 1)
    texts = [
        f"ab{c}. {c}, c{c}.d {c}' T.{c}." for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LMN"
    ]
    rng = random.Random(1)
    pool = "İaZé.,' \u0958\u09dc\u09a2\u09bc\u0b5cŉǰßﬁ①2ﬀ가\u1100\u1161\u0301\u0327"
    texts += ["T.C. İ.Ö. 500"] + ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(20_000)]
    for a in range(0, len(texts), 8192):
        part = texts[a : a + 8192]
        ids, ends = encoder.encode([t.encode() for t in part])
        for i, want in enumerate(tokenizer.encode_batch(part, add_special_tokens=False)):
            assert ids[ends[i] : ends[i + 1]].tolist() == want.ids + [1], part[i]


def test_memory_of_a_worker_is_bounded(definition):
    """Words are learnt in turns, and the memo forgets, without a change of the ids."""
    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer, self.most = tokenizer, 0

        def encode_batch_fast(self, words, **options):
            self.most = max(self.most, len(words))
            return self.tokenizer.encode_batch_fast(words, **options)

    encoder = packing.Encoder(definition, 1)
    whole = encoder.tokenizer
    encoder.tokenizer = Watched(whole)
    for turn in range(10):
        text = " ".join(f"x{turn}y{i}" for i in range(30_000))
        ids, edges = encoder.encode([text.encode()])
        assert ids.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]
        assert len(encoder.known) + len(encoder.before) <= 270_000
    assert 0 < encoder.tokenizer.most <= 2_000


def test_workers_get_small_batches(spark):
    """A worker holds some megabytes of rows at once, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    own.conf.set(name, str(50 * 2**20))
    for session, found in ((spark.newSession(), range(4, 9)), (own, range(1, 2))):
        ship_package(session)
        rows = session.range(0, 8, numPartitions=1).selectExpr("repeat('a', 3 * 1024 * 1024) AS text")
        sizes = rows.mapInArrow(
            lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"
        ).collect()
        assert len(sizes) in found and sum(r.n for r in sizes) == 8


def test_the_driver_lets_go_of_the_tokenizer(spark):
    with open(PATH, encoding="utf-8") as file:
        definition = file.read() + "\n"  # one that no other test has asked for
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    packing._tokenizer.cache_clear()
    rows = packing.tokenised(docs, "doc_id", "text", definition, 1)
    assert packing._tokenizer.cache_info().currsize == 0
    assert sorted(r.n for r in rows.select("n").collect())[0] == 1
