import gzip
import random
import time

import pytest

from topicloom.functions.html import html_to_text
from topicloom.llm.warc_derive import plain_text
from topicloom.operators.pages import damage, page_text, response_pages
from topicloom.plans.corpus import warc_documents
from topicloom.sources import warc


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b", "a b"),
        ("a<b>b</b>c", "abc"),
        ("a<br>b<br/>c", "a b c"),
        ("<head><title>T</title></head><body>x</body>", "x"),
        ("<script>var t='</p>';</script>x<style>p{}</style>", "x"),
        ("<SCRIPT type=a>if (a<b) {}</SCRIPT >x", "x"),
        ("a<!-- <p>no</p> -->b", "ab"),
        ("x<!-- open <p>y", "x"),
        ("x<script>open", "x"),
        ('<a title="a > b">t</a>', "t"),
        ("<p class=a\">t</p>", "t"),
        ("1 < 2 &amp;&lt;b&gt; &copy;&eacute;&#65;&#x42;", "1 < 2 &<b> ©éAB"),
        ("&amp;copy;", "&copy;"),
        ("  a \n\t b  ", "a b"),
        ("<!DOCTYPE html><html><body></body></html>", ""),
        ("<scripty>a</scripty>", "a"),
        ("<p", ""),
        ("", ""),
    ],
)
def test_html_to_text(page, text):
    assert html_to_text(page) == text


def test_only_closed_entities_are_decoded():
    """As page_text's SQL has it: titles are cut in the middle of an entity."""
    for page, text in [
        ("<title>x</title><h1>a &amp</h1>b &&amp&&amp;", "a &amp b &&amp&&"), ("&copyright; &ampfoo; &#65 &#x42;", "&copyright; &ampfoo; &#65 B"),
        ("&notin; &quot;&nosuch;", "\u2209 \"&nosuch;"),
    ]:
        assert html_to_text(page) == plain_text(page) == text
    assert html_to_text("&a" * 200_000) == "&a" * 200_000


@pytest.mark.parametrize("broken", ["<!--", "<script>", "<a b='", "<a ", "</", "<p>", "&", "<a =\""])
def test_time_is_linear_in_broken_pages(broken):
    began = time.time()
    html_to_text(broken * 200_000)
    assert time.time() - began < 5


def test_page_text_reads_whole_pages(spark):
    long_page = "<p>" + "word " * 1_000_000 + "<b>end</b>"
    df = spark.createDataFrame([(1, long_page), (2, None)], "page_id long, html string")
    rows = {r.page_id: r for r in page_text(df).collect()}
    assert rows[1].text.endswith("word end") and len(rows[1].text) == 5_000_003
    assert rows[2].text == "" and rows[2].error is None


def record(kind, ident, payload, trec=True):
    lines = ["WARC/1.0"]
    if kind:
        lines.append(f"WARC-Type: {kind}")
    lines.append(f"WARC-Record-ID: <urn:{ident}>")
    if trec:
        lines.append(f"warc-trec-id: {ident}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"


@pytest.fixture()
def archive(tmp_path):
    tricky = "<p>é\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n</p>".encode()
    records = [
        record("warcinfo", "i", b"software: x"),
        record("response", "d1", HTTP + tricky),
        record("request", "d1", b"GET / HTTP/1.1\r\n\r\n"),
        record(None, "n", b"zz"),
        record("response", "d2", b"<p>no http \xff header", trec=False),
        record("response", "d3", HTTP),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    return tmp_path


@pytest.mark.parametrize("reader", [warc.warc_from_files, warc.warc_from_hadoop])
def test_warc_readers(spark, archive, reader):
    rows = reader(spark, str(archive)).collect()
    assert len(rows) == 12
    for name in ("a.warc", "b.warc.gz"):
        mine = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.record_no)
        assert [r.warc_type for r in mine] == [
            "warcinfo", "response", "request", None, "response", "response",
        ]
        assert [r.record_no for r in mine] == list(range(6))
        assert mine[3].payload == b"zz" and mine[3].error is None
        assert mine[1].headers["WARC-Record-ID"] == "<urn:d1>"
    pages = response_pages(reader(spark, str(archive), "response")).collect()
    got = sorted((p.page_id, p.html) for p in pages)
    tricky = "<p>é\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n</p>"
    one = [("<urn:d2>", "<p>no http � header"), ("d1", tricky), ("d3", "")]
    assert got == sorted(one * 2)


def test_scheme_dispatch(spark, archive, monkeypatch):
    called = []
    monkeypatch.setattr(warc, "warc_from_hadoop", lambda *a: called.append("hadoop"))
    monkeypatch.setattr(warc, "warc_from_files", lambda *a: called.append("files"))
    warc.read_warc(spark, "hdfs://nn/data")
    warc.read_warc(spark, str(archive))
    assert called == ["hadoop", "files"]


def test_file_uri_and_glob(spark, archive):
    assert warc.read_warc(spark, f"file://{archive}").count() == 12
    assert warc.read_warc(spark, f"{archive}/*.warc").count() == 6
    assert warc.read_warc(spark, f"file://{archive}/*.warc").count() == 6
    assert warc.read_warc(spark, f"file://{archive}/s?[a-b]/*").count() == 6
    assert warc.read_warc(spark, f"file://{archive}", partitions=1).rdd.getNumPartitions() == 1


def test_records_without_ids_stay_apart(spark, tmp_path):
    bare = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\n<p>x\r\n\r\n"
    (tmp_path / "bare.warc").write_bytes(bare * 3)
    pages = response_pages(warc.read_warc(spark, str(tmp_path), "response")).collect()
    assert sorted(p.page_id.rsplit("/", 1)[1] for p in pages) == [f"bare.warc#{i}" for i in range(3)]


def test_a_type_filter_keeps_damage(spark, tmp_path):
    good = record("response", "d1", b"<p>x")
    (tmp_path / "cut.warc").write_bytes(good + record("response", "d2", b"y" * 100)[:-60])
    assert damage(warc.read_warc(spark, str(tmp_path), "response")).count() == 1
    documents, errors = warc_documents(spark, str(tmp_path))
    assert [r.text for r in documents.collect()] == ["x"]
    assert [r.error for r in errors.collect()] == ["record is cut short"]


def test_damaged_files_keep_their_good_records(spark, tmp_path):
    good = record("response", "d1", b"<p>x")
    (tmp_path / "cut.warc").write_bytes(good + record("response", "d2", b"y" * 100)[:-60])
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good)[:-12])
    (tmp_path / "junk.warc").write_bytes(b"not a record\n" + b"WARC/1.0\r\nA: b\r\n\r\n" + good)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.path.rsplit("/", 1)[1], []).append((r.warc_type, r.error is not None))
    assert by_file["cut.warc"] == [("response", False), (None, True)]
    assert by_file["cut.warc.gz"][0] == ("response", False)
    assert by_file["cut.warc.gz"][-1] == (None, True)
    assert by_file["junk.warc"] == [(None, True), ("response", False)]


def members(n, rng):
    """Gzipped records one a member, some with a member head or a record in the payload."""
    packed = []
    for i in range(n):
        noise = bytes(rng.randrange(256) for _ in range(rng.choice([10, 3000, 90_000])))
        inner = gzip.compress(b"not a record") + gzip.compress(record("request", "fake", b"x")) if i % 3 == 0 else b""
        # Stored without compression, so that heads in the payload can be seen in the file.
        packed.append(gzip.compress(record("response", f"d{i}", inner + noise), compresslevel=9))
    return packed


@pytest.mark.parametrize("split", [1000, 50_000, 400_000])
def test_ranges_of_a_gzipped_archive_equal_one_task(spark, tmp_path, split):
    rng = random.Random(split)
    packed = members(30, rng)
    (tmp_path / "many.warc.gz").write_bytes(b"".join(packed))
    # Members that go on with a record, zero padding, and a file that is one member.
    whole = b"".join(record("response", f"s{i}", b"y" * 700) for i in range(40))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(gzip.compress(whole[a : a + 999]) for a in range(0, len(whole), 999)) + b"\0" * 2000)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "plain.warc").write_bytes(whole)
    one = warc.warc_from_files(spark, str(tmp_path), split_bytes=2**30)
    cut = warc.warc_from_files(spark, str(tmp_path), split_bytes=split)
    columns = ["path", "record_id", "payload", "error"]
    want = sorted(one.select(*columns).collect(), key=repr)
    assert sorted(cut.select(*columns).collect(), key=repr) == want and len(want) == 30 + 3 * 40
    assert cut.select("path", "record_no").distinct().count() == len(want)
    if split < 50_000:
        tasks = cut.where("path LIKE '%many%'").selectExpr("spark_partition_id() AS p").distinct().count()
        assert cut.rdd.getNumPartitions() > 30 and tasks > 5


def test_filters_are_settled_by_the_reader(spark, archive):
    """The same rows with and without the setting; pushed filters leave the plan."""
    records = warc.warc_from_files(spark, str(archive))
    asked = [
        "warc_type = 'response'", "warc_type = 'response' AND error IS NULL", "target_uri = 'x'",
        "warc_type IN ('request', 'warcinfo')", "warc_type = 'response' AND warc_type = 'request'",
    ]
    want = [sorted(records.where(a).collect(), key=repr) for a in asked]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        records = warc.warc_from_files(spark, str(archive))
        plan = records.where(asked[0])._jdf.queryExecution().executedPlan().toString()
        assert "= response" not in plan and "BatchScan" in plan
        assert [sorted(records.where(a).collect(), key=repr) for a in asked] == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    heads = warc.warc_from_files(spark, str(archive), payloads=False).collect()
    assert len(heads) == 12 and all(r.payload is None and r.headers for r in heads)
