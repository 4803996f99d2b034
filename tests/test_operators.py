"""Operators that SQL does not express, against brute force and fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators.chunking import digest, markdown_sections, pack_paragraphs
from verdigris.operators.evidence import marginal_relevance, set_cover
from verdigris.operators.graph import paths
from verdigris.operators.retrieval import budget_prefix, greedy_pack
from verdigris.sources.files import read_case_files, read_files
from verdigris.sources.store import activate, merge_by_source, read_active, sync_actions, unchanged, write_generation
from verdigris.streaming.events import append_documents, idempotency_keys, windowed_counts


def test_greedy_pack_skips_and_goes_on(spark):
    rows = [(1, 1, 10, 5000), (1, 2, 11, 5), (2, 1, 20, 60), (2, 2, 21, 50), (2, 3, 22, 30), (2, 4, 23, 10), (2, 5, 24, 1)]
    got = {r.g: (r.ids, r.used) for r in greedy_pack(spark.createDataFrame(rows, "g int, rank int, id long, cost long"), "g", 100, 4).collect()}
    assert got == {1: ([10], 5000), 2: ([20, 22, 23], 100)}


def test_budget_prefix_stops(spark):
    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 10)], "g int, rank int, cost int")
    assert [r["rank"] for r in budget_prefix(rows, "g", "rank", F.col("cost"), 100).collect()] == [1]


def test_set_cover(spark):
    rows = [(1, 1, 5, ["a", "b"], 1), (1, 2, 1, ["c"], 2), (1, 3, 9, ["a", "b", "c"], 3), (1, 4, 1, ["c"], 4), (2, 5, 1, [], 1)]
    got = set_cover(spark.createDataFrame(rows, "group_id int, id int, cost int, covers array<string>, rank int")).collect()
    assert [(r.group_id, r.id, r.gained) for r in got] == [(1, 3, ["a", "b", "c"])]


def test_marginal_relevance_drops_exhausted_sources(spark):
    rows = [(1, k, "s" if k < 4 else "t", 1.0 - k / 10, ["w%d" % k], k) for k in range(6)]
    got = marginal_relevance(spark.createDataFrame(rows, "group_id int, id int, source string, relevance double, terms array<string>, rank int")).orderBy("position").collect()
    assert [r.id for r in got] == [0, 1, 4, 5]


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("b", "a", 1.0), ("a", "c", 0.4)], "src string, dst string, confidence double")
    got = paths(edges, spark.createDataFrame([("a",)], "node string")).orderBy("rank").collect()
    assert [(r.path, r.confidence) for r in got] == [(["a", "b"], 1.0), (["a", "b", "c"], 0.5), (["a", "c"], 0.4)]


def test_markdown_sections_tile_the_text():
    text = "intro é\n# A\nx\n```\n# not a heading\n```\n## B\ny\n# A\n"
    parts = markdown_sections(text)
    assert "".join(p["display_text"] for p in parts) == text
    assert [(p["heading_path"], p["level"], p["occurrence"]) for p in parts] == [([], 0, 1), (["A"], 1, 1), (["A", "B"], 2, 1), (["A"], 1, 2)]
    assert all(text[p["char_start"] : p["char_end"]] == p["display_text"] for p in parts)
    assert all(text.encode()[p["byte_start"] : p["byte_end"]].decode() == p["display_text"] for p in parts)
    assert markdown_sections("") == []


def test_paragraphs_pack_to_the_size():
    text = "\n\n".join("p%d " % k + "x" * 150 for k in range(20)) + "\n\n" + "y" * 2000
    chunks = pack_paragraphs(text)
    assert all(0 < len(c) <= 900 for c in chunks)  # the size, and the tail of the chunk before
    assert all(any("p%d " % k in c for c in chunks) for k in range(20))
    assert pack_paragraphs("") == []


def test_identity_digest_is_stable():
    assert digest("a", ["é"], 1) == digest("a", ["é"], 1) != digest("a", ["e"], 1)


@pytest.mark.parametrize("a, b, millis", [("a b c d e f", "a b c d e f", 1000), ("", "", 0), ("a b", "a b", 1000), ("a b c d e f", "b c d e f g", 333)])
def test_jaccard(spark, a, b, millis):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.jaccard_millis(T.shingles(F.col("a")), T.shingles(F.col("b")))).first()
    assert row[0] == millis


def test_urls(spark):
    rows = [("HTTP://Docs.Example.com/a/?utm_source=x&b=2&a=1#f", "http://docs.example.com/a/?a=1&b=2", "http://docs.example.com"), ("https://e.com/docs/x/", "https://e.com/docs/x", "https://e.com/docs"), ("https://e.com", "https://e.com/", "https://e.com"), ("ftp://e.com/x", "ftp://e.com/x", None)]
    got = spark.createDataFrame([r[:1] for r in rows], "u string").select("u", T.normalize_url(F.col("u")).alias("n"), T.docset_root(F.col("u")).alias("r")).collect()
    assert [tuple(g) for g in got][1:] == [(r[0], r[1], r[2]) for r in rows][1:]
    assert got[0].n == rows[0][1]


def test_files_and_case_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nx")
    (tmp_path / "b.html").write_text("<html><nav>n</nav><article><p>Hi &amp; bye</p></article></html>")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d.txt").write_text("  ")
    good, bad = read_files(spark, str(tmp_path))
    assert {r.format: r.content for r in good.collect()} == {"md": "# T\nx", "html": "Hi & bye"}
    assert {r.source[-5:]: r.reason for r in bad.collect()} == {"c.bin": "unsupported format", "d.txt": "empty"}
    xml = "<root>" + "".join(f"<case-file><serial-number>{n}</serial-number><case-file-header><status-code>{s}</status-code><filing-date>20240102</filing-date><mark-identification>M</mark-identification></case-file-header></case-file>" for n, s in (("1", "700"), ("2", "900"))) + "</root>"
    (tmp_path / "x.xml").write_text(xml)
    got = read_case_files(spark, str(tmp_path / "x.xml")).collect()
    assert [(r.serial, r.filed) for r in got] == [("1", dt.date(2024, 1, 2))]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", "h1"), ("b", "2", "h2")], "source string, content string, content_hash string")
    new = spark.createDataFrame([("b", "3", "h3"), ("c", "4", "h4")], "source string, content string, content_hash string")
    merged = merge_by_source(old, new)
    assert sorted((r.source, r.content) for r in merged.collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert unchanged(old, merged).count() == 1
    write_generation(merged, str(tmp_path), 9)
    activate(spark, str(tmp_path), 9)
    write_generation(merged.limit(1), str(tmp_path), 10)  # not active yet
    assert read_active(spark, str(tmp_path)).count() == 3
    activate(spark, str(tmp_path), 10)
    assert read_active(spark, str(tmp_path)).count() == 1
    ids = lambda d: d.select(F.col("source").alias("id"), "content_hash")
    assert {r.id: r.action for r in sync_actions(ids(merged), ids(old)).collect()} == {"a": "skip", "b": "upsert", "c": "upsert"}


def test_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([("k", at(0)), ("k", at(50)), ("k", at(99)), ("k", at(100)), ("j", at(3))], "fingerprint string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fingerprint string, ts timestamp").parquet(str(tmp_path / "in"))
    q = idempotency_keys(stream, 100).writeStream.format("memory").queryName("keys").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.fingerprint, r.reused) for r in spark.table("keys").collect()) == [("j", False), ("k", False), ("k", False), ("k", True), ("k", True)]
    docs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "source string, content string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    append_documents(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    counted = windowed_counts(events)
    assert counted.agg(F.sum("n")).first()[0] == events.count()


def test_entry_without_the_training_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
