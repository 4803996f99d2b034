"""The library's life: create, add, replace, query, remove, ingest."""

from pyspark.sql import functions as F

from verdigris.engine import Library, format_context


def test_library(spark, tmp_path):
    lib = Library.create(spark, str(tmp_path / "lib"), buckets=2)
    assert lib.stats().first().asDict() == {"sources": 0, "tokens": 0, "chunks": 0, "oversize": 0}
    assert lib.query("nothing").count() == 0
    guide = "# Guide\n\n## Setup token\n\nCreate the token in the console.\n\n## Other\n\nNothing about it.\n"
    docs = [("a.md", guide), ("b.md", "# Notes\n\nThe console is old.\n"), ("c.md", guide), ("d.md", None), (None, "x"), ("e.md", " ")]
    lib.add(spark.createDataFrame(docs, "source string, content string"))
    first = {r.child_id for r in lib.chunks().collect()}
    assert lib.stats().first().sources == 3 and lib.duplicates().first().copies == 2
    got = lib.query("create the token", limit=3, expand="none").collect()
    assert [r.position for r in got] == list(range(len(got))) and "Create the token" in got[0].text and got[0].score == 1.0
    assert len({r.text for r in got}) == len(got)  # the copy in c.md is dropped
    assert all("console" in r.text for r in lib.query("token zebra", expand="none").collect())  # no chunk has both: any will do
    assert lib.query("zebra").count() == 0
    lib.add(spark.createDataFrame([("b.md", "# Notes\n\nNew words.\n"), ("a.md", guide)], "source string, content string"))
    now = {r.id: r.child_id for r in lib.chunks().collect()}
    assert lib.query("old console notes").where("text like '%old%'").count() == 0 and now["a.md"] in first and now["b.md"] not in first
    lib.remove(F.col("source") == "c.md")
    assert lib.stats().first().sources == 2 and lib.chunks().where("id = 'c.md'").count() == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("# Zebra\n\nStripes.\n")
    (tmp_path / "in" / "y.bin").write_text("?")
    assert [r.source.rsplit("/", 1)[-1] for r in lib.ingest(str(tmp_path / "in")).collect()] == ["y.bin"]
    assert lib.query("zebra stripes").first().source.endswith("x.md")


def test_search_expands_and_packs(spark, tmp_path):
    lib = Library.create(spark, str(tmp_path / "lib"), buckets=2)
    parts = "\n\n".join(f"Paragraph {k} " + ("needle " if k == 5 else "") + "word " * 80 for k in range(10))
    lib.add(spark.createDataFrame([("long.md", "# Long\n\n" + parts)], "source string, content string"))
    near = lib.query("needle", expand="adjacent", budget=10_000).collect()
    anchor = next(r for r in near if "needle" in r.text)
    assert near[0].child_id == anchor.child_id and {r.ordinal for r in near} == {anchor.ordinal - 1, anchor.ordinal, anchor.ordinal + 1}
    assert len(lib.query("needle", expand="adjacent", budget=1).collect()) == 1  # the first stays, whatever the budget
    many = lib.query_many(spark.createDataFrame([(1, "needle"), (2, "word")], "query_id int, text string"), budget=300)
    assert all(r.packed_tokens <= 300 for r in many.collect())
    saved = lib.savings(many).where("query_id = 1").first()
    assert saved.raw > saved.packed and saved.percent > 0
    texts = {r.query_id: r.context for r in format_context(many, "xml").collect()}
    assert texts[1].startswith('<document source="long.md">')
