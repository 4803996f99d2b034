"""Case files in plain, gzipped and zipped files: the same rows, and broken ones counted."""

import gzip
import io
import zipfile

import pytest

from verdigris.plans import code_queries
from verdigris.sources import archives as A

GOOD = """<case-file><serial-number>7</serial-number><case-file-header><filing-date>20200131</filing-date><registration-date>bad</registration-date><status-code>700</status-code><mark-identification> MARK é </mark-identification></case-file-header>
<classifications><classification><international-code>009</international-code><us-code-list><us-code>021</us-code><us-code> </us-code></us-code-list><first-use-anywhere-date>20190101</first-use-anywhere-date></classification></classifications>
<case-file-statements><case-file-statement><type-code>GS0091</type-code><text>any</text></case-file-statement><case-file-statement><type-code>GS009</type-code><text>one</text></case-file-statement><case-file-statement><type-code>GS009</type-code><text>two</text></case-file-statement><case-file-statement><type-code>D0</type-code><text>no</text></case-file-statement></case-file-statements>
<case-file-owners><case-file-owner><party-name>Ann</party-name><nationality><country>FR</country></nationality></case-file-owner><case-file-owner><party-type>20</party-type></case-file-owner></case-file-owners>
<design-searches><design-search><design-search-code>010203</design-search-code></design-search></design-searches></case-file>"""
DEAD = "<case-file ><serial-number>8</serial-number><case-file-header><status-code>602x</status-code></case-file-header></case-file>"
TEXT = f'<?xml version="1.0"?><all><case-files>{GOOD}<case-file><serial-number>1</serial-number><a></case-file>{DEAD}<case-file><b></b></case-file><case-file><serial-number>2</serial-number>{GOOD.replace(">7<", ">9<")}</case-files></all><case-file><serial-number>3'
WANT = [(0, None, "7"), (1, "not well-formed", None), (2, None, "8"), (3, "no serial number", None), (4, "no end tag", None), (5, None, "9"), (6, "no end tag", None)]


def files(folder):
    data = TEXT.encode()
    (folder / "plain.xml").write_bytes(data)
    (folder / "packed.xml.gz").write_bytes(gzip.compress(data))
    (folder / "deep").mkdir()
    with zipfile.ZipFile(folder / "deep" / "both.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/a.xml", data)
        z.writestr("b.XML", data)
        z.writestr("readme.txt", "no")
    (folder / "note.txt").write_text(GOOD)


def test_all_forms_give_the_same_rows(spark, tmp_path):
    files(tmp_path)
    spark.dataSource.register(A.CaseFiles)
    rows = spark.read.format("case_files").load(str(tmp_path)).collect()
    of = {}
    for r in rows:
        of.setdefault((r.source.rsplit("/", 1)[-1], r.entry), []).append(r)
    assert sorted(of) == [("both.zip", "b.XML"), ("both.zip", "in/a.xml"), ("packed.xml.gz", ""), ("plain.xml", "")]
    for own in of.values():
        own.sort(key=lambda r: r.n)
        assert [(r.n, r.malformed and r.malformed.split(":")[0], r.serial) for r in own] == WANT
    first = of["plain.xml", ""][0]
    assert (first.mark, str(first.filed), first.registered, first.status) == ("MARK é", "2020-01-31", None, 700)
    assert [(c.code, c.us, c.description, str(c.first_use)) for c in first.classes] == [("009", ["021"], "one\ntwo", "2019-01-01"), ("", [], "any", "None")]
    assert [tuple(o) for o in first.owners] == [("Ann", "", None, "FR")]
    assert first.design_codes == ["010203"] and first.prior == []
    assert len({str(own[0].asDict() | {"source": 0, "entry": 0}) for own in of.values()}) == 1


def test_counts_and_live_records(spark, tmp_path):
    files(tmp_path)
    cases, counts = A.read_case_archives(spark, str(tmp_path / "plain.xml"))
    assert sorted(r.serial for r in cases.collect()) == ["7", "9"]
    (c,) = counts.collect()
    assert (c.parsed, c.emitted, c.dead, c.malformed) == (7, 2, 1, 4)
    assert A.read_case_archives(spark, f"file://{tmp_path}/deep", live_only=False)[0].count() == 6
    with pytest.raises(Exception, match="FileNotFound"):
        A.read_case_archives(spark, str(tmp_path / "none"))


def test_broken_archives_are_rows(spark, tmp_path):
    (tmp_path / "cut.gz").write_bytes(gzip.compress(TEXT.encode() * 50)[:-20])
    (tmp_path / "no.zip").write_bytes(b"no zip")
    (tmp_path / "empty.xml").write_bytes(b"")
    _, counts = A.read_case_archives(spark, str(tmp_path))
    got = {r.source.rsplit("/", 1)[-1]: r for r in counts.collect()}
    assert got["no.zip"].malformed == 1
    assert got["cut.gz"].malformed >= 1
    assert set(got) == {"cut.gz", "no.zip"}


def test_records_over_chunk_edges(monkeypatch):
    whole = [(r, w) for r, w in A.cut(io.BytesIO(TEXT.encode()))]
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(A, "CHUNK", size)
        assert list(A.cut(io.BytesIO(TEXT.encode()))) == whole
    monkeypatch.setattr(A, "CHUNK", 16)
    long = b"<case-file>" + b"x" * 1000 + b"</case-file><case-file>y</case-file>"
    assert [w for _, w in A.cut(io.BytesIO(long), most=100)] == ["too long", None]


def test_no_archive_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(code_queries, "ARCHIVE_RECORDS", 100, raising=False)
    path = code_queries.order_archives(spark, "/root/testdata/sf0.001")
    _, counts = A.read_case_archives(spark, path)
    rows = counts.collect()
    assert max(r.parsed for r in rows) <= 100
    assert sum(r.parsed for r in rows) == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


@pytest.mark.parametrize(("text", "date"), [("20200229", "2020-02-29"), ("20210229", None), (" 20200131", "2020-01-31"), ("2020131", "2020-01-31"), ("00000101", None), ("", None), (None, None), ("\u0662\u0660200131", None), ("202001311", None)])
def test_dates_read_as_by_their_form(text, date):
    from datetime import datetime

    got = A._date(text)
    try:
        assert got == datetime.strptime((text or "").strip(), "%Y%m%d").date()
    except ValueError:
        assert got is None
    if date:
        assert str(got) == date
