"""Document readers, dependency files and sitemaps on small fixtures."""

import json
import zipfile

from verdigris.operators.children import children, size_of
from verdigris.sources.documents import read_documents
from verdigris.sources.files import case_file_documents, read_files
from verdigris.sources.locks import dependencies, project_files, read_sitemap

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_office_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H3"><w:name w:val="heading 3"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H3"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.rtf").write_text(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\gen x;}First \b bold\b0  caf\'e9\par\par Second \u1078?\{x\}}")
    (tmp_path / "c.docx").write_text("no archive")
    good, bad = read_documents(spark, str(tmp_path))
    got = {r.source.rsplit("/", 1)[-1]: r.content for r in good.collect()}
    assert got == {"a.docx": "### Title\n\none two", "b.rtf": "First bold café\n\nSecond ж{x}"}
    assert [r.source.rsplit("/", 1)[-1] for r in bad.collect()] == ["c.docx"]


def test_dependencies(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("Cargo.lock", 'version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.2"\n\n[[package]]\nname = "libc"\nversion = "0.2.1"\n')
    put("Cargo.toml", '[package]\nname = "x"\n\n[dependencies]\nserde = { version = "1", features = ["a"] }\nrand = "=0.8.5"\n\n[dev-dependencies]\nlibc = "0.2"\n')
    put("package.json", json.dumps({"dependencies": {"@a/b": "^1.0.0"}, "devDependencies": {"jest": "29.0.1"}}))
    put("package-lock.json", json.dumps({"packages": {"": {"version": "9"}, "node_modules/@a/b": {"version": "1.2.3"}}}))
    put("requirements.txt", "# c\nRuamel_Yaml==0.18.1\nnumpy>=1.2 ; python_version>'3'\n")
    put("poetry.lock", '[[package]]\nname = "ruamel.yaml"\nversion = "0.18.2"\n')
    put("pubspec.yaml", "name: x\ndependencies:\n  http: ^1.0.0\ndev_dependencies:\n  test: any\n")
    put("pubspec.lock", 'packages:\n  http:\n    dependency: "direct main"\n    source: hosted\n    version: "1.1.0"\n')
    put("go.mod", "module example.com/x\n\ngo 1.22\n\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/net v0.1.0 // indirect\n)\n")
    got = {(r.ecosystem, r.name): (r.group, r.wish, r.resolved, r.version_source) for r in dependencies(project_files(spark, str(tmp_path))).collect()}
    assert got == {
        ("rust", "serde"): ("dependencies", "1", "1.0.2", "lockfile_exact"),
        ("rust", "rand"): ("dependencies", "=0.8.5", None, "manifest_exact"),
        ("rust", "libc"): ("dev", "0.2", "0.2.1", "lockfile_exact"),
        ("node", "@a/b"): ("dependencies", "^1.0.0", "1.2.3", "lockfile_exact"),
        ("node", "jest"): ("dev", "29.0.1", None, "manifest_exact"),
        ("python", "ruamel-yaml"): ("dependencies", "==0.18.1", "0.18.2", "lockfile_exact"),
        ("python", "numpy"): ("dependencies", ">=1.2", None, "manifest_range"),
        ("dart", "http"): ("dependencies", "^1.0.0", "1.1.0", "lockfile_exact"),
        ("dart", "test"): ("dev", "any", None, "manifest_range"),
        ("go", "github.com/a/b"): ("dependencies", None, "v1.2.3", "lockfile_exact"),
        ("go", "golang.org/x/net"): ("dependencies", None, "v0.1.0", "lockfile_exact"),
    }


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a/x </loc><lastmod>2024-01-02</lastmod><priority>0.5</priority></url><url><loc>https://a/y</loc></url><url><loc></loc></url></urlset>")
    got = sorted((r.loc, str(r.lastmod)[:10], r.priority) for r in read_sitemap(spark, str(tmp_path / "s.xml")).collect())
    assert got == [("https://a/x", "2024-01-02", 0.5), ("https://a/y", "None", None)]


def test_children_tile_the_text():
    import random

    rng = random.Random(3)
    bits = ["# A\n", "## B é\n", "a line, with words. And more;\n", "\n", "| a | b |\n", "|--|--|\n", "- item\n", "  more\n", "```py\n", "code()\n", "```\n", "~~~\n", "ж" * 300 + " " + "x, " * 900 + "\n", "a" * 5000]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        got = list(children(text, "doc"))
        assert "".join(c["display_text"] for c in got) == text
        assert all(text.encode()[c["byte_start"] : c["byte_end"]].decode() == c["display_text"] == text[c["char_start"] : c["char_end"]] for c in got)
        assert all(c["fits"] and size_of(c["search_text"]) == c["search_tokens"] <= 512 for c in got)
        assert len({c["child_id"] for c in got}) == len(got)


def test_children_repeat_what_they_were_cut_from():
    code = list(children("```py\n" + "line = 1\n" * 300 + "```\n", "doc"))
    assert len(code) > 1 and all("```py\n" in c["search_text"] and c["search_text"].rstrip().endswith("```") for c in code)
    rows = list(children("|a|b|\n|-|-|\n" + "|1|2|\n" * 500, "doc"))
    assert len(rows) > 1 and all("|a|b|\n|-|-|\n" in c["search_text"] for c in rows)


def test_files_are_chosen_and_titled(spark, tmp_path):
    for name, body in {"a.md": b"---\nlang: en\ntitle: 'Front'\n---\n# Heading\ntext", "b.md": b"intro\n## Second  \ntext", "sub/c.txt": "caf\u00e9".encode("latin-1"), "sub/d.html": b"<title>Page</title><p>x", "node_modules/e.md": b"# no", "f.md": b" "}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    good, left = read_files(spark, str(tmp_path), exclude=["node_modules"])
    got = {r.source.rsplit("/", 1)[-1]: r for r in good.collect()}
    assert {n: r.title for n, r in got.items()} == {"a.md": "Front", "b.md": "Second", "c.txt": None, "d.html": "Page"} and got["c.txt"].content == "caf\u00e9"
    assert [(r.source.rsplit("/", 1)[-1], r.reason) for r in left.collect()] == [("f.md", "empty")]
    again, left = read_files(spark, str(tmp_path), include=["*.md", "sub/**/*.txt"], exclude=["node_modules"], formats=["md", "txt"], known=good.where("format = 'md'"))
    assert [r.source.rsplit("/", 1)[-1] for r in again.collect()] == ["c.txt"] and sorted(r.reason for r in left.collect()) == ["empty", "unchanged", "unchanged"]
    cases = spark.createDataFrame([("7", "MARK", 700, True, None, ["9", "25"], ["Ann"])], "serial string, mark string, status int, live boolean, filed date, classes array<string>, owners array<string>")
    assert case_file_documents(cases).first().content == "# MARK\n- Serial number: 7\n- Status: 700\n- Classes: 9, 25\n- Owners: Ann"
