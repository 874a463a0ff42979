import gzip
import io
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import archives, chunking, detect, markup
from quernel.operators import index
from quernel.functions.symbols import doc_above, extract_symbols, qualified_name, symbols, with_module


def one(spark, value, column, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(column.alias("y")).first().y


def test_detection(spark):
    rows = {"a/b.rs": "rust", "x.py": "python", "m.mjs": "javascript", "q.tsx": "typescript", "A.java": "java", "z.R": "r", "z.RS": None, "CMakeLists.txt": "c", "d/BUILD": "python", "Makefile": "c", ".bashrc": None, "noext": None, "a.hh": "cpp"}
    df = spark.createDataFrame([(k,) for k in rows], "path string")
    assert {r.path: r.l for r in df.select("path", detect.language_by_path("path").alias("l")).collect()} == rows
    forms = {"a.md": "markdown", "a.JSON": "json", "a.cfg": "ini", "LICENSE": "text", "Dockerfile": "text", "a.tgz": "gz", "a.unknown": "unknown", "none": "unknown", "x.HTM": "html"}
    df = spark.createDataFrame([(k,) for k in forms], "path string")
    assert {r.path: r.f for r in df.select("path", detect.document_format("path").alias("f")).collect()} == forms
    assert one(spark, "docx", detect.format_tier("x")) == "binary"
    assert one(spark, "#!/usr/bin/env python3\nx", detect.language_by_content("x")) == "python"
    assert one(spark, "#!/usr/bin/env rust-script\n", detect.language_by_content("x")) == "rust"
    assert one(spark, "fn a() -> u8", detect.language_by_content("x")) == "rust"
    assert one(spark, "hello", detect.language_by_content("x")) is None
    assert detect.languages(spark).count() == 20
    with pytest.raises(ValueError):
        detect.languages(spark, ["markdown"])


def test_markdown_cases():
    strip = markup.strip_markdown_text
    assert strip("[x] text") == "x text" and strip("a [open b") == "a open b" and strip("  - item\n+ other") == "item\nother"
    assert strip("[![a](b)](c) d") == " d" and strip("[a](b(c) d") == "a" and strip("  ```py\n```\n   \n") == "  ```py\n   "
    assert strip("##  Head_ing *\r\n~~~\n") == "Heading " and strip("") == ""


def test_code_files_are_no_documents(spark):
    """A file whose path tells a language gives chunks of its symbols only; the others are documents."""
    rows = [("r", "b", "c", p, t) for p, t in (("CMakeLists.txt", "int f(int a) { return a; }\n"), ("Makefile", "all:\n\techo\n"), ("notes.txt", "Some text.\n"), ("a.py", "def f():\n    pass\n"))]
    got = index.chunks(spark.createDataFrame(rows, "repo string, branch string, commit string, path string, content string")).collect()
    assert {(r.file, r.kind) for r in got} == {("CMakeLists.txt", "function"), ("notes.txt", "document"), ("a.py", "function")}


def test_random_ids_and_plain_rows(spark):
    rows = spark.createDataFrame([("r", "b", "c", "a.py", "def f():\n    'Says it.'\n")], "repo string, branch string, commit string, path string, content string")
    found = symbols(rows)
    made = [chunking.symbol_chunks(found, random_ids=k).orderBy("kind").collect() for k in (False, False, True)]
    assert made[0] == made[1] and [r.id for r in made[0]] != [r.id for r in made[2]]
    bare = chunking.symbol_chunks(found, include_docs=False, include_signatures=False).collect()
    assert len(bare) == 1 and bare[0].doc is None and bare[0].signature == "" and bare[0].content_hash == made[0][0].content_hash


def test_markdown(spark):
    text = "# Head\n\n**bold** and *it* [text](http://x/(y)) ![a](u)\n- item\n```py\ncode\n```\n[open\n"
    assert one(spark, text, markup.strip_markdown("x")) == "Head\nbold and it text !a\nitem\ncode\nopen"
    assert markup.strip_links("[a](b(c)d) [e] (f) [g](h") == "a e (f) g"


def test_xml_and_html(spark):
    assert one(spark, "<a b='1'>x</a> &amp; y > z <open", markup.strip_xml("x")) == "x &amp; y  z "
    html = "<html><script>var a = '<b>';</script><style>p{}</style><h1>T</h1><p class='x'>a&nbsp;&amp;lt; b<br>c</p></html>"
    assert one(spark, html, markup.html_text("x")) == "T\na < b\nc"
    assert one(spark, "<p> </p>", markup.html_text("x")) is None


def test_short_and_paragraphs():
    assert chunking.chunk_text_pieces("  \n ") == []
    assert chunking.chunk_text_pieces("a\nb\n") == [("a\nb", 1, 1)]
    text = "\n\n".join(f"paragraph {i} text" for i in range(30))
    got = chunking.chunk_text_pieces(text, 50, 10)
    assert len(got) > 1 and all(len(t.encode()) <= 60 for t, _, _ in got)
    assert all(any(f"paragraph {i} " in t for t, _, _ in got) for i in range(30))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é日\n ", max_size=300), st.integers(12, 60), st.integers(0, 10))
def test_chunks_keep_all_words(text, limit, overlap):
    got = chunking.chunk_text_pieces(text, limit, overlap)
    whole = "".join("".join(t.split()) for t, _, _ in got)
    for word in text.split():
        if len(word.encode()) < limit // 2:
            assert word in whole
    assert all(a >= 1 and b >= a for _, a, b in got)


def test_signature(spark):
    assert one(spark, "\n  \n  first line  \nsecond", chunking.signature("x")) == "first line"
    assert one(spark, "   ", chunking.signature("x")) == "(empty)"
    assert one(spark, "é" * 60, chunking.signature("x")) == "é" * 40 + "..."
    assert one(spark, "a" + "é" * 60, chunking.signature("x")) == "a" + "é" * 39 + "..."
    assert one(spark, None, chunking.signature("x")) is None


def test_document_and_symbol_chunks(spark):
    files = spark.createDataFrame([("r", "b", "c", "a.md", "# T\n\ntext"), ("r", "b", "c", "a.json", '{"a": 1}'), ("r", "b", "c", "a.xlsx", "x"), ("r", "b", "c", "e.txt", ""), ("r", "b", "c", "n.txt", None)], "repo string, branch string, commit string, path string, content string")
    got = {r.file: r for r in chunking.document_chunks(files).collect()}
    assert set(got) == {"a.md", "a.json"} and got["a.md"].language == "markdown" and got["a.md"].code == "T\ntext" and got["a.json"].kind == "document"
    sym = spark.createDataFrame([("r", "b", "c", "f", "function", "m", "f.rs", "f(a)", "fn f(a) {}", "rust", "Adds", 1, 3), ("r", "b", "c", "g", "function", "m", "f.rs", "g()", "fn g() {}", "rust", None, 5, 6)], "repo string, branch string, commit string, name string, kind string, module_path string, file_path string, signature string, code string, language string, doc string, line_start bigint, line_end bigint")
    rows = chunking.symbol_chunks(sym).collect()
    assert sorted(r.kind for r in rows) == ["function", "function", "function_doc"]
    doc = next(r for r in rows if r.kind == "function_doc")
    assert doc.code == "f(a)\nAdds" and doc.end_line == 1 and len({r.id for r in rows}) == 3
    assert [r.content_hash for r in chunking.symbol_chunks(sym).collect()] == [r.content_hash for r in rows]
    assert chunking.symbol_chunks(sym, include_docs=False).count() == 2
    assert chunking.symbol_chunks(sym, compat_language=True).first().language == "unknown"
    text = chunking.symbol_chunks(sym).where("kind = 'function' AND symbol = 'f'").select(chunking.embedding_text("language", "signature", "doc", "code").alias("t")).first().t
    assert text == "[rust] \nf(a)\nAdds\nfn f(a) {}"


SNIPPETS = {
    "javascript": ("function foo(a, b) { return a }\nclass A {\n  bar(x) {\n    return 1;\n  }\n}\n", {"function", "class", "method"}),
    "rust": ("mod m { pub fn f() {} }\nstruct P { x: i32 }\nimpl P { pub fn new() -> Self { P { x: 1 } } }\ntrait T { fn q(&self); }\nenum E { A }\nfn g() {}\n", {"module", "function", "struct", "method", "trait", "enum"}),
    "python": ("class A:\n    def m(self):\n        pass\n\ndef f():\n    pass\n", {"class", "method", "function"}),
    "java": ("public class A {\n  private int x;\n  public A() { }\n  public int get(int a) { return x; }\n}\ninterface I { }\nenum E { X }\n", {"class", "interface", "method", "enum"}),
    "go": ("package a\n\ntype S struct {\n\tA int\n}\n\ntype I interface { M() }\n\nfunc F(a int) int { return 1 }\n", {"struct", "interface", "function"}),
    "kotlin": ("class A(val x: Int) {\n  fun f(a: Int): Int = a\n}\nfun g() {}\n", {"class", "function"}),
    "sql": ("CREATE TABLE users (id INT);\nCREATE FUNCTION f(a INT) RETURNS INT AS $$ SELECT 1 $$ LANGUAGE sql;\n", {"class", "function"}),
    "scala": ("class A { def f(x: Int) = x }\nobject B { }\n", {"class", "function"}),
    "dart": ("class A { void f() {} }\nenum E { a }\n", {"class", "enum"}),
    "lua": ("function f(a)\n  if a then return 1 end\nend\nlocal function g() end\n", {"function"}),
    "r": ("f <- function(x) {\n  x + 1\n}\n", {"function"}),
    "perl": ("package Foo;\nsub bar { return 1; }\n", {"module", "function"}),
    "swift": ("protocol P { func a() }\nfunc f(x: Int) -> Int { return x }\n", {"interface", "function"}),
    "php": ("<?php\nfunction f($a) { return $a; }\nclass A { }\ninterface I { }\n", {"function", "class", "interface"}),
    "ruby": ("class A\n  def m(x)\n    if x\n      1\n    end\n  end\nend\n", {"class", "method"}),
    "bash": ("f() {\n  echo hi\n}\nfunction g { :; }\n", {"function"}),
    "typescript": ("interface I { a: string }\nclass A { m(x: number): string { return '' } }\nexport async function f<T>(a: T): Promise<T> { return a }\n", {"interface", "class", "function"}),
    "c": ("#define N 1\nstruct P { int x; };\nint add(int a, int b) {\n  return a + b;\n}\n", {"struct", "function", "constant"}),
    "cpp": ("class A {\npublic:\n  int m() { return 1; }\n};\nint f(int a) { return a; }\n", {"class", "function"}),
    "csharp": ("namespace N {\n  interface I { }\n  class A { public int M(int a) { return a; } }\n}\n", {"interface", "class", "method", "module"}),
}


@pytest.mark.parametrize("language", SNIPPETS)
def test_symbol_kinds(language):
    text, kinds = SNIPPETS[language]
    got = extract_symbols(text, language)
    assert kinds <= {s["kind"] for s in got}
    assert all(s["name"] and s["line_end"] >= s["line_start"] for s in got)


def test_symbol_fields():
    text = "/// Adds two numbers\npub async fn add(a: i32, b: i32) -> i32 {\n    a + b // } not the end\n}\n"
    (s,) = extract_symbols(text, "rust")
    assert (s["name"], s["signature"], s["line_start"], s["line_end"], s["is_public"], s["is_async"]) == ("add", "add(a: i32, b: i32)", 2, 4, True, True)
    assert "Adds two numbers" in s["doc"] and s["code"].endswith("}")
    assert extract_symbols("def f(:\n", "python") == [] and extract_symbols("x", "cobol") == []
    assert doc_above(["/*", " * one", " * two", " */", "", "fn f() {}"], 5) == "one two"
    assert doc_above(["x = 1", "# a", "# b", "def f(): pass"], 3) == "a b"
    assert doc_above(["// kept out", "// TODO later", "// in", "f"], 3) == "in"
    assert doc_above(["/* one line */", "f"], 1) == "one line"


def test_symbols_of_broken_python():
    text = "class A(B):\n    @p\n    async def m(self):\n        '''Says\nat the margin.\n'''\n        def inner(): pass\n    def n(self)\n        print 'x'\n<<<<<<< a\n    def o(self, x=(1, 2):\n        return x\ndef g(a,\n   b):\n  x = (1\ndef h(): pass\ndef cut():\n"
    found = extract_symbols(text, "python")
    got = [(s["name"], s["kind"], s["line_start"], s["line_end"], s["is_async"]) for s in found]
    assert got == [("A", "class", 1, 12, False), ("m", "method", 3, 7, True), ("n", "method", 8, 9, False), ("o", "method", 11, 12, False), ("g", "function", 13, 15, False), ("h", "function", 16, 16, False), ("cut", "function", 17, 17, False)]
    assert found[1]["doc"] == "Says\nat the margin."
    valid = "import x\n\nclass A:\n    'doc'\n    def m(self, a=':'):\n        s = '''\nend\n'''\n        return s\n\n# above\n@d\ndef f(a,\n  b): return {\n}\n"
    assert extract_symbols(valid + "print 'x'\n", "python") == extract_symbols(valid, "python") != []


def test_symbol_table(spark):
    files = spark.createDataFrame([("r", "b", "c", "a.py", "def f(x):\n    pass\n"), ("r", "b", "c", "a.md", "# x"), ("r", "b", "c", "bad.py", "def ("), ("r", "b", "c", "n.py", None), ("r", "b", "c", "b.go", "package a\n\nfunc G() {}\n")], "repo string, branch string, commit string, path string, content string")
    assert {(r.file_path, r.name, r.language) for r in symbols(files).collect()} == {("a.py", "f", "python"), ("b.go", "G", "go")}
    assert {r.language for r in symbols(files, compat_language=True).collect()} == {"unknown"}
    assert symbols(files, tracked=["go"]).count() == 1
    assert with_module(symbols(files), "m").first().module_path == "m"
    assert one(spark, "f", qualified_name(F.lit("a::b"), "x")) == "a::b::f" and one(spark, "f", qualified_name(F.lit(""), "x")) == "f"


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives_and_office(spark):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("d/a.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert archives.members(tar.getvalue(), "tar") == [("d/a.txt", b"hi")]
    assert archives.members(gzip.compress(b"x"), "gz") == [("extracted", b"x")]
    assert archives.members(b"broken", "zip") == [] and archives.members(b"", "tar") == [] and archives.members(b"x", "md") == []
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert archives.office_text(_zip({"word/document.xml": doc}), "docx") == "## Head\ntext\na\tb"
    odt = '<o:d xmlns:o="o" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h text:outline-level="1">T</text:h><text:p>p</text:p></o:d>'
    assert archives.office_text(_zip({"content.xml": odt}), "odt") == "# T\np"
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c/></row></sheetData></worksheet>',
    }
    assert archives.office_text(_zip(book), "xlsx") == "name\t5"
    assert archives.office_text(b"broken", "docx") is None and archives.office_text(b"x", "pdf") is None
    files = spark.createDataFrame([("x.zip", _zip({"a.md": b"# t", "b.bin": b"0"})), ("y.docx", _zip({"word/document.xml": doc})), ("z.zip", b"bad"), ("p.html", b"<p>page</p>")], "path string, content binary")
    assert [(r.archive, r.path, r.content) for r in archives.archive_members(files).collect()] == [("x.zip", "a.md", "# t")]
    assert {r.path: r.text.split("\n")[0] for r in archives.binary_text(files).collect()} == {"y.docx": "## Head", "p.html": "page"}
