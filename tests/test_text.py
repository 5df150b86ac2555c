import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as X
from lodeseek.operators import chunking


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [("", []), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("a\nb\n", ["a", "b"]), (None, None)],
)
def test_lines(spark, text, expected):
    assert one(spark, X.lines, text) == expected


def test_windows(spark):
    rows = [("a", "\n".join(map(str, range(301)))), ("b", ""), ("c", None), ("d", "x"), ("d", "x")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "path string, text string, start_line int, _lines string")
    got = sorted((r.id, r.start_line, r.end_line) for r in chunking.line_windows(df, "path", "text", 150).collect())
    assert got == [("a:0", 0, 149), ("a:150", 150, 299), ("a:300", 300, 300), ("d:0", 0, 0), ("d:0", 0, 0)]
    with pytest.raises(ValueError):
        chunking.line_windows(df, "path", "text", 0)


def test_windows_reassemble(spark):
    texts = [f"{'x' * (i % 5)}\n" * (i % 23) + "end" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    parts = {}
    for r in chunking.line_windows(df, "k", "t", 7).orderBy("start_line").collect():
        assert r.content.count("\n") < 7
        parts.setdefault(r.k, []).append(r.content)
    assert {k: "\n".join(p) for k, p in parts.items()} == dict(enumerate(texts))


@pytest.mark.parametrize(
    "glob, path, expected",
    [
        ("*.rs", "src/a.rs", True), ("**/target/**", "target/a.rs", True), ("**/target/**", "x/target/y/a.rs", True),
        ("vendor/**", "vendor/a", True), ("vendor/**", "x/vendor/a", False), ("a?c", "abc", True), ("[!a]b", "cb", True),
        ("[!a]b", "ab", False), ("a.c", "abc", False), ("A*", "a", False),
    ],
)
def test_globs(spark, glob, path, expected):
    assert one(spark, lambda v: X.matches_any(v, [glob]), path) is expected


def test_malformed_glob_is_reported():
    with pytest.warns(UserWarning):
        assert X.glob_regex("[abc") is None


def test_listed(spark):
    paths = ["__init__.py", ".hidden.py", ".dir/a.py", "target/a.rs", "x/vendor/a.go", "vendor/a.go", "a.txt", "noext", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = {r.p for r in df.where(X.listed(F.col("p"), None, X.DEFAULT_EXCLUDES)).collect()}
    assert kept == {"__init__.py", ".hidden.py", "x/vendor/a.go"}


def test_extension_and_language(spark):
    rows = [("a/b.tar.rs", "rs", "rust"), (".rs", None, None), ("a.b/c", None, None), ("x.JS", "JS", None), ("y.kts", "kts", "kotlin")]
    for path, extension, language in rows:
        assert one(spark, X.extension, path) == extension and one(spark, X.language_of, path) == language


def test_comment_text(spark):
    assert one(spark, X.strip_xml_tags, "<a>x</a> y\n<summary>\nb > c <d") == "x y\nb  c"
    line = lambda language: lambda v: X.strip_line_markers(v, F.lit(language))
    assert one(spark, line("rust"), "/// a\n//b\n ") == "a\n//b" and one(spark, line("go"), "// a\n//  b") == "a\nb"
    assert one(spark, line("haskell"), "-- | a\n-- b") == "a\n-- b" and one(spark, line("haskell"), "-- a\n--b") == "a\nb"
    assert one(spark, line("ruby"), "# a\n\t#b") == "a\nb" and one(spark, line("csharp"), "/// <b>a</b> c\n/// </x>") == "a c"
    assert one(spark, X.strip_block_markers, "/** a\n *\n ** b *\n\t*/") == "a\n* b *" and one(spark, X.strip_block_markers, "/* a */") == "a"
    assert one(spark, X.strip_block_markers, None) is None and one(spark, X.dedent, None) is None
    assert one(spark, X.dedent, "Title\n      one\n        two\n\n    ") == "Title\none\n  two"
    assert one(spark, X.preview, "a\nb\nc\nd") == "  a\n  b\n  c"


def test_parse_files(spark):
    rows = [
        ("a.py", b"def f():\n" + b"    x = 1\n" * 30, None), ("b.py", b"x = 1\ny = 2\n", None), ("c.py", b"\xff\xfe", None), ("d.py", b"", None),
        ("e.py", None, "gone"), ("f.txt", b"text", None), (None, b"x", None), ("g.go", b"package p\r\n\r\nfunc F() {\r\n}\r\n", None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rel_path string, bytes binary, error string, content int")
    got = sorted((r.file_path, r.symbol, r.start_line, r.end_line) for r in chunking.parse_files(df, 20).collect())
    assert got == [("a.py", "f", 0, 19), ("a.py", "f", 20, 30), ("b.py", "", 0, 1), ("g.go", "F", 2, 3)]
    assert chunking.parse_files(df.limit(0)).count() == 0
