import pytest

from lodeseek.llm import broken_files as B
from lodeseek.llm.syntax import CHECKERS

GOOD = {
    "python": 'import os\n\n@d(1)\nasync def f(a, *b, c: int = 1, **k) -> dict:\n    """Doc\n=======\n"""\n    x = [i for i in range(3) if i] or {"a": 1, **k}\n    if x and not a: return None\n    try:\n        with open("f") as g, h():\n            pass\n    except (A, B) as e:\n        raise E from e\n    return lambda q: q[1:, ::2]\n',
    "rust": "use a::{b, c::*};\n/// Doc\npub fn f<'a, T: Clone>(x: &'a mut Vec<T>, y: u8) -> Option<T> where T: Copy {\n    let mut v: Vec<u8> = vec![1, 2];\n    for i in 0..v.len() { if i > 1 && x.len() < 3 { v[i] += 1; } else { continue; } }\n    match y { 0 => Some(1), n if n > 2 => { None } _ => None }\n}\nimpl<T> A<T> for B { const X: u8 = 1; fn g(&self) -> u8 { self.x?.y as u8 } }\n",
    "java": 'package a.b;\nimport java.util.*;\n@A(x = 1)\npub'
    + 'lic final class C<T extends D> implements E, F {\n  private final Map<String, List<T>> m = new HashMap<>();\n  @Override public int f(int a, String... b) throws X {\n    for (int i = 0; i < a; i++) { m.get("}").add(null); }\n    int[] z = {1, 2}; Runnable r = () -> { return; };\n    switch (a) { case 1: break; default: return (int) 2L; }\n    return a > 1 ? b.length : -1;\n  }\n}\n',
    "csharp": 'using A.B;\nnamespace N {\n  public partial class C : D {\n    public int X { get { return 1; } set { y = value; } }\n    public string P { get; set; } = "a";\n    public async Task<int> F(int a, ref int b) { foreach (var q in z) { var s = $"{q}"; } return await G(a)!; }\n    int H() => 1;\n  }\n}\n',
    "go": 'package p\n\nimport (\n\t"a"\n\tb "c/d"\n)\n\ntype S struct {\n\tA, B int `json:"a"`\n\tM map[string][]*T\n}\n\nfunc (s *S) F(a, b int, c ...string) (int, error) {\n\tx := map[string]int{"a": 1}\n\tfor i, v := range c {\n\t\tif v, ok := x[v]; ok && i > 1 {\n\t\t\ts.A++\n\t\t} else {\n\t\t\tgo func() { <-ch }()\n\t\t}\n\t}\n\tswitch {\n\tcase a > b:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\treturn 0, &E{A: []int{1, 2}}\n}\n',
    "javascript": "import {a, b as c} from './d';\nexport default class A extends B {\n  #x = 1;\n  static async *f({a, b = 2}, ...r) { for (const i of r) { yield i } }\n  get y() { return this.#x ?? /[/}]/g.test(`a${1}`) }\n}\nconst g = async (p) => ({...p, h() {}})\nif (a) b\nelse c()\nvar do_ = function () { return }\nx = a\n  ? b\n  : c\n",
    "typescript": "import type { A } from 'a';\nexport interface B<T> extends C { x?: number; f(a: string): void; [k: string]: any }\ntype D = A | { k: 1 } & (() => void);\nexport abstract class E<T extends A = B> implements B { constructor(private x: number) { super() } f = (a: T): a is T => a as any; }\nenum F { A = 1, B }\nlet y: Map<string, number[]> = new Map<string, number[]>();\nfunction g<T>(a: T, b?: string): Promise<T> { return f<T>(a!) }\n",
    "tsx": 'export function A(p: P): JSX.Element {\n  return <div className="x" {...p}><B on={() => 1} />text {p.y} <></></div>;\n}\n'.replace("{...p}", ""),
    "kotlin": 'package a\nimport b.c\n\ndata class A(val x: Int = 1, private var y: String?) : B(x), C {\n    companion object { const val Z = 1 }\n    override fun f(a: Int): Int = if (a > 1) 2 else 3\n    fun <T> List<T>.g(b: (T) -> Unit) {\n        for ((i, v) in withIndex()) { b(v) }\n        val q = when (y) {\n            null -> 1\n            is String, "a" -> { 2 }\n            else -> throw E("}")\n        }\n        map { it -> it?.h ?: return }.forEach { println("$it") }\n    }\n}\n',
    "scala": 'package a\nimport b.{C, D => E}\n\nobject A extends B with C {\n  case class D(x: Int, y: String = "a")\n  def f[T](a: Int)(implicit b: T): Option[T] = {\n    val x = for { i <- 0 until 3; j = i if j > 1 } yield i * j\n    a match {\n      case 1 | 2 => Some(b)\n      case D(q, _) if q > 1 => None\n      case _ => x.map(_ + 1).foldLeft(0) { (s, t) => s + t }; None\n    }\n  }\n}\n',
    "ruby": "require 'a'\n\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    def f(a, b = {}, *c, d:, &e)\n      return nil unless a && b.any? { |k, v| v > 1 }\n      @x ||= [1, 2].map do |i|\n        i * 2\n      end\n      puts \"#{a} end\" if a == :end\n      case a\n      when 1, 2 then raise ArgumentError, 'x'\n      else a ? b : c\n      end\n    rescue E => e\n      retry\n    ensure\n      yield a\n    end\n  end\nend\n",
    "haskell": 'module A (f, B(..)) where\n\nimport qualified Data.Map as M\n\ndata B a = C { x :: Int } | D a deriving (Eq, Show)\n\n-- | Doc\nf :: (Ord a) => a -> [a] -> Int\nf x (y:ys)\n  | x > y = let\n        a = 1\n        b = a + 2\n      in a * b\n  | otherwise = case ys of\n      [] -> 0\n      _ -> if null ys then 1 else 2\nf _ [] = go 1 where\n  go n = do\n    z <- foo $ \\q -> q `div` 2\n    return (z, n)\n\ninstance Show B where\n  show = const "a"\n',
    "fsharp": 'module A\n\nopen System\n\ntype B = { X: int; Y: string }\n\n/* Note */\nlet rec f (a: int) (b: int list) : int =\n    let c = a + 1\n    if a > c then\n        printfn "%d" a\n    match b with\n    | [] -> 0\n    | x :: rest when x > 1 -> x |> g (fun y -> y + 1)\n    | _ ->\n        for i in 0 .. 3 do\n            ignore i\n        c\n',
}

BAD = {
    "python": ["def f():\n", "    x = 1\ny = 2\n", "def f(a:\n    return 1\n", "if x:\n    y\n<<<<<<< HEAD\n    z\n=======\n    w\n>>>>>>> b\n", "Some plain words that say things.\n", "def f():\n    x = 1\n    # and th", "x = 'abc\n", "package p\n\nfunc f() {}\n"],
    "rust": ["fn f() {\n", "    x += 1;\n}\nfn g() {}\n", "fn f() { let x = ; }\n", "import a\ndef f(): pass\n"],
    "java": ["class A { void f() { }\n", "class A { int x = 1 + ; }\n", "class A { /* no end\n }\n", "class A:\n    x = 1\n"],
    "csharp": ["class A { void F() { }\n", "class A { int x = \"a; }\n", "}\nclass B {}\n"],
    "go": ["package p\nfunc F() {\n", "package p\nfunc F() { x := }\n", "<html>\n"],
    "javascript": ["function f() {\n", "f(1,\n", "plain words here\n", "const x: number = 1;\n", "def f(a)\n  a\nend\n"],
    "typescript": ["export function f(a: number) {\n  return 1;\n", "}\n", "package a\n\nfunc f() {}\n"],
    "tsx": ["function A() { return <div>; }\n", "function A() {\n"],
    "kotlin": ["fun f() {\n", "class A { fun g( }\n", "def f(x):\n    y\n"],
    "scala": ["def f(a: Int): Int = {\n", "object A { val x = }\n"],
    "ruby": ["def f\n  1\n", "x = [1, 2\n", "end\n", "Returns how many words fit in here\n"],
    "haskell": ["f x =\n", "f x = let\n    a = 1\n", "f x = (1 + 2\n", "  a = 1\nf x = 2\n", "plain words that say nothing\n"],
    "fsharp": ["let f x =\n", "let f x =\n    let y = 1\n", "let f x =\n    (1 + 2\n", "Plain words here.\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_accepts(language):
    assert CHECKERS[language](GOOD[language]) == []


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_rejects(language, text):
    assert CHECKERS[language](text)


def test_recovery_finds_later_errors():
    errors = CHECKERS["java"]("class A {\n  int a = ;\n  int b = 1;\n  int c = ;\n}\n")
    assert [line for line, _ in errors] == [1, 3]
    assert len(CHECKERS["python"]("x = )\ny = 1\nz = (\n")) >= 2


def test_conflict_marks_in_comments_and_strings_do_not_count():
    for language, text in (("go", "package p\n\n/*\n<<<<<<< HEAD\n=======\n*/\nvar x = `\n>>>>>>> b\n`\n"), ("python", '"""\n<<<<<<< a\n=======\n"""\nx = 1\n')):
        assert CHECKERS[language](text) == []


SCHEMA = "id string, repo string, file_path string, language string, content string, start_line int, end_line int, n_errors string"


def test_files_are_judged_over_all_rows(spark):
    rows = [
        ("a:0", "r", "a.go", "go", "package p\n\nfunc F() {", 0, 2, "x"),
        ("a:3", "r", "a.go", "go", "\treturn\n}", 3, 4, "x"),
        ("a:3", "r", "a.go", "go", "\treturn\n}", 3, 4, "x"),
        ("b:0", "r", "b.go", "go", "package p\n\nfunc F() {", 0, 2, "x"),
        ("c:0", None, "c.xyz", "cobol", "?", 0, 0, None),
        ("d:0", None, "d.py", "python", "", None, None, None),
        ("e:0", "r", None, "go", "}", 0, 0, None), ("f:0", "r", "f.go", "go", None, 0, 0, None), (None, "r", "g.go", None, "}", 0, 0, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.file_path: r for r in B.check_files(df).collect()}
    assert {p: r.n_errors for p, r in out.items()} == {"a.go": 0, "b.go": 1, "c.xyz": None, "d.py": 0, "g.go": None}
    assert out["b.go"].first_line == 2 and "end of text" in out["b.go"].first_cause
    assert {tuple(r) for r in B.rates(B.check_files(df)).collect()} == {("r", "go", 2, 1, 0.5), (None, "python", 1, 0, 0.0)}
    assert {(r.language, r.files, r.accepted) for r in B.acceptance(B.check_files(df)).collect()} == {("go", 2, 1), ("python", 1, 1)}
    assert B.check_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("language", sorted(GOOD))
def test_a_comment_may_end_the_text(language):
    mark = {"python": "#", "ruby": "#", "haskell": "--"}.get(language, "//")
    assert CHECKERS[language](GOOD[language] + f"{mark} tail (of the text") == []
    assert CHECKERS[language]("") == [] and CHECKERS[language](f"{mark} only { '{' }") == []


@pytest.mark.parametrize("text", ["(" * 60_000, "x = 1; " * 20_000, "\n" * 200_000, '"' * 9_999, "{" * 30_000 + "}" * 30_000, " " * 500_000])
def test_long_odd_texts_take_time_in_proportion(text):
    import time

    began = time.process_time()
    for language in CHECKERS:
        B.syntax_errors(language, text)
    assert time.process_time() - began < 60


NESTED = {
    "python": "x = {}\n", "ruby": "x = {}\n", "haskell": "f x = {}\n", "fsharp": "let f = {}\n", "java": "class A {{ int x = {}; }}\n",
    "csharp": "class A {{ int x = {}; }}\n", "go": "package p\n\nvar x = {}\n", "rust": "fn f() {{ let x = {}; }}\n", "kotlin": "val x = {}\n",
    "scala": "object A {{ val x = {} }}\n",
}


@pytest.mark.parametrize("language", sorted(CHECKERS))
def test_no_nesting_is_too_deep(language):
    text = NESTED.get(language, "const x = {};\n").format("(" * 6000 + "1" + ")" * 6000)
    assert B.syntax_errors(language, text) == []
    assert B.syntax_errors(language, text.replace(")", "", 1))


def test_all_errors_are_kept():
    assert len(B.syntax_errors("java", "class A {\n" + "  int a = ;\n  int b = 1;\n" * 200 + "}\n")) == 200
    assert [line for line, _ in B.syntax_errors("python", "x = )\n" * 200)] == list(range(200))
    assert len(B.syntax_errors("ruby", "x = )\n" * 200)) >= 200
    assert len(B.syntax_errors("haskell", "f x = )\n" * 200)) >= 200
