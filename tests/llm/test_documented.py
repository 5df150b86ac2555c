import pytest

from lodeseek.llm import documented as D

JS = """class A {
    #count = 3;

    /** Adds the given number to every entry of the list. */
    add(n) { if (n) { return "}" } return `x${n}`; }

    // Ordinary remark about the next one here.
    static async load(url) {
        run(function inner() { return 1; });
    }

    /**
     * Reads the whole file line by line.
     * @param path the file
     */
    #read(path) {
        while (path) { path = '{'; }
    }
}"""

PY = '''class A(Base):
    """Class text."""
    size = 3

    def one(self, a: dict = {"x": ")"}) -> int:
        """Counts all of the small things twice."""
        def inner():
            """Hidden inner documentation text here."""
        return 1

    # Says what happens when two is called.
    @decorated(1)
    def two(self): return 2

    async def three(self):
        x = "def four():"
'''

RUBY = """class A
  attr_reader :x

  # Sends the message over to the other side.
  def send_it(a, b)
    if a
      3.times do |i|
        puts "end"
      end
    end
    x = if b then 1 else 2 end
  end

  def self.build = new

  # Last one of the class that is documented.
  def last?
    nil
  end
end"""


@pytest.mark.parametrize(
    "language, text, expected",
    [
        ("javascript", JS, [("add", True), ("load", False), ("#read", True)]),
        ("python", PY, [("one", True), ("two", True), ("three", False)]),
        ("ruby", RUBY, [("send_it", True), ("build", False), ("last?", True)]),
        ("rust", "impl A {\n    /// Walks over all of the nodes.\n    pub fn go<'a>(&'a self) -> u8 { let c = '}'; 1 }\n    // plain\n    fn x() {}\n}",
         [("go", True), ("x", False)]),
        ("java", "public class A {\n  int f = g(1);\n  /** Says a lot about the method. */\n  @Override\n  public <T> List<T> m(int a) throws E { return null; }\n  void n() {}\n}",
         [("m", True), ("n", False)]),
        ("csharp", "class A {\n  /// <summary>Says a lot about the method.</summary>\n  public int M(int a) => a;\n  /* plain */\n  int N() { return 1; }\n}",
         [("M", True), ("N", False)]),
        ("kotlin", "class A {\n  /** Says a lot about the method. */\n  override fun m(a: Int): Int = a + 1\n  fun n() { }\n}", [("m", True), ("n", False)]),
        ("scala", "class A {\n  /** Says a lot about the method. */\n  def m(a: Int): Int =\n    a + 1\n  def n: Int = { 1 }\n}", [("m", True), ("n", False)]),
        ("typescript", "export class A {\n  private x: number = 1;\n  /** Says a lot about the method. */\n  async m(a: {b: number}): Promise<void> { }\n}", [("m", True)]),
        ("go", "// Says a lot about the method.\nfunc (a *A) M(b int) error {\n\treturn nil\n}\n\nfunc N() {}", [("M", True), ("N", False)]),
    ],
)
def test_functions_in(language, text, expected):
    assert [(f.name, f.doc is not None) for f in D.functions_in(language, text)] == expected


@pytest.mark.parametrize(
    "doc, expected",
    [
        ("Walks every reagent of the codon.", True), ("TODO: document this thing properly some day", False), ("@param x the long story of x here", False),
        ("Load method for the user data.", False), ("Copyright 2014 the maintainers. All rights reserved.", False), ("SPDX-License-Identifier: MIT", False),
        ("eslint-disable-next-line no-unused-vars and more", False), ("Description to follow in change 9.", False), ("", False), (None, False),
        ("===========", False), ("Auto-generated method stub", False), ("Prüft, ob die Quelle noch dazu gehört.", True),
        ("Loads users.\nKeeps them sorted always.", True), ("<summary>Maps each hive from there.</summary>", True), ("<summary>Maps each hive.</summary>", False),
    ],
)
def test_informative(doc, expected):
    assert D.informative(doc, "loadUserData") is expected


SCHEMA = "file_path string, language string, symbol string, content string, start_line int, end_line int, node_kind string, summary string, doc int, code string"


def test_rows(spark):
    body = "\n".join(f"    x{i} = {i}" for i in range(30))
    rows = [
        ("a.py", "python", "f", "def f():\n" + body, 0, 30, "function_definition", "Says what the thing does here.", 1, "x"),
        ("a.py", "python", "f", body, 31, 60, "function_definition", "Says what the thing does here.", 1, "x"),
        ("a.py", "python", "", "@d\ndef g():\n    '''Says what the other thing does.'''", 70, 72, "function_definition", None, 1, "x"),
        ("a.py", "python", "A", PY, 80, 99, "class_definition", None, 1, "x"),
        ("a.py", "python", "A", PY, 80, 99, "class_definition", None, 1, "x"),
        ("b.go", "go", "Q", "func Q() {}", None, None, "function_declaration", "", None, None),
        (None, "go", "Q", "func Q() {}", 0, 0, "function_declaration", "Says something that is long enough.", None, None),
        ("c.go", "go", "Q", None, 0, 0, "function_declaration", "Says something that is long enough.", None, None),
        ("d.xx", "cobol", "Q", "PROC", 0, 0, "function", "Says something that is long enough.", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.file_path, r.func_name) for r in D.documented_functions(df).collect()}
    assert got == {("a.py", "f"), ("a.py", "g"), ("a.py", "one"), ("a.py", "two"), ("d.xx", "Q")}
    pairs = {(r.file_path, r.func_name): r for r in D.pair_functions(df).collect()}
    assert pairs["a.py", "f"].end_line == 60 and pairs["a.py", "one"].start_line == 84
    assert pairs["a.py", "one"].code.lstrip().startswith("def one") and pairs["b.go", "Q"].doc is None
    assert D.pair_functions(df.limit(0)).count() == 0


def test_deep_nesting_gives_no_function():
    assert D.functions_in("rust", "(" * 100_000) == [] and D.functions_in("python", "x = " + "[" * 100_000) == []


@pytest.mark.parametrize("depth", [300, 6000])
@pytest.mark.parametrize("language, text", [
    ("java", "class A {{\n  /** Says a lot about the method. */\n  int m() {{ return {}; }}\n}}"), ("python", "class A:\n    def m(self):\n        '''Says it all.'''\n        return {}\n"),
    ("typescript", "class A {{\n  /** Says a lot about the method. */\n  m() {{ return {}; }}\n}}"), ("ruby", "class A\n  # Says a lot.\n  def m\n    {}\n  end\nend\n"),
])
def test_no_nesting_loses_a_function(language, text, depth):
    found = D.functions_in(language, text.format("(" * depth + "1" + ")" * depth))
    assert [(f.name, f.doc is not None) for f in found] == [("m", True)]


@pytest.mark.parametrize("language, text, names", [
    ("java", 'class A {\n  /** Says a lot about it. */\n  void m(@Nullable(value="x(y(z(w))))") Map<String, List<int[]>> a) throws E { }\n  protected A(int x) { }\n}', ["m", "A"]),
    ("typescript", "class A {\n  /** Says a lot about it. */\n  private load = async (a: { b: (c: string) => void }): Promise<A | {x: 1}> => { return f(a); };\n  m(): { a: number } { return 1 }\n  n = 3;\n}", ["load", "m"]),
    ("typescript", "/** Says a lot about it. */\nexport const pick = <T>(a: T, b = ')'): T => a;\nexport default function () { }", ["pick"]),
    ("javascript", "/** Says a lot about it. */\nconst f = function (a) { return a; };\nvar g = x => x + 1, h = 2;\nif (a) { b(); }", ["f", "g"]),
    ("csharp", "namespace N {\n  class A {\n    /// Says a lot about it.\n    public Dictionary<string, (int, int)> M<T>((int a, int b) x, string y = \")\") where T : new() => null;\n    void I.N() { }\n  }\n}", ["M", "N"]),
    ("kotlin", "class A {\n  /** Says a lot about it. */\n  @Inject(\"(\") suspend inline fun <reified T : List<T>> Map<T, (T) -> Unit>?.`a b`(x: () -> Unit = { }) = x\n}", ["`a b`"]),
    ("rust", "impl<T: Fn(A) -> B> X<T> {\n  /// Says a lot about it.\n  #[cfg(a = \"]\")]\n  pub(crate) const unsafe extern \"C\" fn go<'a, F: Fn(u8) -> u8>(f: F) where F: 'a {}\n}", ["go"]),
    ("go", "func (s *Set[K, V]) Each(f func(k K) (bool, error)) (n int, err error) {\n\treturn\n}", ["Each"]),
    ("scala", "object A {\n  /** Says a lot about it. */\n  implicit private[a] def +(x: Int = f(\")\"))(implicit y: Y): A = x\n}", ["+"]),
])
def test_heads(language, text, names):
    assert [f.name for f in D.functions_in(language, text)] == names


def test_a_head_may_stand_anywhere_and_neighbours_stay_apart(spark):
    far = "/*" + "x" * 5000 + "*/\npublic void far() { }"
    rows = [
        ("a.java", "java", "", far, 0, 1, "method_declaration", "Says what the far one does.", 1, "x"),
        ("b.py", "python", "", "@d\ndef f(): '''Says what the first one does.'''", 0, 1, "decorated_definition", None, 1, "x"),
        ("b.py", "python", "", "@d\ndef g(): '''Says what the second one does.'''", 2, 3, "decorated_definition", None, 1, "x"),
        ("c.py", "python", "h", "def h(a,", 0, 0, "function_definition", None, 1, "x"),
        ("c.py", "python", "h", "      b): '''Says what the third one does.'''", 1, 1, "function_definition", None, 1, "x"),
    ]
    found = D.documented_functions(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.file_path, r.func_name) for r in found} == {("a.java", "far"), ("b.py", "f"), ("b.py", "g"), ("c.py", "h")}


@pytest.mark.parametrize("text", ["public static " * 3000, "/* " * 4000, "def f(a):\n" * 3000, "x = 1; " * 4000, "class A { " * 2000, "a<" * 4000, "(a) => " * 3000])
def test_odd_texts_take_time_in_proportion(text):
    import time

    began = time.process_time()
    for language in ("java", "csharp", "typescript", "kotlin", "rust", "python", "ruby"):
        D.functions_in(language, text)
    assert time.process_time() - began < 20
