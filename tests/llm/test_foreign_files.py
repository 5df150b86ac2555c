import pytest

from lodeseek.llm import foreign_files as G


@pytest.mark.parametrize(
    "text, generated, origin",
    [
        ("// Code generated by protoc. DO NOT EDIT.\npackage a", True, False),
        ("/*\n * @generated by x from y\n */\nclass A {}", True, False),
        ("# Used to be generated; maintained by hand since then.\nx = 1", False, False),
        ("# Writes the do-not-edit banner that our tool puts on its output.\nx = 1", False, False),
        ("x = 1\n# Code generated by y. DO NOT EDIT.", False, False),
        ("// Copyright (c) 2020 The Widget Authors. All rights reserved.\n\npackage a", False, True),
        ("// Copyright (c) 2020 the my-repo team\n\npackage a", False, False),
        ("// Vendored from widget 1.2.3, local patches none\npackage a", False, True),
        ("// Replaces the vendored widget with code of our own.\npackage a", False, False),
        ("/*! Widget v1.2.3 | (c) 2020 Widget contributors | MIT License */\nx", False, True),
        ("/** Auto-generated method stub */\nvoid f() {}", False, False),
    ],
)
def test_notes(text, generated, origin):
    said = G.notes(text, "my-repo", "my-repo/src/a.go")
    assert (said["generated_note"], said["origin_note"]) == (generated, origin)


def test_notes_behind_a_long_licence():
    licence = "".join(f"// Licence text, line {i}.\n" for i in range(60))
    for note, key in (("// Code generated by protoc. DO NOT EDIT.", "generated_note"), ("// Vendored from widget 1.2.3", "origin_note")):
        assert G.notes(f"{licence}{note}\npackage a", "my-repo", "my-repo/src/a.go")[key]
        assert not G.notes(f"{licence}package a\n{note}", "my-repo", "my-repo/src/a.go")[key]


def test_composition():
    table = "var x = []int{\n" + "    1, 2, 3, 44, 55, 66,\n" * 40 + "}"
    blob = "x = '''" + "Ab3/" * 400 + "'''"
    small = "!function(){" + "var a=b.c(1),d='x';if(a>2){e(a)}" * 30 + "}();"
    getters = "class A {\n" + "".join(f"  getA{i}() {{ return this.read({i}, 0); }}\n" for i in range(20)) + "}"
    hand = "\n".join(f"def f{i}(a, b):\n    c = a + {i}\n    if c > b:\n        g(c)\n    return 'x'" for i in range(9))
    looks = lambda t: tuple(f(G.composition(t)) for f in (G.looks_data, G.looks_minified, G.looks_generated))
    assert looks(table) == (True, False, False) and looks(blob) == (True, False, False)
    assert looks(small) == (False, True, False) and looks(getters) == (False, False, True)
    assert looks(hand) == (False, False, False)


SCHEMA = "id string, repo string, file_path string, language string, content string, start_line int, end_line int, kind string"


def test_classify(spark):
    lines = "\n".join(f"value_{i} = compute_something({', '.join(['i'] * (i + 1))})" for i in range(20))
    edited = lines.replace("value_3 = compute_something(", "value_3 = compute_other(")
    other = "\n".join(f"unlike_{i} = entirely_new_{i}(a)\nif unlike_{i}{' and b' * i}:\n    go({i}{', c' * i})" for i in range(20))
    rows = [(f"{p}:0", r, p, "python", t, 0, 20, "clash") for r, p, t in [
        ("a", "a/src/orig.py", lines), ("b", "b/vendors/copy.py", edited), ("b", "b/vendors/own.py", other), ("b", "b/vendor/x/y.py", other + "\nz = 1"),
        ("c", "c/src/copy.py", edited + "\n# tail"), ("d", "d/gen/x.py", other), ("e", "e/src/app.min.js", "x"), ("f", "f/empty.py", ""),
    ]]
    rows += [("g:0", None, "g/n.py", None, "# Vendored from widget 1.0.0\nx", None, None, None), ("h:0", "h", None, "python", "x", 0, 0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.file_path: (r.kind, r.reason) for r in G.classify_files(df).collect()}
    told = {r.file_path: (r.kind, r.reason) for r in G.classify_files(df, told=True).collect()}
    assert told == {**got, "c/src/copy.py": ("hand", None)}
    assert got == {
        "a/src/orig.py": ("hand", None), "b/vendors/copy.py": ("vendored", "contained"), "b/vendors/own.py": ("vendored", "contained"),
        "b/vendor/x/y.py": ("vendored", "directory"), "c/src/copy.py": ("vendored", "contained"), "d/gen/x.py": ("generated", "path"),
        "e/src/app.min.js": ("minified", "path"), "f/empty.py": ("hand", None), "g/n.py": ("vendored", "notice"),
    }
    assert G.classify_files(df.limit(0)).count() == 0


def test_containment_of_unhinted_and_of_widespread_files(spark):
    body = [f"value_{i} = compute_something({', '.join(['i'] * (i + 1))})" for i in range(30)]
    rows = [("0", "r0", "r0/src/unhinted.py", "python", "\n".join(f"other_{x}" for x in body), 0, 30, None)]
    rows += [("1", "r1", "r1/src/copy.py", "python", rows[0][4].replace("other_value_3 =", "changed ="), 0, 30, None)]
    for n in range(60):  # every version is edited, so none of the lines they share is rare
        path = f"v{n}/vendors/lib.py" if n % 2 else f"v{n}/src/lib.py"
        rows.append((f"v{n}", f"v{n}", path, "python", "\n".join([*body, f"edited_in_{n} = True"]), 0, 31, None))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.file_path: r for r in G.classify_files(df).collect()}
    assert got["r1/src/copy.py"].kind == "vendored" and got["r1/src/copy.py"].origin_path == "r0/src/unhinted.py"
    assert got["r1/src/copy.py"].contained == got["r0/src/unhinted.py"].contained == pytest.approx(29 / 30)
    assert all(got[p].contained == pytest.approx(30 / 31) for p in got if p.endswith("lib.py"))
    assert {p for p in got if got[p].kind == "hand"} == {"r0/src/unhinted.py", "v0/src/lib.py"}
    told = {r.file_path: r.kind for r in G.classify_files(df, told=True).collect()}
    assert all((told[p] == "vendored") == ("vendors" in p) for p in told)
