import pytest

from lodeseek.llm import truncation as T


@pytest.mark.parametrize(
    "text, expected",
    [
        ("All is said.", "closed"), ('He asked "why?"', "closed"), ("Code:\n```py\nx = 1\n```", "closed"),
        ("| a | 1 |\n| b | 2 |", "closed"), ("Text.\n\n- [x] one\n- [ ] two", "weak"), ("Text.\n\nRefs: #12", "weak"),
        ("Text.\n\nLGTM", "weak"), ("Text.\n\nThanks,\nthe core team", "weak"), ("Text.\n\n-- the desk", "weak"),
        ("Text.\n\n(end of notes)", "weak"), ("Text.\n\n:-)", "weak"), ("Text.\nSee also: docs/a/b.md", "weak"),
        ("It stops in the mid", "open"), ("All said. See also: docs/a.md", "weak"), ("- It stops in", "open"), ("Code:\n```py\nx = (1", "open_code"),
        ("It was cut he...", "omission"), ("It was cut he [...]", "omission"), ("It was cut he…", "omission"),
        ("bad byt�", "broken_char"), ("It is closed for good. /turnstile-bot", "weak"), ("It is closed for good. :-)", "weak"),
        ("Sort them by how soon. Thanks,\nverse team", "weak"), ("It is closed for good. That rum", "open"),
    ],
)
def test_ending(text, expected):
    assert T.ending(text) == expected


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, limit string, ending int"


def row(i, text, source, n=None):
    return (i, text, "en", source, len(text) if n is None and text is not None else n, "clash", 1)


def test_limits_and_truncation(spark):
    long = " ".join(f"word{i}." for i in range(200))
    rows = [row(i, f"{i} " + long[: 300 - len(f"{i} ") - 9] + "\n- [ ] ab", "capped") for i in range(8)]
    rows += [row(20 + i, f"{i}. Short." * (i + 1), "capped") for i in range(9)]
    rows += [row(40 + i, f"{i}. Text." * (i + 1) + "\n\n- [ ] ab", "free") for i in range(20)]
    rows += [row(70, None, None, 5), row(71, "", "free"), row(72, "Done.\n\nLGTM", "free", 900), row(73, "Done.", None)]
    rows += [row(74, "half a sen", None), row(74, "half a sen", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = {(r.source, r.counting, r.length) for r in T.hidden_limits(df).collect()}
    assert ("capped", "chars", 300) in limits and all(s == "capped" for s, _, _ in limits)
    found = T.find_truncated(df).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if r.truncated} == {*range(8), 72, 74}
    rates = {r.source: (r.documents, r.truncated) for r in T.truncation_rates(T.find_truncated(df)).collect()}
    assert rates == {"capped": (17, 8), "free": (22, 1), None: (4, 2)}
    assert T.find_truncated(df.limit(0)).count() == 0


def test_lengths(spark):
    text = 'a<"ü\n😀&\\'
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[c.alias(k) for k, c in T.lengths(df["t"]).items()]).first().asDict()
    import html
    import json

    assert got["utf16"] == len(text.encode("utf-16-le")) // 2 and got["utf8"] == len(text.encode())
    assert got["html_quotes"] == len(html.escape(text)) and got["html"] == len(html.escape(text, quote=False))
    assert got["json"] == len(json.dumps(text, ensure_ascii=False)) - 2 and got["json_ascii"] == len(json.dumps(text)) - 2


def test_a_character_cut_apart_counts_no_bytes(spark):
    body = "é" * 99 + "x"
    rows = [row(i, f"{i:03d}" + body[:96] + "\ufffd", "bytes") for i in range(8)]
    found = T.find_truncated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.truncated and r.limit is not None and r.ending == "broken_char" for r in found)
