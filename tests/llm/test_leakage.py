from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import leakage as L

words = st.lists(st.sampled_from("abc"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), words, st.integers(2, 5))
def test_automaton_finds_exactly_the_shared_runs(items, text, k):
    automaton = L.SuffixAutomaton(list(enumerate(items)), k)
    grams = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in items]
    expected = {(i, n) for n, g in enumerate(grams) for i in range(k - 1, len(text)) if tuple(text[i - k + 1 : i + 1]) in g}
    found = list(automaton.matches(text))
    assert {(i, n) for i, _, ns in found for n in ns} == expected
    joined = [" ".join(w) for w in items]
    for i, matched, _ in found:
        assert any(" ".join(text[i - matched + 1 : i + 1]) in j for j in joined)
        assert i == matched - 1 or not any(" ".join(text[i - matched : i + 1]) in j for j in joined)


PASSAGE = "One two three four five six seven eight nine ten eleven twelve thirteen"
DOCS = "doc_id long, text string, item_id int, spans string"


def frames(spark):
    docs = [
        (1, "Before. ONE two-three four, five six seven eight nine ten eleven TWELVE! after " + "word " * 40, 1, "x"),
        (1, "Before. ONE two-three four, five six seven eight nine ten eleven TWELVE! after " + "word " * 40, 1, "x"),
        (2, "one two three four five six seven eight nine ten eleven", 1, "x"),
        (3, None, None, None), (4, "", None, None), (5, PASSAGE, None, None), (None, PASSAGE, None, None),
    ]
    items = [(7, "passage", PASSAGE), (7, "passage", PASSAGE), (8, "x", None), (9, "x", "too short"), (10, "copy", "so: " + PASSAGE)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, kind string, text string")


def test_find_leaks(spark):
    docs, items = frames(spark)
    expected = {(1, 7, 1, 12), (1, 10, 1, 12), (5, 7, 1, 13), (5, 10, 1, 13)}
    assert {tuple(r) for r in L.find_leaks(docs, items).collect()} == expected
    in_blocks = L.find_leaks(docs, items, max_words=20)
    assert {tuple(r) for r in in_blocks.collect()} == expected
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0


def test_remove_leaks(spark):
    docs, items = frames(spark)
    out = {r.doc_id: r for r in L.remove_leaks(docs, items).collect()}
    assert set(out) == {1, 5} and out[5].dropped and out[5].text is None
    assert out[1].leaked_words == 12 and out[1].text.startswith("Before. ! after word")


def test_blocks_are_brought_together_before_cutting(spark):
    w = " ".join(f"w{i}" for i in range(20))
    v = " ".join(f"v{i}" for i in range(20))
    items = spark.createDataFrame([(i, x) for i, x in enumerate([w, v, v + " " + w], 1)], "item_id long, text string")
    docs = [(1, f"a {w} b {v} c " + "d " * 60), (1, f"a {w} b {v} c " + "d " * 60), (2, f"{w} b {v} c " + "d " * 30), (3, "none " * 50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for max_words in (30, 1000):
        out = {r.doc_id: r for r in L.remove_leaks(docs, items, max_words=max_words).collect()}
        assert L.remove_leaks(docs, items, max_words=max_words).count() == 2
        assert (out[1].leaked_words, out[1].dropped, out[1].text) == (40, False, "a  b  c " + "d " * 60)
        assert (out[2].leaked_words, out[2].n_words, out[2].dropped) == (40, 72, True)
    assert L.remove_leaks(docs.limit(0), items).count() == 0 and L.remove_leaks(docs, items.limit(0)).count() == 0
