from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import splitting as S


def by_definition(lines, limit, overlap):
    """TESTDATA.md's rule, word for word."""
    size = lambda a, b: sum(map(len, lines[a : b + 1])) + b - a
    pieces, start, before = [], 0, -1
    while True:
        end = start
        while end + 1 < len(lines) and size(start, end + 1) <= limit:
            end += 1
        if end < len(lines) - 1:
            natural = [
                i for i in range(start, end + 1)
                if lines[i].strip() and not lines[i + 1].strip() and i > before
            ]
            end = natural[-1] if natural else end
        pieces.append((start, end))
        if end == len(lines) - 1:
            return pieces
        following = max(end + 1 - overlap, start + 1)
        while following <= end and size(following, end + 1) > limit:
            following += 1
        start, before = following, end


line = st.one_of(st.just(""), st.just("  "), st.text("ab ", min_size=1, max_size=12))


@settings(max_examples=400, deadline=None)
@given(st.lists(line, min_size=1, max_size=40), st.integers(12, 60))
def test_forward_pieces_follow_the_definition(lines, limit):
    assert S.forward_pieces(lines, limit, 3) == by_definition(lines, limit, 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(line, min_size=1, max_size=40), st.integers(12, 60))
def test_weakest_pieces_cover_all_lines_within_the_limit(lines, limit):
    pieces = S.weakest_pieces(lines, limit, 3)
    size = lambda a, b: sum(map(len, lines[a : b + 1])) + b - a
    assert all(size(a, b) <= limit for a, b in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(lines) - 1
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b + 1 and b < d and b + 1 - c <= 3


def test_weakest_pieces_prefer_definitions():
    lines = ["def a():", "    x", "    y", "", "def b():", "    x", "    z", "    u"]
    assert [b for _, b in S.weakest_pieces(lines, 32, 0)] == [3, 7]


@settings(max_examples=100, deadline=None)
@given(st.text("ab;, ", min_size=1, max_size=200))
def test_long_lines_are_cut_whole(text):
    ranges = S.cut_long_line(text, 20)
    assert "".join(text[a:b] for a, b in ranges) == text
    assert all(b - a <= 20 for a, b in ranges)


def test_split_oversized(spark):
    schema = "chunk_id long, content string, start_line int, piece_no string, long_line int"
    long_text = "\n".join(f"line {i}" + " x" * 20 for i in range(200))
    rows = [
        (1, long_text, 10, "clash", 1), (1, long_text, 10, "clash", 1), (2, None, 0, None, None), (3, "", 0, None, None),
        (4, "short", 0, None, None), (5, "y" * 9000 + "\nend", None, None, None),
    ]
    out = S.split_oversized(spark.createDataFrame(rows, schema)).collect()
    one = sorted({(r.piece_no, r.start_line, r.end_line) for r in out if r.chunk_id == 1})
    assert one[0][1] == 10 and one[-1][2] == 209 and len([r for r in out if r.chunk_id == 1]) == 2 * len(one)
    five = sorted((r.piece_no, r.start_line, r.start_col, r.end_col, r.long_line) for r in out if r.chunk_id == 5)
    assert {r.chunk_id for r in out} == {1, 5} and all(r[4] for r in five) and five[-1][1] == 1
    assert S.split_oversized(spark.createDataFrame([], schema)).count() == 0
