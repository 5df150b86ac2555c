import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import similarity as S


def texts(seed=3):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(40, 140))] for _ in range(25)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            edited = list(words)
            for _ in range(rng.randrange(1, 14)):
                edited[rng.randrange(len(edited))] = "new" + str(rng.randrange(1000))
            out.append(" ".join(edited))
    return out + [out[0], out[0].upper(), out[3], "too short", "", None]


def brute_force(rows, similarity):
    sets = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        v = S.shingle_set(t)
        if v is not None:
            sets[i] = set(v.tolist())
    ids = sorted(sets)
    return {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9
    }


@pytest.mark.parametrize("tile, similarity, most", [(4000, 0.6, 1000), (3, 0.6, 1000), (4000, 0.8, 1000), (9, 0.6, -1), (4000, 0.6, -1)])
def test_finds_exactly_the_similar_pairs(spark, tile, similarity, most, monkeypatch):
    monkeypatch.setattr(S, "FREQUENT", 2)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, texts()[0])]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "chunk_id long, content string, text_key string, n int").repartition(3)
    members, pairs = S.similar_texts(df, "chunk_id", "content", similarity=similarity, tile=tile, most=most)
    expected = brute_force(rows, similarity)
    assert len(expected) > 10
    assert {tuple(r) for r in S.row_pairs(members, pairs).collect()} == expected
    groups = {r.id: r for r in S.near_duplicate_groups(members, pairs).collect()}
    links = {i: sum(i in p for p in expected) for i in groups}
    assert {i: r.links for i, r in groups.items()} == links
    parent = {i: i for i in groups}
    for _ in groups:
        for a, b in expected:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {i: r.group_id for i, r in groups.items()} == parent


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_id long, content string")
    members, pairs = S.similar_texts(df, "chunk_id", "content")
    assert members.count() == 0 and S.row_pairs(members, pairs).count() == 0 and S.near_duplicate_groups(members, pairs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), min_size=1, max_size=300), st.sets(st.integers(0, 5000), min_size=1, max_size=900))
def test_bitmap_bound_is_never_below_the_overlap(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    maps, ns = [S.bitmap(x), S.bitmap(y), S.bitmap(x)], np.array([len(x), len(y), len(x)])
    bounds = S.overlap_bounds(maps[:2], maps[1:], ns[:2], ns[1:])
    assert bounds[0] == bounds[1] >= len(a & b)
    common, total = S.overlaps([x.tobytes(), y.tobytes()], [y.tobytes(), y.tobytes()])
    assert common.tolist() == [len(a & b), len(b)] and total.tolist() == [len(a) + len(b), 2 * len(b)]


def test_tokens_are_ascii_runs():
    assert S.shingle_set("É a b_1 C é", 3, 3) is not None
    assert (S.shingle_set("A-b.c D", 3, 3) == S.shingle_set("a b C, d", 3, 3)).all()
    assert S.shingle_set("a b", 3, 2) is None


def test_frequent_triples_are_counted_exactly_and_bounded(spark):
    sets = [np.array(sorted({0, 1, *range(10 * i, 10 * i + 3 + i % 9)}), np.uint64).tobytes() for i in range(1, 60)]
    df = spark.createDataFrame([(bytearray(x),) for x in sets], "shingles binary").repartition(3)
    counts = dict(map(tuple, S.triple_counts(df, buffered=20).collect()))
    assert counts[0] == counts[1] == 59 and max(n for t, n in counts.items() if t > 1) <= 2
    frequent, few = S.frequent_triples(df, 4000, 2)
    assert few and sorted(map(tuple, frequent.collect())) == [(0, 59), (1, 59)]
    assert not S.frequent_triples(df, 16, 1)[1] and S.frequent_triples(df, 4000, 1)[0].count() == 0


def test_stages_shrink(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "chunk_id long, content string")
    n = {r.stage: r.n for r in S.similarity_stages(df, "chunk_id", "content").collect()}
    assert n["rows"] > n["texts"] > 25 and n["tiles"] >= n["bitmaps"] >= n["similar"] > 10
