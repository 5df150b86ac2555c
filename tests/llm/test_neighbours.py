import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import neighbours as N

SCHEMA = "chunk_id long, vector array<float>, summary_vector array<float>, field string, cosine int"


def vectors(n=900, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, 64))
    out = np.concatenate([base, base + 0.25 * rng.standard_normal(base.shape), rng.standard_normal((n - 2 * len(base), 64))])
    return out.astype(np.float32)


def table(spark):
    v = vectors()
    rows = [(i, [float(y) for y in x], [float(y) for y in v[-i - 1]] if i % 2 else None, "clash", 1) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[0][1], None, "clash", 1) for i in range(15)]  # copies of one vector
    bad = [None, [], [0.0] * 64, [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [(2000 + i, x, x, None, None) for i, x in enumerate(bad)] + [(None, rows[1][1], None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def brute_force(rows, column, k, least=-2.0):
    held = [(r[0], np.array(r[column], np.float64)) for r in rows if r[0] is not None and r[column] and len(r[column]) == 64]
    held = [(i, x) for i, x in held if np.isfinite(x).all() and x.any()]
    ids, x = np.array([i for i, _ in held]), np.stack([x for _, x in held])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round(x @ x.T, 9)
    lists = {}
    for n, i in enumerate(ids):
        order = sorted((-cosine[n, m], ids[m]) for m in range(len(ids)) if m != n)[:k]
        lists[int(i)] = [(int(o), -c) for c, o in order if -c >= least]
    return lists


@pytest.mark.parametrize("block", [4096, 10])
def test_pairs_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(N, "HOT", 4 if block == 10 else N.HOT)
    df, rows = table(spark)
    lists = N.similar_vectors(df, "chunk_id", ["vector", "summary_vector"], block=block)
    got = {(r.field, r.id_a, r.id_b) for r in N.neighbour_pairs(lists).collect()}
    expected = set()
    for column, name in ((1, "vector"), (2, "summary_vector")):
        for i, partners in brute_force(rows, column, 10, 0.9).items():
            expected |= {(name, min(i, o), max(i, o)) for o, _ in partners}
    assert len(expected) > 300
    assert len(got & expected) >= 0.97 * len(expected) and len(got - expected) <= 0.01 * len(expected)
    ranks = {}
    for r in lists.collect():
        ranks.setdefault((r.field, r.id), []).append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) and len(x) <= 10 for x in ranks.values())


def dense(n, groups, seed=3):
    """Groups of different vectors at cosines of 0.9 and more, which fill a cell or two each, among unrelated ones."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 64))
    for g in range(groups):
        v[g::20] = rng.standard_normal(64) + 0.2 * rng.standard_normal(v[g::20].shape)
    return v.astype(np.float32)


def dense_recall(spark, n, groups):
    v = dense(n, groups)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>").repartition(4)
    got = {(r.id_a, r.id_b) for r in N.neighbour_pairs(N.similar_vectors(df, "chunk_id", ["vector"])).collect()}
    x = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    near = np.argpartition(-cosine, 10, axis=1)[:, :10]
    expected = {(min(i, int(o)), max(i, int(o))) for i in range(n) for o in near[i] if cosine[i, o] >= 0.9}
    return len(got & expected) / len(expected), len(got & expected) / len(got), len(expected)


def test_dense_groups_keep_their_best_partners(spark):
    recall, precision, count = dense_recall(spark, 8_000, 4)
    assert count > 5_000 and recall >= 0.98 and precision >= 0.98


def test_probes_grow_with_the_cells():
    books = lambda n: N.Codebooks([np.zeros((n, 64), np.float32)] * 2)
    assert [N.probes_of(books(n)) for n in (4, 64, 256, 512)] == [16, 16, 25, 32]


def test_queries_reach_the_recall(spark):
    df, rows = table(spark)
    out = N.query_neighbours(df, "chunk_id", ["vector"], F.col("chunk_id") % 20 == 0, query_block=16).collect()
    truth = {i: x for i, x in brute_force(rows, 1, 10).items() if i % 20 == 0}
    got = {}
    for r in out:
        got.setdefault(r.id, set()).add(r.other)
    assert set(got) == set(truth) and all(len(x) == 10 for x in got.values())
    value = {(i, o): c for i, x in brute_force(rows, 1, 2000).items() if i in truth for o, c in x}
    hits = sum(value[i, o] >= truth[i][-1][1] - 1e-6 for i, x in got.items() for o in x)
    assert hits >= 0.9 * 10 * len(truth)


def test_queries_are_exact_on_many_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((12_000, 64)).astype(np.float32)
    v[::2] = v[0] + 0.02 * rng.standard_normal((6_000, 64)).astype(np.float32)  # closer than codes can tell
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>").repartition(3)
    out = N.query_neighbours(df, "chunk_id", ["vector"], F.col("chunk_id").isin([*range(0, 12_000, 801)])).collect()
    x = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    expected = set()
    for i in range(0, 12_000, 801):
        order = [int(o) for o in np.argsort(-(x @ x[i]), kind="stable") if o != i][:10]
        expected |= {(i, o, n + 1) for n, o in enumerate(order)}
    assert {(r.id, r.other, r["rank"]) for r in out} == expected


def test_empty(spark):
    df, _ = table(spark)
    assert N.similar_vectors(df.limit(0), "chunk_id", ["vector"]).count() == 0
    assert N.similar_vectors(df.where("chunk_id >= 2000"), "chunk_id", ["vector"]).count() == 0
