import math

from pyspark.sql import functions as F

from lodeseek.functions import vector as V
from lodeseek.functions.embed import embed
from lodeseek.operators import search

SCHEMA = "id string, file_path string, start_line int, end_line int, symbol string, content string, summary string, v array<float>, s array<float>"


def table(spark):
    def row(i, v, s=None, summary=None):
        return (i, f"{i}.py", 0, 3, "" if i == "a" else i, "one\ntwo\nthree\nfour", summary, v, s)

    rows = [
        row("a", [0.1, 0.0]), row("b", [0.6, 0.0], [0.0, 0.0], "has one"), row("c", [0.6, 0.0], None, "vector missing"), row("d", None),
        row("e", [1.0]), row("f", [float("nan"), 0.0]), row("b", [9.0, 9.0], [0.5, 0.0], "again"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_knn_ties_nulls_and_lengths(spark):
    hits = search.knn(table(spark), [0.0, 0.0], "id", "v", k=3).collect()
    assert [r.id for r in hits] == ["a", "b", "c"] and abs(hits[1].score - 0.6) < 1e-6
    squared = search.knn(table(spark), [0.0, 0.0], "id", "v", k=2, metric="squared_l2").collect()
    assert abs(squared[1].score - 0.36) < 1e-6
    assert search.knn(table(spark).limit(0), [0.0, 0.0], "id", "v").count() == 0
    nobody = search.query_vector(table(spark), "id", "v", "zz")
    assert search.knn(table(spark), nobody, "id", "v").count() == 0


def test_prefilter(spark):
    hits = search.knn(table(spark), [0.0, 0.0], "id", "s", where=F.col("summary").isNotNull()).collect()
    assert [r.summary for r in hits] == ["has one", "again"]


def test_min_score_comes_after_the_top_k(spark):
    hits = search.knn(table(spark), [0.0, 0.0], "id", "v", k=2)
    assert [r.id for r in search.min_score(hits, 0.5).collect()] == ["b"]
    assert search.min_score(search.knn(table(spark), [0.0, 0.0], "id", "v", k=1), 0.5).count() == 0
    assert [r.id for r in search.max_distance(hits, 0.5).collect()] == ["a"]


def test_fusion(spark):
    content = search.knn(table(spark), [0.0, 0.0], "id", "v", k=10).select("id", "content", "summary", "score")
    summary = search.knn(table(spark), [0.0, 0.0], "id", "s", k=10).select("id", "content", "summary", "score")
    fused = {r.id: r for r in search.fuse([content, summary], "id").collect()}
    assert abs(fused["b"].score - (1 / 62 + 1 / 64 + 1 / 61 + 1 / 62)) < 1e-12 and fused["b"].summary == "has one"
    swapped = {r.id: r.score for r in search.fuse([summary, content], "id").collect()}
    assert {i: r.score for i, r in fused.items()} == swapped
    assert search.fuse([content.limit(0), summary.limit(0)], "id").count() == 0


def test_rendering(spark):
    hits = search.ranked(search.knn(table(spark), [0.0, 0.0], "id", "v", k=2), "score", "id")
    lines = [r[0] for r in hits.select(search.text_line("dist")).collect()]
    assert lines == ["[1] dist:0.1000  a.py:0-3", "[2] dist:0.6000  b.py:0-3  b"]
    block = [r[0] for r in hits.select(search.text_block("dist")).collect()]
    assert block[0].split("\n")[1:] == ["  one", "  two", "  three"] and block[1].split("\n")[1] == "  has one"
    json = hits.select(search.json_object()).first()[0]
    assert json.startswith('{"rank":1,"file_path":"a.py","start_line":0') and json.endswith('"summary":null}')


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([float("inf"), 1.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.usable(F.col("v"), 2)).collect()] == [True, False, False, False]
    assert df.select(V.normalized(F.col("v"))).first()[0] == [0.6, 0.8]
    assert [r[0] for r in df.limit(2).select(V.normalized(F.col("v"))).collect()][1] is None


def test_embedding(spark):
    df = spark.createDataFrame([("parse the fileName",), ("parse the fileName",), ("!!",), (None,)], "t string")
    got = [r[0] for r in df.select(embed(F.col("t"), 16)).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] is None and abs(math.hypot(*got[0]) - 1) < 1e-6
