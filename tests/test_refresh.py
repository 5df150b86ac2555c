import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import bursts, refresh
from lodeseek.plans.indexer import refresh as run_refresh
from lodeseek.sources.events import Watched, watch
from lodeseek.sources.listing import list_files, read_files
from lodeseek.sources.snapshots import Store
from lodeseek.streaming.debounce import debounced, refresh_on

digest = lambda b: hashlib.sha256(b).hexdigest()


def listing(spark, files):
    return spark.createDataFrame([(p, b, None, "clash") for p, b in files], "rel_path string, bytes binary, error string, status string")


def test_classify_and_count(spark):
    stored = [("same.py", digest(b"x")), ("same.py", digest(b"x")), ("old.py", "0"), ("gone.py", "1"), ("bin.py", "2"), (None, "3")]
    chunks = spark.createDataFrame(stored, "file_path string, file_hash string")
    files = listing(spark, [("same.py", b"x"), ("old.py", b"y"), ("new'.py", b"z"), ("bin.py", b"\xff"), ("lost.py", None), ("empty.py", b""), (None, b"q"), ("same.py", b"x")])
    got = {r.file_path: r.status for r in refresh.classify(files, chunks).collect()}
    assert got == {"same.py": "unchanged", "old.py": "changed", "new'.py": "new", "gone.py": "removed", "bin.py": "changed", "lost.py": "unreadable", "empty.py": "new"}
    counts = {r.outcome: r.files for r in refresh.counters(files, chunks).collect()}
    assert counts == {"skipped": 3, "indexed": 2, "purged": 1, "unreadable": 1}
    assert refresh.classify(files.limit(0), chunks.limit(0)).count() == 0


def test_upsert(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "file_path string, n int")
    fresh = spark.createDataFrame([("b", 9), ("c", 8)], "file_path string, n int")
    gone = spark.createDataFrame([("a",), ("a",)], "file_path string")
    assert sorted(tuple(r) for r in refresh.upsert(chunks, fresh, gone).select("n").collect()) == [(4,), (8,), (9,)]
    assert tuple(refresh.stats(chunks).first()) == (4, 2)


def test_index_is_kept_current(spark, tmp_path):
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text('def f():\n    """Says what f does."""\n    return 1\n')
    (root / "__init__.py").write_text("x = 1\n")
    (root / ".git").mkdir()
    (root / ".git/h.py").write_text("x = 1\n")
    (root / "note.txt").write_text("x\n")
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    written = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    look = lambda: read_files(list_files(spark, str(root)))
    counts = {r.status: r.files for r in run_refresh(look(), store).collect()}
    assert counts == {"new": 2} and {r.id for r in store.read().collect()} == {"src/a.py:0", "__init__.py:0"}
    assert store.dim() == 64
    first = written()
    run_refresh(look(), store)
    assert written() == first  # nothing changed, nothing written
    (root / "src/a.py").write_text("def g():\n    return 2\n\ndef h():\n    return 3\n")
    (root / "__init__.py").unlink()
    (root / "src/o'b.go").write_text("package p\n\nfunc F() {\n}\n")
    counts = {r.status: r.files for r in run_refresh(look(), store).collect()}
    assert counts == {"new": 1, "changed": 1, "removed": 1}
    assert 2 <= len({p.parent.name for p in written().keys() & first.keys()}) < 8  # partitions of other files are left alone
    assert {r.symbol for r in store.read().collect()} == {"g", "h", "F"}
    again = Store(spark, str(tmp_path / "other"))
    run_refresh(look(), again)
    rows = lambda s: sorted(tuple(r)[:9] for r in s.read().collect())
    assert rows(store) == rows(again)
    with pytest.raises(Exception, match="64 elements"):
        store.replace(store.read().withColumn("vector", F.slice("vector", 1, 3)))
    assert store.read().count() == 3
    store.clear()
    assert store.read().count() == 0
    store.drop()
    assert not store.exists() and store.read().count() == 0


EVENTS = "path string, kind string, ts timestamp, start long"


def events(spark, rows):
    df = spark.createDataFrame([(p, k, m, 1) for p, k, m in rows], "path string, kind string, micros long, start long")
    return df.select("path", "kind", F.timestamp_micros("micros").alias("ts"), "start")


def fold(rows, width):
    out = []
    for root, group in itertools.groupby(sorted((p.split("/")[0], m) for p, k, m in rows), key=lambda x: x[0]):
        start = None
        for _, at in group:
            if start is None or at > start + width:
                out.append([root, at, at, 0])
                start = at
            out[-1][2:] = [at, out[-1][3] + 1]
    return sorted(map(tuple, out))


def test_bursts(spark):
    assert [tuple(r)[1:] for r in bursts.debounce(events(spark, [("a/x", "modify", t * 1000) for t in (0, 400, 600)])).collect()] == [(0, 400_000, 2), (600_000, 600_000, 1)]
    rows = [(f"{'ab'[i % 2]}/f", "modify", (i * i * 37) % 90_000) for i in range(400)] + [("a/f", "create", 5)] * 3
    df = events(spark, rows + [("a/f", "rename", 1), (None, "modify", 2)])
    for slices in (2, 7200):
        assert sorted(map(tuple, bursts.debounce(df, 1000, slices).collect())) == fold(rows, 1000)
    assert bursts.debounce(df.limit(0)).count() == 0


def test_stream_gives_the_same_bursts(spark, tmp_path):
    rows = [(f"{'ab'[i % 2]}/f", "modify", 10**11 + (i * i * 37) % 90_000_000 * 10) for i in range(200)]
    events(spark, rows).drop("start").repartition(3).write.parquet(str(tmp_path / "in"))
    events(spark, [("z/f", "modify", 10**12)]).drop("start").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, kind string, ts timestamp").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    query = debounced(stream, 1_000_000, "1 hour").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("bursts").where("root != 'z'").collect()))
    assert got == fold(rows, 1_000_000)


def test_refresh_survives_a_failure(spark, tmp_path):
    events(spark, [("a/x", "modify", 1), ("a/x", "modify", 2), ("b/y", "rename", 3)]).drop("start").write.parquet(str(tmp_path / "in"))
    seen = []

    def refresh_paths(paths):
        seen.extend(r.path for r in paths.collect())
        raise RuntimeError("told on purpose")

    stream = spark.readStream.schema("path string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    query = refresh_on(stream, refresh_paths, str(tmp_path / "check"), availableNow=True)
    query.awaitTermination()
    assert seen == ["a/x"] and query.exception() is None


def test_listing_prunes_and_spreads(spark, tmp_path):
    for path in ("a/b/c/x.py", "a/node_modules/q/y.py", "a/.h/z.py", "a/.z.py", "top.go", "a/b/n.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("1")
    (tmp_path / "a/link.py").symlink_to(tmp_path / "top.go")
    (tmp_path / "a/node_modules").chmod(0)  # would be an error to enter
    found = {r.rel_path: r for r in list_files(spark, str(tmp_path), exclude=["**/node_modules/**"]).collect()}
    (tmp_path / "a/node_modules").chmod(0o755)
    assert set(found) == {"a/b/c/x.py", "a/.z.py", "top.go"}
    assert found["top.go"].abs_path == str(tmp_path / "top.go") and found["top.go"].size == 1
    assert list_files(spark, str(tmp_path / "none")).count() == 0


def test_directory_changes(spark, tmp_path):
    root, seen = tmp_path / "root", []
    root.mkdir()

    def told(df):
        seen.append(sorted((r.path, r.kind) for r in df.collect()))

    look = lambda handle=told: Watched(spark, str(root), str(tmp_path / "state")).look(handle)
    assert look() and not look() and seen == []
    (root / "a.py").write_text("1")
    (root / "c.py").write_text("1")
    assert look() and seen.pop() == [("a.py", "create"), ("c.py", "create")]
    (root / "a.py").write_text("12")
    (root / "b.py").write_text("1")
    (root / "c.py").unlink()
    with pytest.raises(RuntimeError):
        look(lambda df: (_ for _ in ()).throw(RuntimeError("told on purpose")))
    assert look() and seen.pop() == [("a.py", "modify"), ("b.py", "create"), ("c.py", "remove")]
    assert not look()
    (root / "b.py").unlink()
    query = watch(Watched(spark, str(root), str(tmp_path / "state")), told, str(tmp_path / "ticks"))
    for _ in range(120):
        if seen:
            break
        query.awaitTermination(1)
    query.stop()
    assert seen == [[("b.py", "remove")]]
