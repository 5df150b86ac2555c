from lodeseek.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, tokens string, domain int"


def docs(spark):
    rows = [(i, "some words here " * 20, "en" if i % 3 else "de-DE", "big_files", "x", 1) for i in range(300)]
    rows += [(1000 + i, "other words there " * 20, None, "small_notes", "x", 1) for i in range(10)]
    rows += [(2000, None, "en", "big_files", "x", 1), (2001, "", "en", "big_files", "x", 1), (2002, "text", "en", None, "x", 1)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    rows = [("big_files", 0.4, 3), ("small_notes", 0.5, 2), ("missing_list", 0.1, 5), (None, 0.3, 1), ("big_files", None, 1)]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeat int")


def test_budgets_and_shares(spark):
    sized = M.sized_documents(docs(spark)).cache()
    plan = M.plan_mix(sized, targets(spark)).cache()
    rows = plan.collect()
    assert {(r.source, r.lang) for r in rows} == {
        ("big_files", "en"), ("big_files", "de"), ("small_notes", "und"), ("missing_list", "und")
    }
    total = rows[0].total
    assert abs(sum(r.budget for r in rows) - total) < 1e-6 * total  # big_files makes up for the others
    assert all(r.budget <= r.capacity + 1e-6 for r in rows)
    assert {r.source for r in M.short_sources(plan).collect()} == {"small_notes", "missing_list"}
    selected = M.select_mix(sized, plan).collect()
    assert len({r.doc_id for r in selected}) == len(selected) and min(r.copies for r in selected) >= 1
    for r in rows:
        got = sum(s.tokens * s.copies for s in selected if (s.source, s.lang) == (r.source, r.lang))
        assert got <= r.budget + 1e-6 and got >= r.budget - 100
        assert all(s.copies <= r.max_repeat for s in selected if s.source == r.source)
    again = M.select_mix(sized, plan).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in selected}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a_files", "en", 100), ("b_files", "en", 1000), ("c_list", "en", 1000)]
    sized = spark.createDataFrame(rows, "source string, lang string, tokens long")
    wanted = spark.createDataFrame([("a_files", 0.4, 1), ("b_files", 0.1, 2), ("c_list", 0.5, 2)], "source string, target_share double, max_repeat int")
    budget = {r.source: r.budget for r in M.plan_mix(sized, wanted).collect()}
    assert abs(budget["a_files"] - 100) < 1e-6 and abs(budget["b_files"] - 950) < 1e-6 and abs(budget["c_list"] - 1050) < 1e-6


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    selected, shares = M.mix(none, targets(spark))
    assert selected.count() == 0
    assert {(r.source, r.actual_share, r.tokens) for r in shares.collect()} == {
        ("big_files", 0.0, 0), ("small_notes", 0.0, 0), ("missing_list", 0.0, 0)
    }
    assert M.mix(docs(spark), targets(spark).limit(0))[1].count() == 0
