"""Problem 8: mixing sources to target weights by hierarchical budgeting.

The targets hang in a tree of domain, language and source. Budgets flow from the root: every node shares its budget
among its children by weight, none gets more than its texts can give when repeated ``max_repeat`` times, and what one
leaves over goes to its siblings before it is returned to the parent's level. Every leaf then takes whole epochs of its
texts and a prefix, in seeded order, of one more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.llm.tokens import token_count
from lodeseek.sources.tables import cut_lineage

#: Domains of the tree by the last word of the source's name; other sources form the domain "other".
DOMAINS = {
    "conversation": ("threads", "comments", "answers", "exports", "list", "mail", "messages", "logs"),
    "documentation": ("files", "pages", "notes", "guides", "tutorials", "glossaries", "runbooks"),
}
#: Slices of the seeded order of a leaf: no task sorts more than one slice of a source.
SLICES = 1024


def domain_of(source: Column) -> Column:
    last = F.element_at(F.split(source, "_"), -1)
    out = F.lit("other")
    for domain, words in DOMAINS.items():
        out = F.when(last.isin(*words), F.lit(domain)).otherwise(out)
    return out


def language_of(lang: Column) -> Column:
    """Primary language tag in lower case; "und" if there is none."""
    tag = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})\b", 1))
    return F.when(F.coalesce(tag, F.lit("")) == "", "und").otherwise(tag)


def sized_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang (primary tag) and tokens of each document; a null text has no tokens."""
    return documents.select(
        "doc_id",
        "source",
        language_of(F.col("lang")).alias("lang"),
        F.coalesce(token_count(F.col("text"), tokenizer), F.lit(0)).alias("tokens"),
    )


def _share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Divide each parent's ``parent_budget`` among its children by weight, none above its capacity.

    In the order of capacity per weight, a child is full exactly if the water level that fills it costs no more than
    the budget; the others share what is left by weight. Needs weight > 0; adds ``budget``.
    """
    key = [F.col(c) for c in parent] or [F.lit(0)]
    order = W.partitionBy(*key).orderBy(F.col("capacity") / F.col("weight"), "node")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*key)
    ratio = F.col("capacity") / F.col("weight")
    filled = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    nodes = nodes.withColumn("full", filled + ratio * open_weight <= F.col("parent_budget") * (1 + 1e-12))
    left = F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(whole)
    weights = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole)
    return nodes.withColumn(
        "budget", F.when(F.col("full"), F.col("capacity")).otherwise(left * F.col("weight") / weights)
    )


def plan_mix(sized: DataFrame, targets: DataFrame, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """Budgets of the leaves: domain, lang, source, target_share, max_repeat, tokens, weight, capacity, total, budget.

    ``sized`` has source, lang and tokens (see ``sized_documents``). A leaf's weight is its source's target share,
    divided among the languages by tokens; its capacity is ``max_repeat`` times its tokens. A source without documents
    keeps its target with language "und" and capacity 0. The size of the mix is that of all documents. Targets that are
    null or not positive, and null sources, take no part; a null or negative ``max_repeat`` counts as 0; if a source is
    named twice, its targets are added and the larger ``max_repeat`` holds. ``domain`` groups the sources at the top of the tree. The tables here have one row a source and
    language, after one aggregation of the documents.
    """
    size = sized.groupBy("source", "lang").agg(F.sum("tokens").cast("double").alias("tokens"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total"))
    wanted = (
        targets.where((F.col("target_share") > 0) & F.col("source").isNotNull())
        .groupBy("source")
        .agg(
            F.sum("target_share").alias("target_share"),
            F.greatest(F.coalesce(F.max("max_repeat"), F.lit(0)), F.lit(0)).alias("max_repeat"),
        )
    )
    own = F.sum("tokens").over(W.partitionBy("source"))
    leaves = (
        wanted.join(size.where(F.col("tokens") > 0), "source", "left")
        .withColumn("lang", F.coalesce("lang", F.lit("und")))
        .withColumn("tokens", F.coalesce("tokens", F.lit(0.0)))
        .withColumn("weight", F.when(own > 0, F.col("target_share") * F.col("tokens") / own).otherwise(F.col("target_share")))
        .withColumn("capacity", F.col("tokens") * F.col("max_repeat"))
        .withColumn("domain", domain(F.col("source")))
        .crossJoin(F.broadcast(total))  # one row
    )
    root = W.partitionBy(F.lit(0))
    planned = leaves.withColumn("parent_budget", F.least("total", F.sum("capacity").over(root)))
    for level in (["domain"], ["domain", "lang"], ["domain", "lang", "source"]):
        parent = level[:-1]
        nodes = planned.groupBy(*level).agg(
            F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"), F.first("parent_budget").alias("parent_budget")
        )
        nodes = _share_out(nodes.withColumn("node", F.concat_ws("\t", *level)), parent)
        planned = planned.drop("parent_budget").join(nodes.select(*level, F.col("budget").alias("parent_budget")), level)
    return planned.withColumnRenamed("parent_budget", "budget")


def short_sources(plan: DataFrame) -> DataFrame:
    """Sources that the budgets leave short, although what others don't use was offered to them: all their leaves are
    full, and what they got is less than the target share of the total. Columns: source, target, budget."""
    full = F.min((F.col("budget") >= F.col("capacity") * (1 - 1e-9)).cast("int"))
    by_source = plan.groupBy("source").agg(
        (F.first("target_share") * F.first("total")).alias("target"), F.sum("budget").alias("budget"), full.alias("full")
    )
    return by_source.where((F.col("full") == 1) & (F.col("budget") < F.col("target") * (1 - 1e-9))).drop("full")


def select_mix(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """How often each document is taken: doc_id, source, lang, tokens, copies (at least 1).

    A leaf's budget buys whole epochs of its documents; of one more epoch, documents are taken in the order of a seeded
    hash while their tokens fit the rest. Prefix sums are taken in two steps, over slices of the hash range and within
    the slice where the budget ends, so that no task orders more than a slice of a source.
    """
    leaf = ["source", "lang"]
    budgets = plan.select(
        *leaf,
        F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.col("max_repeat")).alias("epochs"),
        "budget",
        F.col("tokens").alias("leaf_tokens"),
    ).where((F.col("leaf_tokens") > 0) & (F.col("budget") > 0))
    budgets = budgets.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens")).drop("budget", "leaf_tokens")
    rows = sized.where(F.col("tokens") > 0).withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("slice", F.pmod(F.shiftright("place", 32), F.lit(SLICES)))
    by_slice = rows.groupBy(*leaf, "slice").agg(F.sum("tokens").alias("slice_tokens"))
    before = W.partitionBy(*leaf).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("before", F.coalesce(F.sum("slice_tokens").over(before), F.lit(0)))
    cut = by_slice.join(budgets, leaf).withColumn(
        "part",
        F.when(F.col("before") + F.col("slice_tokens") <= F.col("rest"), "all")
        .when(F.col("before") < F.col("rest"), "some")
        .otherwise("none"),
    )
    rows = rows.join(cut.select(*leaf, "slice", "epochs", "rest", "before", "part"), [*leaf, "slice"])
    within = W.partitionBy(*leaf, "slice").orderBy("place", "doc_id")
    some = rows.where(F.col("part") == "some").withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    some = some.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    rest = rows.where(F.col("part") != "some").withColumn("extra", (F.col("part") == "all").cast("int"))
    out = rest.unionByName(some).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("int"))
    return out.where(F.col("copies") > 0).select("doc_id", *leaf, "tokens", "copies")


def mix_shares(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """What the mix reaches: source, target_share, actual_share, tokens, max_copies, for every source of the plan."""
    taken = selected.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_copies")
    )
    everything = taken.agg(F.sum("tokens").alias("mix_tokens"))
    sources = plan.groupBy("source").agg(F.first("target_share").alias("target_share"))
    joined = sources.join(taken, "source", "left").crossJoin(F.broadcast(everything))  # one row
    return joined.select(
        "source",
        "target_share",
        F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of the mix; token counts are made once and written to the shared folder."""
    sized = cut_lineage(sized_documents(documents, tokenizer))
    plan = cut_lineage(plan_mix(sized, targets))
    selected = select_mix(sized, plan, seed)
    return selected, mix_shares(selected, plan)
