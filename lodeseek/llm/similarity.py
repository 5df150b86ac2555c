"""Problem 3: near-duplicate rows, by size-banded tiles with hashed bitmap signatures.

A text is the set of its token triples. Texts with equal sets are one class, so copies are compared once. Two sets of
at least the wanted similarity share a triple among the first ones of both in any common order (prefix filter); with
rare triples first, the texts that share such a triple form a tile. Within a tile, sorted by size, only sizes close
enough are paired (size bands). A pair's bitmap signatures then bound its overlap from above by counting the bits that
differ; what is left is decided by intersecting the sorted arrays. No step loses a pair.

Rarity is exact for every triple that ``FREQUENT`` texts or more hold; rarer ones count as equally rare. The frequent
ones are few, as their number times their frequency can't exceed the text; they are broadcast behind a check of their
number, and joined beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.sources.tables import cut_lineage

SIMILARITY = 0.6
MIN_TOKENS = 40
SHINGLE = 3
#: Texts that one tile holds at most; tiles of a more frequent triple are cut into pairs of blocks.
TILE = 4000
#: Triples held by fewer texts count as equally rare: their tiles are small whatever the size of the data.
FREQUENT = 8
#: Frequent triples (16 bytes each) or keys that are broadcast at most; more are joined.
BROADCAST = 1 << 21

_TOKEN = re.compile(rb"[A-Za-z0-9_]+")
_MASK = np.uint64((1 << 48) - 1)
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _TokenHashes(dict):
    def __missing__(self, token: bytes) -> int:
        value = xxhash.xxh64_intdigest(token)
        if len(self) > 1_000_000:
            self.clear()
        self[token] = value
        return value


_HASHES = _TokenHashes()


def shingle_set(text: str, width: int = SHINGLE, min_tokens: int = MIN_TOKENS) -> np.ndarray | None:
    """Sorted 48-bit hashes of the distinct runs of ``width`` tokens; None for fewer than ``min_tokens`` tokens.

    Tokens are maximal runs of ASCII letters, digits and underscores in lower case. 48 bits keep the chance of a false
    match between two texts of a thousand triples below one in a hundred million.
    """
    tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())
    if len(tokens) < max(min_tokens, width):
        return None
    hashes = _HASHES
    h = np.array([hashes[t] for t in tokens], np.uint64)
    n = len(h) - width + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (h[i : i + n] * _PRIMES[i % 5])) * _PRIMES[(i + 1) % 5]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed & _MASK)


def bitmap_bits(n: int) -> int:
    """Bits of the signature of a set of n: a power of two, at least twice n up to 64 Ki."""
    return min(1 << 16, max(256, 1 << int(2 * n - 1).bit_length()))


def bitmap(values: np.ndarray) -> bytes:
    bits = bitmap_bits(len(values))
    flags = np.zeros(bits, np.uint8)
    flags[(values % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def overlap_bounds(maps_a: list[bytes], maps_b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of each pair: every differing bit stands for an element that only one of the sets has.

    Pairs whose maps are of the same two sizes are taken as matrices.
    """
    sizes = np.array([(len(x), len(y)) for x, y in zip(maps_a, maps_b)], np.int64).reshape(-1, 2)
    differing = np.zeros(len(sizes), np.int64)
    for left, right in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == left) & (sizes[:, 1] == right))
        a = np.frombuffer(b"".join([maps_a[i] for i in at]), np.uint64).reshape(len(at), -1)
        b = np.frombuffer(b"".join([maps_b[i] for i in at]), np.uint64).reshape(len(at), -1)
        small, large = (a, b) if left <= right else (b, a)
        if large.shape[1] > small.shape[1]:  # bits are places modulo the size, so a larger map folds onto a smaller one
            large = np.bitwise_or.reduce(large.reshape(len(at), -1, small.shape[1]), axis=1)
        differing[at] = np.bitwise_count(small ^ large).sum(1)
    return (np.asarray(n_a, np.int64) + np.asarray(n_b, np.int64) - differing) // 2


def overlaps(sets_a: list[bytes], sets_b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(common elements, sum of sizes) of each pair of sorted arrays.

    The pair's number goes above the 48 bits of an element, so all pairs are intersected by one sort; up to 65,536 pairs.
    """
    pairs = np.arange(len(sets_a), dtype=np.uint64) << np.uint64(48)
    n_a, n_b = (np.array([len(x) // 8 for x in side], np.int64) for side in (sets_a, sets_b))
    both = [np.frombuffer(b"".join(side), np.uint64) | np.repeat(pairs, n) for side, n in ((sets_a, n_a), (sets_b, n_b))]
    joined = np.sort(np.concatenate(both), kind="stable")
    twice = joined[:-1][joined[1:] == joined[:-1]]
    return np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=len(sets_a)), n_a + n_b


def needed_overlap(n_a, n_b, similarity: float):
    """Least overlap with which two sets of these sizes are similar enough."""
    return np.ceil(similarity / (1 + similarity) * (n_a + n_b) - 1e-9)


TEXTS = "id long, text_key long, n int, shingles binary, signature binary"


def text_sets(rows: DataFrame, id_col: str, text_col: str, width: int, min_tokens: int) -> DataFrame:
    """id, text_key (hash of the set), n, and, once per task and set, the sorted set and its bitmap signature."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").isNotNull() & F.col("id").isNotNull())

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for ident, text in zip(batch["id"], batch["text"]):
                values = shingle_set(text, width, min_tokens)
                if values is None:
                    continue
                key = xxhash.xxh64_intdigest(values.tobytes()) - (1 << 63)
                if key in seen:
                    out.append((ident, key, len(values), None, None))
                else:
                    seen.add(key)
                    out.append((ident, key, len(values), values.tobytes(), bitmap(values)))
            yield pd.DataFrame(out, columns=["id", "text_key", "n", "shingles", "signature"])

    return rows.mapInPandas(sets, TEXTS)


def triple_counts(texts: DataFrame, buffered: int = 1 << 22) -> DataFrame:
    """triple, texts: how many texts hold each triple. Tasks add up what they hold before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [np.frombuffer(x, np.int64) for x in batch["shingles"]]
            if sum(map(len, held)) >= buffered:
                yield added(held)
                held = []
        if held:
            yield added(held)

    def added(held: list[np.ndarray]) -> pd.DataFrame:
        triples, counts = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"triple": triples, "texts": counts})

    return texts.select("shingles").mapInPandas(count, "triple long, texts long").groupBy("triple").agg(F.sum("texts").alias("texts"))


def frequent_triples(texts: DataFrame, tile: int, most: int) -> tuple[DataFrame, bool]:
    """(triple, texts of the frequent ones; whether they are at most ``most``). Where those of ``FREQUENT`` texts are too
    many, the least frequency is doubled until they aren't, up to the size of a tile."""
    frequent = cut_lineage(triple_counts(texts).where(F.col("texts") >= FREQUENT))
    level = F.floor(F.log2(F.col("texts") / FREQUENT)).cast("int").alias("level")
    counts = {r["level"]: r["count"] for r in frequent.groupBy(level).count().collect()}
    least, left = 0, sum(counts.values())
    while left > most and FREQUENT << (least + 1) <= tile:
        left -= counts.get(least, 0)
        least += 1
    return (frequent.where(F.col("texts") >= FREQUENT << least), True) if left <= most else (frequent, False)


POSTINGS = "tile long, block int, n int, place int, text_key long"


def _postings(texts: DataFrame, frequent: DataFrame, similarity: float, tile: int) -> DataFrame:
    """The triples of each text's prefix, rare ones first, with their place in that order; ``frequent`` is collected.

    A triple held by more than ``tile`` texts gets several blocks by the text's key; the text then goes into the
    tile of each pair of blocks that has its own.
    """
    rows = sorted(map(tuple, frequent.collect()))
    known = np.array(rows, np.int64).reshape(-1, 2)
    shared = texts.sparkSession.sparkContext.broadcast((known[:, 0].copy(), known[:, 1].copy()))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        triples, often_of = shared.value
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for key, raw in zip(batch["text_key"], batch["shingles"]):
                values = np.frombuffer(raw, np.int64)
                n = len(values)
                counts = np.zeros(n, np.int64)
                if len(triples):
                    at = np.minimum(np.searchsorted(triples, values), len(triples) - 1)
                    counts = np.where(triples[at] == values, often_of[at], 0)
                size = n - int(np.ceil(similarity * n - 1e-9)) + 1
                first = np.argsort(counts, kind="stable")[:size]
                chosen, often = values[first], counts[first]
                place = np.arange(len(chosen), dtype=np.int32)
                usual = often <= tile
                parts = [(chosen[usual], np.zeros(int(usual.sum()), np.int32), place[usual])]
                for at in np.flatnonzero(~usual):
                    blocks = int(-(-often[at] // tile))
                    own = key % blocks
                    pairs = np.array([min(own, j) * blocks + max(own, j) + 1 for j in range(blocks)], np.int32)
                    parts.append((np.full(blocks, chosen[at]), pairs, np.full(blocks, place[at], np.int32)))
                for a, b, c in parts:
                    if len(a):
                        for column, x in zip(columns, (a, b, np.full(len(a), n, np.int32), c, np.full(len(a), key, np.int64))):
                            column.append(x)
            if columns[0]:
                yield pd.DataFrame(dict(zip(("tile", "block", "n", "place", "text_key"), map(np.concatenate, columns))))

    return texts.select("text_key", "shingles").mapInPandas(post, POSTINGS)


def _joined_postings(texts: DataFrame, frequent: DataFrame, similarity: float, tile: int) -> DataFrame:
    """What ``_postings`` gives, with ``frequent`` joined to the texts' triples instead of being collected."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, raw in zip(batch["text_key"], batch["shingles"]):
                values = np.frombuffer(raw, np.int64)
                yield pd.DataFrame({"text_key": key, "n": np.int32(len(values)), "triple": values})

    held = texts.select("text_key", "shingles").mapInPandas(spread, "text_key long, n int, triple long").distinct()
    known = held.join(frequent, "triple", "left").withColumn("often", F.coalesce("texts", F.lit(0)))
    order = W.partitionBy("text_key").orderBy("often", "triple")
    size = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1
    first = known.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size)
    blocks = F.ceil(F.col("often") / tile).cast("int")
    own = F.pmod("text_key", blocks).cast("int")
    pair = lambda j: F.least(own, j) * blocks + F.greatest(own, j) + 1
    spread_out = F.when(F.col("often") > tile, F.transform(F.sequence(F.lit(0), blocks - 1), pair)).otherwise(F.array(F.lit(0)))
    return first.select(F.col("triple").alias("tile"), F.explode(spread_out).alias("block"), "n", F.col("place").cast("int"), "text_key")


def _tile_pairs(postings: DataFrame, similarity: float) -> DataFrame:
    """Pairs of texts in the same tile whose sizes and places allow the wanted overlap (a pair may come out repeatedly)."""
    order = ["tile", "block", "n", "text_key"]
    tiles = postings.repartition("tile", "block").sortWithinPartitions(*order)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            now = {c: batch[c].to_numpy() for c in (*order, "place")}
            if rest is not None:
                now = {c: np.concatenate([rest[c], now[c]]) for c in now}
            last = (now["tile"] == now["tile"][-1]) & (now["block"] == now["block"][-1])
            rest = {c: x[last] for c, x in now.items()}  # this tile may go on in the next batch
            yield from compare({c: x[~last] for c, x in now.items()})
        if rest is not None:
            yield from compare(rest)

    def compare(t: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        if len(t["tile"]) < 2:
            return
        new = np.ones(len(t["tile"]), bool)  # copies from different tasks lie next to each other
        new[1:] = (t["tile"][1:] != t["tile"][:-1]) | (t["block"][1:] != t["block"][:-1]) | (t["text_key"][1:] != t["text_key"][:-1])
        tile, block, n, key, place = (t[c][new] for c in (*order, "place"))
        n = n.astype(np.int64)
        at = np.arange(len(tile))
        gap = 0
        found: list[np.ndarray] = []
        while True:
            gap += 1
            at = at[at + gap < len(tile)]
            other = at + gap
            # Sizes rise within a tile: past the band of a text, no later partner fits either.
            go_on = (tile[at] == tile[other]) & (block[at] == block[other]) & (n[at] >= np.ceil(similarity * n[other] - 1e-9))
            at = at[go_on]
            if not len(at):
                break
            other = at + gap
            needed = needed_overlap(n[at], n[other], similarity)
            good = (n[at] - place[at] >= needed) & (n[other] - place[other] >= needed)
            a, b = key[at[good]], key[other[good]]
            if len(a):
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return tiles.mapInPandas(pair, "a long, b long")


def _bounded(candidates: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Candidates whose bitmaps allow the wanted overlap."""
    signatures = texts.groupBy("text_key").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
    left = signatures.select(F.col("text_key").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("map_a"))
    right = signatures.select(F.col("text_key").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("map_b"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            most = overlap_bounds(batch["map_a"].tolist(), batch["map_b"].tolist(), n_a, n_b)
            yield batch.loc[most >= needed_overlap(n_a, n_b, similarity), ["a", "b"]]

    return candidates.join(left, "a").join(right, "b").mapInPandas(bound, "a long, b long")


def _intersected(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs with their exact similarity, decided on the sorted arrays; arrays move only for texts that some pair needs."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    needed = F.broadcast(needed) if pairs.count() * 2 <= BROADCAST else needed
    arrays = texts.select("text_key", "shingles").join(needed, "text_key", "left_semi")
    arrays = arrays.groupBy("text_key").agg(F.first("shingles").alias("shingles"))
    left = arrays.select(F.col("text_key").alias("a"), F.col("shingles").alias("set_a"))
    right = arrays.select(F.col("text_key").alias("b"), F.col("shingles").alias("set_b"))

    def intersect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                common, total = overlaps(part["set_a"].tolist(), part["set_b"].tolist())
                value = common / (total - common)
                good = value >= similarity - 1e-12
                yield part.loc[good, ["a", "b"]].assign(similarity=value[good])

    return pairs.join(left, "a").join(right, "b").mapInPandas(intersect, "a long, b long, similarity double")


def _candidates(texts: DataFrame, similarity: float, tile: int, most: int) -> DataFrame:
    """Pairs of text keys that share a tile and may overlap enough by size and place."""
    frequent, few = frequent_triples(texts, tile, most)
    postings = _postings if few else _joined_postings
    return _tile_pairs(postings(texts, frequent, similarity, tile), similarity).distinct()


def similar_texts(
    rows: DataFrame,
    id_col: str,
    text_col: str,
    similarity: float = SIMILARITY,
    width: int = SHINGLE,
    min_tokens: int = MIN_TOKENS,
    tile: int = TILE,
    most: int = BROADCAST,
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has id, text_key for each row; pairs has a, b, similarity for each pair of different
    text keys of at least ``similarity``, a < b.

    Rows with equal sets of runs share a text_key and aren't listed in pairs. Rows with a null id or text or with fewer
    than ``min_tokens`` tokens take no part. Only the two named columns are read. ``most`` frequent runs are broadcast at
    most; more are joined, with the same result.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must lie in (0, 1]")
    sets = cut_lineage(text_sets(rows, id_col, text_col, width, min_tokens))
    texts = sets.where(F.col("shingles").isNotNull())
    close = cut_lineage(_bounded(_candidates(texts, similarity, tile, most), texts, similarity))
    pairs = cut_lineage(_intersected(close, texts, similarity))
    return sets.select("id", "text_key"), pairs


def similarity_stages(rows: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """stage, n: how many rows and different texts take part, and how many pairs of texts are left by the tiles, by the
    bitmaps' bound, and by the exact intersection."""
    sets = cut_lineage(text_sets(rows, id_col, text_col, SHINGLE, MIN_TOKENS))
    texts = sets.where(F.col("shingles").isNotNull())
    candidates = cut_lineage(_candidates(texts, similarity, tile, BROADCAST))
    close = cut_lineage(_bounded(candidates, texts, similarity))
    stages = {"rows": sets, "texts": sets.select("text_key").distinct(), "tiles": candidates, "bitmaps": close, "similar": _intersected(close, texts, similarity)}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, d in stages.items()]
    return reduce(DataFrame.unionByName, counts)


def row_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of rows, smaller id first: of the same text and of similar texts."""
    left = members.select(F.col("text_key").alias("a"), F.col("id").alias("id_a"))
    right = members.select(F.col("text_key").alias("b"), F.col("id").alias("id_b"))
    same = left.join(right, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b")
    other = pairs.join(left, "a").join(right, "b").where("id_a != id_b")
    other = other.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return same.unionByName(other).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, group: connected components of the edges (a, b), named by their smallest node.

    Alternates large and small stars: each node hooks its larger neighbours, then its smaller ones, to the smallest
    node it knows. The number of rounds is logarithmic in the longest chain; every round is written to the shared folder.
    """
    edges = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        after = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = cut_lineage(after.where("u != v").distinct())
        before, state = state, after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        edges = after
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(
        roots.select("node", F.col("node").alias("group"))
    )


def near_duplicate_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each row that takes part: id, class_id (smallest id with the same text), links (rows of at least the
    wanted similarity), group_id (smallest class of all that are linked, directly or through others)."""
    classes = members.groupBy("text_key").agg(F.min("id").alias("class_id"), F.count("*").alias("rows"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("text_key").alias("b"), "rows")
    links = both.join(size, "b").groupBy(F.col("a").alias("text_key")).agg(F.sum("rows").alias("others"))
    named = classes.select("text_key", "class_id")
    a = named.select(F.col("text_key").alias("a"), F.col("class_id").alias("class_a"))
    b = named.select(F.col("text_key").alias("b"), F.col("class_id").alias("class_b"))
    edges = pairs.join(a, "a").join(b, "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    groups = components(edges).select(F.col("node").alias("class_id"), F.col("group").alias("group_id"))
    known = classes.join(links, "text_key", "left").join(groups, "class_id", "left")
    known = known.select(
        "text_key",
        "class_id",
        (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("links"),
        F.coalesce("group_id", "class_id").alias("group_id"),
    )
    return members.join(known, "text_key").select("id", "class_id", "links", "group_id")
