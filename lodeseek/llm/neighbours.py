"""Problem 4: the most similar vectors of every vector, with additive quantisation.

A vector is written as a sum of codewords from full-dimensional codebooks; codes are chosen by beam search over the
codebooks' residuals, and the norm of the sum is stored. The first two codes name a cell. Each vector looks into the
cells whose partial sums score best against it and scores the codes it finds there from lookup tables. Candidates whose
score, given the error of the codes, may reach the wanted cosine are reranked with the exact vectors; where these are
many, the exact vectors of the whole block are compared.

The codebooks are fitted on a bounded sample; every vector is indexed and is a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.vector import usable
from lodeseek.sources.tables import cut_lineage

DIM = 64
K = 10
MIN_COSINE = 0.9
#: Vectors on which the codebooks are fitted, at most.
SAMPLE = 12_288
#: Codewords of each codebook behind the two that name the cell, and the number of these codebooks.
WORDS, BOOKS = 256, 8
BEAM = 3
#: Rounds of encoding the sample and fitting all codewords anew.
REFITS = 1
#: Vectors that a cell should hold on average, and cells that a query looks into if there are 4,096 or fewer (see ``probes_of``).
CELL, PROBES = 48, 16
#: Members of a cell that one task compares with the queries; a fuller cell is cut into blocks.
BLOCK = 4096
#: Candidates of a query in a block of a cell beyond which it is compared with the block's exact vectors instead.
KEEP = 64
#: Copies of one vector that one task gives their partners; more are divided among tasks.
HOT = 50_000
#: Products of unit vectors in single precision are off by less; what lies so close behind the k-th best is kept.
SLACK = 2e-5


@dataclass
class Codebooks:
    """Codebooks of unit vectors; the first two name the cell."""

    words: list[np.ndarray]
    threshold: float = 0.0
    starts: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.all = np.concatenate(self.words)
        self.starts = np.cumsum([0, *map(len, self.words)]).tolist()
        self.norms = np.einsum("ij,ij->i", self.all, self.all).astype(np.float32)

    def encode(self, vectors: np.ndarray, beam: int = BEAM, books: int | None = None) -> np.ndarray:
        """Codes (places in the joined codebooks) of each vector by beam search, best first: (n, beam, books)."""
        books = len(self.words) if books is None else books
        n, dim = vectors.shape
        codes = np.zeros((n, 1, 0), np.int64)
        rest = vectors[:, None, :]
        error = np.einsum("ij,ij->i", vectors, vectors)[:, None]
        for b in range(books):
            words = self.words[b]
            norms = self.norms[self.starts[b] : self.starts[b + 1]]
            total = (error[:, :, None] - 2 * (rest @ words.T) + norms).reshape(n, -1)
            keep = min(beam, total.shape[1])
            if keep < total.shape[1]:
                best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            else:
                best = np.broadcast_to(np.arange(keep), total.shape)
            value = np.take_along_axis(total, best, 1)
            order = np.argsort(value, axis=1, kind="stable")
            best, error = np.take_along_axis(best, order, 1), np.take_along_axis(value, order, 1)
            parent, word = best // len(words), best % len(words)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), (word + self.starts[b])[:, :, None]], axis=2)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.all[codes].sum(-2)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        return codes[..., 0] * len(self.words[1]) + codes[..., 1] - self.starts[1]


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        score = points @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres)
        nearest = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        for empty in np.flatnonzero(counts == 0):
            centres[empty] = points[rng.integers(len(points))]
    return centres.astype(np.float32)


def _refit(books: Codebooks, sample: np.ndarray, ridge: float = 0.05) -> Codebooks:
    """All codewords at once by least squares, with the codes that the beam finds now."""
    size = len(books.all)
    gram, right = np.zeros((size, size), np.float32), np.zeros((size, sample.shape[1]), np.float32)
    for part in np.array_split(sample, max(1, len(sample) // 1024)):
        codes = books.encode(part)[:, 0]
        chosen = np.zeros((len(part), size), np.float32)
        np.put_along_axis(chosen, codes, 1.0, 1)
        gram += chosen.T @ chosen
        right += chosen.T @ part
    gram[np.diag_indices(size)] += ridge
    words = np.linalg.solve(gram.astype(np.float64), (right + ridge * books.all).astype(np.float64)).astype(np.float32)
    return Codebooks(np.split(words, books.starts[1:-1]))


def fit(sample: np.ndarray, total: int, min_cosine: float, seed: int = 11) -> Codebooks:
    """Codebooks for a collection of ``total`` vectors: residual k-means, then one pass that refits each codebook."""
    rng = np.random.default_rng(seed)
    cell_words = int(2 ** np.clip(np.ceil(np.log2(max(total / CELL, 1)) / 2), 2, 12))
    sizes = [cell_words, cell_words, *[WORDS] * BOOKS]
    residual, words = sample.copy(), []
    for size in sizes:
        words.append(_kmeans(residual, size, rng))
        score = residual @ words[-1].T - 0.5 * np.einsum("ij,ij->i", words[-1], words[-1])
        residual = residual - words[-1][score.argmax(1)]
    books = Codebooks(words)
    for _ in range(REFITS):
        books = _refit(books, sample)
    # How far the approximate cosine of two codes may fall below the cosine: measured on sampled vectors and noisy copies.
    some = sample[: min(len(sample), 2048)]
    noise = rng.standard_normal(some.shape).astype(np.float32)
    noise -= np.einsum("ij,ij->i", noise, some)[:, None] * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-9)
    copies = min_cosine * some + np.sqrt(1 - min_cosine**2) * noise
    a, b = (books.decode(books.encode(x.astype(np.float32))[:, 0]) for x in (some, copies))
    approximate = np.einsum("ij,ij->i", a, b) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-9)
    # Codes that fit the sample closely give its vectors' cosines as they are, whatever they make of the noisy copies.
    fidelity = np.einsum("ij,ij->i", some, a).sum() / max(np.linalg.norm(a, axis=1).sum(), 1e-9)
    books.threshold = min(float(np.quantile(approximate, 0.001)), min_cosine * fidelity**2) - 0.02
    return books


def probes_of(books: Codebooks, probes: int = PROBES) -> int:
    """Cells to look into: more where there are more, or the share of partners' cells among them would fall."""
    cells = len(books.words[0]) * len(books.words[1])
    return round(probes * max(1.0, cells / 4096) ** (1 / 6))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def usable_vectors(rows: DataFrame, id_col: str, fields: list[str], dim: int = DIM) -> DataFrame:
    """field, id, vector for each usable vector: of ``dim`` finite elements, not all zero. Null ids are left out."""
    rows = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *fields)
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("array<float>").alias("vector")) for f in fields])
    return rows.select("id", F.inline(listed)).where(usable(F.col("vector"), dim))


def _vector_key(vector: Column) -> Column:
    return F.xxhash64(vector, F.lit(1))


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: field, id, class_key; classes: field, class_key, vector): equal vectors of a field are one class."""
    keyed = vectors.withColumn("class_key", _vector_key(F.col("vector")))
    classes = keyed.groupBy("field", "class_key", "vector").agg(F.lit(1).alias("one")).drop("one")
    return keyed.select("field", "id", "class_key"), classes.dropDuplicates(["field", "class_key"])


def fit_fields(classes: DataFrame, fields: list[str], min_cosine: float, sample: int = SAMPLE) -> dict[str, Codebooks]:
    """Codebooks of each field, from at most ``sample`` of its vectors: those with the smallest hashes."""
    counts = {r["field"]: r["count"] for r in classes.groupBy("field").count().collect()}
    books = {}
    for name in fields:
        total = counts.get(name, 0)
        if not total:
            continue
        part = classes.where(F.col("field") == name)
        if total > sample:  # a little more than needed, then cut: the hash decides, so the choice doesn't change
            bound = int(min(1.0, 1.1 * sample / total + 1e-9) * (2**63 - 1))
            part = part.where(F.abs(F.xxhash64("class_key", F.lit(5))) <= bound)
        rows = part.orderBy(F.xxhash64("class_key", F.lit(5)), "class_key").limit(sample).select("vector").collect()
        books[name] = fit(_unit(np.array([r.vector for r in rows], np.float64)), total, min_cosine)
    return books


CODED = "field string, class_key long, codes binary, norm float, cells array<int>"


def encode_classes(classes: DataFrame, books: dict[str, Codebooks], probes: int = PROBES) -> DataFrame:
    """Codes, stored norm of the sum, and the cells to look into (the own one first) of each class."""
    shared = classes.sparkSession.sparkContext.broadcast(books)  # codebooks: bounded by the parameters

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("field", sort=False):
                b = shared.value[name]
                looked = probes_of(b, probes)
                for at in range(0, len(group), 1024):
                    part = group.iloc[at : at + 1024]
                    x = _unit(_stack(part["vector"]))
                    codes = b.encode(x)[:, 0]
                    ways = b.cells(b.encode(x, looked, 2))
                    norms = np.linalg.norm(b.decode(codes), axis=1)
                    own = b.cells(codes)
                    cells = [[int(o), *(int(c) for c in w if c != o)][:looked] for o, w in zip(own, ways)]
                    yield pd.DataFrame(
                        {
                            "field": name,
                            "class_key": part["class_key"].to_numpy(),
                            "codes": [c.astype(np.uint16).tobytes() for c in codes],
                            "norm": norms.astype(np.float32),
                            "cells": cells,
                        }
                    )

    return classes.select("field", "class_key", "vector").mapInPandas(encode, CODED)


def _cell_candidates(
    coded: DataFrame, classes: DataFrame, books: dict[str, Codebooks], keep: int, block: int, k: int, min_cosine: float
) -> DataFrame:
    """a, b: pairs of classes of which one found the other in a cell with a score at the threshold or above.

    Where a query finds more than ``keep`` in a block, codes can't rank them: ``_dense_pairs`` compares the vectors.
    """
    own = F.element_at("cells", 1)
    sizes = coded.groupBy("field", own.alias("cell")).agg(F.count("*").alias("size"))
    blocks = sizes.select("field", "cell", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    # Members lie in one block of their cell; queries visit every block of every cell they look into.
    probe = coded.select("field", "class_key", "codes", "norm", F.posexplode("cells").alias("rank", "cell"))
    probe = probe.join(blocks, ["field", "cell"])
    pick = F.pmod(F.xxhash64("class_key", F.lit(9)), F.col("blocks")).cast("int")
    members = probe.where("rank = 0").select("field", "cell", pick.alias("block"), F.lit(0).alias("role"), "class_key", "codes", "norm")
    queries = probe.select(
        "field", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "class_key", "codes", "norm"
    )
    order = ["field", "cell", "block", "role"]
    both = members.unionByName(queries).repartition("field", "cell", "block").sortWithinPartitions(*order)
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, keys, codes, norms = None, None, None, None
        for batch in batches:
            same = (batch[["field", "cell", "block", "role"]] != batch[["field", "cell", "block", "role"]].shift()).any(axis=1).cumsum()
            out = []
            for _, g in batch.groupby(same.to_numpy(), sort=False):
                name, cell, part, role = g["field"].iloc[0], g["cell"].iloc[0], g["block"].iloc[0], g["role"].iloc[0]
                own_codes = np.frombuffer(b"".join(g["codes"]), np.uint16).reshape(len(g), -1).astype(np.int64)
                own_keys, own_norms = g["class_key"].to_numpy(), g["norm"].to_numpy()
                if role == 0:
                    if (name, cell, part) == place:  # the block's members go on in this batch
                        keys, codes, norms = np.append(keys, own_keys), np.append(codes, own_codes, 0), np.append(norms, own_norms)
                    else:
                        place, keys, codes, norms = (name, cell, part), own_keys, own_codes, own_norms
                elif (name, cell, part) == place:
                    for at in range(0, len(g), 1024):
                        q = slice(at, at + 1024)
                        pairs, many = score(shared.value[name], own_keys[q], own_codes[q], own_norms[q], keys, codes, norms)
                        out.append(pd.DataFrame({"field": name, "a": pairs[:, 0], "b": pairs[:, 1], "cell": -1, "block": -1}))
                        out.append(pd.DataFrame({"field": name, "a": many, "b": 0, "cell": cell, "block": part}))
            if out:
                yield pd.concat(out).drop_duplicates()

    def score(b: Codebooks, q_keys, q_codes, q_norms, keys, codes, norms) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (smaller key, larger key) from lookup tables, which hold a query's products with all codewords; then
        the queries with more than ``keep`` candidates, whose pairs are left out."""
        tables = b.decode(q_codes) @ b.all.T
        products = np.zeros((len(q_keys), len(keys)), np.float32)
        for m in range(codes.shape[1]):
            products += tables[:, codes[:, m]]
        cosine = products / np.maximum(q_norms[:, None] * norms[None, :], 1e-9)
        good = (cosine >= b.threshold) & (q_keys[:, None] != keys[None, :])
        full = good.sum(1) > keep
        good[full] = False
        i, j = np.nonzero(good)
        return np.stack([np.minimum(q_keys[i], keys[j]), np.maximum(q_keys[i], keys[j])], axis=1).astype(np.int64), q_keys[full]

    # Class keys are hashes of vectors; the same key in two fields stands for equal vectors, so a pair found in one
    # field is tried in both by the exact step.
    found = cut_lineage(both.mapInPandas(scan, "field string, a long, b long, cell int, block int"))
    many = found.where("cell >= 0").select("field", "cell", "block", F.col("a").alias("class_key"))
    inside = members.select("field", "cell", "block", "class_key").join(many.select("field", "cell", "block").distinct(), ["field", "cell", "block"], "left_semi")
    dense = _dense_pairs(inside, many, classes, k, min_cosine)
    return found.where("cell < 0").select("a", "b").unionByName(dense).distinct()


def _dense_pairs(members: DataFrame, queries: DataFrame, classes: DataFrame, k: int, min_cosine: float) -> DataFrame:
    """a, b: pairs of a query and a member of its block (field, cell, block, class_key) that, by exact vectors, reach
    ``min_cosine`` and are among the ``k`` best of the query in the block or of the member in a tile of queries.

    Whatever is left out has ``k`` better partners on both sides; ties are kept.
    """
    place = ["field", "cell", "block"]
    both = members.withColumn("role", F.lit(0)).unionByName(queries.withColumn("role", F.lit(1))).join(classes, ["field", "class_key"])
    both = both.select(*place, "role", "class_key", "vector").repartition(*place).sortWithinPartitions(*place, "role")

    def best(cosine: np.ndarray) -> np.ndarray:
        if cosine.shape[1] <= k:
            return np.ones(cosine.shape, bool)
        return cosine >= np.partition(cosine, -k, axis=1)[:, -k, None] - SLACK

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, vectors = None, None, None
        for batch in batches:
            same = (batch[[*place, "role"]] != batch[[*place, "role"]].shift()).any(axis=1).cumsum()
            for _, g in batch.groupby(same.to_numpy(), sort=False):
                here, own_keys, own = tuple(g[place].iloc[0]), g["class_key"].to_numpy(), _unit(_stack(g["vector"]))
                if g["role"].iloc[0] == 0:
                    if here == at:
                        keys, vectors = np.append(keys, own_keys), np.append(vectors, own, 0)
                    else:
                        at, keys, vectors = here, own_keys, own
                elif here == at:
                    for n in range(0, len(g), 1024):
                        q = own_keys[n : n + 1024]
                        cosine = own[n : n + 1024] @ vectors.T
                        cosine[q[:, None] == keys[None, :]] = -2
                        i, j = np.nonzero((cosine >= min_cosine - SLACK) & (best(cosine) | best(cosine.T).T))
                        yield pd.DataFrame({"a": np.minimum(q[i], keys[j]), "b": np.maximum(q[i], keys[j])})

    return both.mapInPandas(scan, "a long, b long")


def _exact(pairs: DataFrame, classes: DataFrame, min_cosine: float) -> DataFrame:
    """field, a, b, cosine of the pairs whose exact cosine is at least ``min_cosine``."""
    left = classes.select("field", F.col("class_key").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("field").alias("other"), F.col("class_key").alias("b"), F.col("vector").alias("y"))

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = _stack(batch["x"]), _stack(batch["y"])
                value = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                good = value >= min_cosine - 1e-12
                yield batch.loc[good, ["field", "a", "b"]].assign(cosine=value[good])

    joined = pairs.join(left, "a").join(right, "b").where("field = other")
    return joined.select("field", "a", "b", "x", "y").mapInPandas(cosines, "field string, a long, b long, cosine double")


def neighbour_lists(members: DataFrame, links: DataFrame, k: int = K, directed: bool = False) -> DataFrame:
    """field, id, other, cosine, rank: the ``k`` best partners of each row; equal cosines are ordered by id.

    ``links`` are between classes, and hold both ways unless ``directed``. A class needs only its ``k`` + 1 smallest ids to serve anyone's list: they are picked
    in two steps, so that no task orders all copies of one vector.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(64)))
    few = salted.withColumn("n", F.row_number().over(W.partitionBy("field", "class_key", "salt").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("field", "class_key").orderBy("id"))).where(F.col("n") <= k + 1)
    few = few.select("field", F.col("class_key").alias("b"), F.col("id").alias("other"))
    both = links.select("field", "a", "b", "cosine")
    if not directed:
        both = both.unionByName(links.select("field", F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    # Copies of one vector are each other's partners; a class of one row has none.
    own = few.groupBy("field", "b").agg(F.count("*").alias("rows")).where("rows > 1")
    both = both.unionByName(own.select("field", F.col("b").alias("a"), "b", F.lit(1.0).alias("cosine")))
    best = W.partitionBy("field", "a").orderBy(F.desc("cosine"), "other")
    lists = both.join(few, ["field", "b"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = lists.groupBy("field", F.col("a").alias("class_key")).agg(  # k + 1 partners at most
        F.array_sort(F.collect_list(F.struct("n", "other", "cosine"))).alias("partners")
    )
    # Members of a class with many rows are spread over slices, and its one list is repeated for each slice.
    sizes = cut_lineage(members.groupBy("field", "class_key").agg(F.count("*").alias("rows")))
    most = max(HOT, (sizes.agg(F.sum("rows")).first()[0] or 0) >> 16)
    hot = sizes.where(F.col("rows") > most).select("field", "class_key", F.ceil(F.col("rows") / most).cast("int").alias("slices"))
    hot = F.broadcast(hot)  # 65,536 rows at most, as each stands for that share of all rows
    slices = F.coalesce("slices", F.lit(1))
    key = ["field", "class_key"]
    lists = lists.join(hot, key, "left").select(*key, "partners", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    rows = members.join(hot, key, "left").select(*key, "id", F.pmod(F.xxhash64("id", F.lit(4)), slices).cast("int").alias("slice"))
    # A row's own place in its class's list is skipped; those behind it move up.
    others = F.slice(F.filter("partners", lambda x: x["other"] != F.col("id")), 1, k)
    ranked = rows.join(lists, [*key, "slice"]).select("field", "id", F.posexplode(others).alias("rank", "partner"))
    return ranked.select("field", "id", "partner.other", "partner.cosine", (F.col("rank") + 1).alias("rank"))


def similar_vectors(
    rows: DataFrame,
    id_col: str,
    fields: list[str],
    k: int = K,
    min_cosine: float = MIN_COSINE,
    dim: int = DIM,
    sample: int = SAMPLE,
    probes: int = PROBES,
    block: int = BLOCK,
    keep: int = KEEP,
) -> DataFrame:
    """Among each usable vector's ``k`` most similar of the same field those with a cosine of at least ``min_cosine``:
    field, id, other, cosine, rank.

    Unusable vectors (null, of another length, all zero, with a null, NaN or infinite element) take no part. Copies
    count as partners; equal cosines are ordered by id. Only the id and the named fields are read. The codebooks are
    fitted on at most ``sample`` vectors a field; all are indexed and queried.
    """
    vectors = usable_vectors(rows, id_col, fields, dim)
    members, classes = vector_classes(vectors)
    classes = cut_lineage(classes)
    books = fit_fields(classes, fields, min_cosine, sample)
    coded = cut_lineage(encode_classes(classes, books, probes))
    candidates = _cell_candidates(coded, classes, books, keep, block, k, min_cosine)
    links = cut_lineage(_exact(candidates, classes, min_cosine))
    return neighbour_lists(members, links, k)


def neighbour_pairs(lists: DataFrame) -> DataFrame:
    """field, id_a, id_b: pairs of which at least one is in the other's list, smaller id first."""
    return lists.select("field", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


#: Queries that are held against all rows in one pass, and rows and queries of one product of matrices.
QUERY_BLOCK, TILE = 16_384, 2048


class _Best:
    """The best keys of each query so far, by single-precision cosine, with all that may be as good as the k-th."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int):
        self.keys, self.vectors, self.k = keys, vectors, k
        self.least = np.full(len(keys), -2.0, np.float32)
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        parts = [self.held]
        for at in range(0, len(self.keys), TILE):
            score = self.vectors[at : at + TILE] @ vectors.T
            i, j = np.nonzero(score >= self.least[at : at + TILE, None])
            other = self.keys[at + i] != keys[j]
            i, j = i[other], j[other]
            parts.append((at + i, keys[j], score[i, j]))
        query, key, value = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((-value, query))
        query, key, value = query[order], key[order], value[order]
        first = np.searchsorted(query, np.arange(len(self.keys)))
        full = np.flatnonzero(np.bincount(query, minlength=len(self.keys)) >= self.k)
        self.least[full] = value[first[full] + self.k - 1] - SLACK
        good = value >= self.least[query]
        self.held = (query[good], key[good], value[good])


def query_neighbours(
    rows: DataFrame,
    id_col: str,
    fields: list[str],
    is_query: Column,
    k: int = K,
    dim: int = DIM,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` most similar vectors of each query, whatever their cosine: field, id, other, cosine, rank.

    Exact: queries are the usable vectors of rows for which ``is_query`` holds; a block of them at a time is multiplied
    with the vectors of all classes of the field. Codes don't help here: their error lets most vectors pass any bound that
    is safe, and looking up their products takes longer than the products of the vectors. Every task keeps the ``k`` best
    of each query and whatever single precision can't tell from them; these are compared in double precision. Nulls and
    ties as in ``similar_vectors``.
    """
    vectors = usable_vectors(rows, id_col, fields, dim)
    members, classes = vector_classes(vectors)
    classes = cut_lineage(classes)
    wanted = members.withColumnRenamed("id", id_col).where(is_query).select("field", F.col(id_col).alias("id"), "class_key")
    asked = cut_lineage(wanted.select("field", "class_key").distinct().join(classes, ["field", "class_key"]))
    blocks = int(asked.count() // query_block) + 1
    scored = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("class_key", F.lit(13)), F.lit(blocks)) == block).collect()  # one bounded block
        by_field = {f: [r for r in part if r.field == f] for f in fields}
        held = {
            f: (np.array([r.class_key for r in q], np.int64), _unit(np.array([r.vector for r in q], np.float64)))
            for f, q in by_field.items()
            if q
        }
        shared = classes.sparkSession.sparkContext.broadcast(held)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best = {name: _Best(*q, k) for name, q in shared.value.items()}
            for batch in batches:
                for name, g in batch.groupby("field", sort=False):
                    if name in best:
                        keys = g["class_key"].to_numpy()
                        for at in range(0, len(g), TILE):
                            best[name].add(keys[at : at + TILE], _unit(_stack(g["vector"].iloc[at : at + TILE])))
            for name, b in best.items():
                query, key, value = b.held
                yield pd.DataFrame({"field": name, "a": b.keys[query], "b": key, "score": value})

        one = classes.select("field", "class_key", "vector").mapInPandas(scan, "field string, a long, b long, score float")
        # The k-th best of all tasks; whatever may be as good stays.
        order = W.partitionBy("field", "a").orderBy(F.desc("score"), "b")
        one = one.withColumn("n", F.row_number().over(order))
        last = F.min(F.when(F.col("n") <= k, F.col("score"))).over(W.partitionBy("field", "a"))
        one = one.withColumn("last", last).where(F.col("score") >= F.col("last") - F.lit(SLACK)).select("field", "a", "b")
        one = cut_lineage(one) if blocks > 1 else one
        scored = one if scored is None else scored.unionByName(one)
    pairs = scored
    left = asked.select("field", F.col("class_key").alias("a"), F.col("vector").alias("x"))
    right = classes.select("field", F.col("class_key").alias("b"), F.col("vector").alias("y"))

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = _stack(batch["x"]), _stack(batch["y"])
                value = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                yield batch[["field", "a", "b"]].assign(cosine=value)

    links = pairs.join(left, ["field", "a"]).join(right, ["field", "b"]).select("field", "a", "b", "x", "y")
    links = cut_lineage(links.mapInPandas(cosines, "field string, a long, b long, cosine double"))
    lists = neighbour_lists(members, links, k, directed=True)
    return lists.join(wanted.select("field", "id"), ["field", "id"], "left_semi")
