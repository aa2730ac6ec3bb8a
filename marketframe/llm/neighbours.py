"""Approximate nearest neighbours: a forest of random-projection trees.

Index. Every tree splits the space again and again at the median of a random projection (drawn
orthogonal to the projections above it). The splits are fitted on at most SAMPLE_ROWS vectors (a
stated bound, drawn by a hash of the vector); then every vector is put into its leaf of every tree.

Search. One priority queue holds the branches of all trees. A branch costs the squared distance to
the splits that the query lies on the other side of, which no vector behind it undercuts; the cheapest
is opened next. The first leaves, which cover the share FIRST of the index, give each query a k-th
best; the queue then goes on until its next branch costs more than that (what is left can't be nearer,
so the result is exact) or the leaves cover the share `effort`. All vectors of the leaves are candidates
and are ranked exactly, by cosine in double precision.

Equal vectors stand in the index once, with their k + 1 smallest ids: no other can be among the k
nearest of any query. Leaves and their queries meet in bounded blocks, so neither a large leaf nor
many queries make a large task.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without vec_id; vectors are compared with those of their own length, each length in an index of its
own. Rows that repeat vec_id and vector count once; other rows that repeat vec_id are
vectors of that id, of which the nearest counts. Columns but the id and vector are ignored, an empty
table gives an empty result. Below MAX_DEPTH splits, which the sample can still place, leaves grow with
the index; they are read in blocks, and what a query opens is a share of the index either way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import map_arrow, settle

SAMPLE_ROWS = 20_000
TREES = 4
LEAF_ROWS = 1024
MAX_DEPTH = 12
FIRST, EFFORT = 0.1, 0.75
BLOCK_ROWS, BLOCK_QUERIES = 2048, 256
SALTS = 32


class Tree:
    """Splits in heap order: node i has children 2 i and 2 i + 1; leaves follow the last split."""

    def __init__(self, normals: np.ndarray, cuts: np.ndarray, depth: int):
        self.normals, self.cuts, self.depth = normals, cuts, depth

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, rng: np.random.Generator) -> "Tree":
        normals, cuts = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
        node = np.ones(len(sample), dtype=np.int64)
        for i in range(1, 1 << depth):
            own = np.flatnonzero(node == i)
            w, up = rng.standard_normal(sample.shape[1]), i >> 1
            while up:
                w -= (w @ normals[up]) * normals[up]
                up >>= 1
            norm = np.linalg.norm(w)
            normals[i] = w / norm if norm > 1e-9 else 0
            p = sample[own] @ normals[i]
            cuts[i] = np.median(p) if len(p) else 0.0
            node[own] = 2 * i + (p > cuts[i])
        return cls(normals, cuts, depth)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        node = np.ones(len(v), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", v, self.normals[node]) > self.cuts[node])
        return node - (1 << self.depth)


class Forest:
    """Trees and the share of the index that each leaf holds."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.share: list[np.ndarray] = []

    def search(self, q: np.ndarray, effort: float, after: float = 0.0, bound: float = float("inf")) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, from where the leaves cover `after` until they
        cover `effort` or the next branch costs more than `bound`."""
        queue = [(0.0, t, 1) for t in range(len(self.trees))]
        margins = [tree.normals @ q - tree.cuts for tree in self.trees]
        left, out = np.ones(len(self.trees)), []
        while queue and (done := 1 - float(np.prod(np.maximum(left, 0)))) < effort:
            cost, t, node = heapq.heappop(queue)
            if done >= after and cost > bound:
                break
            tree = self.trees[t]
            if node >= 1 << tree.depth:
                leaf = node - (1 << tree.depth)
                if self.share[t][leaf] > 0:
                    if done >= after:
                        out.append((t, leaf))
                    left[t] -= self.share[t][leaf]
                continue
            m = margins[t][node]
            near = 2 * node + (m > 0)
            heapq.heappush(queue, (cost, t, near))
            heapq.heappush(queue, (cost + m * m, t, near ^ 1))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v array<double> of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """ids (the k + 1 smallest) of every different vector, cut down in salted steps."""
    salted = rows.distinct().withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for key in (["v", "s"], ["v"]):
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))
        salted = salted.withColumn("r", rank).filter(F.col("r") <= k + 1)
    return salted.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares in range
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit(index: DataFrame, trees: int = TREES, seed: int = 7) -> Forest:
    """The forest, fitted on a sample; the depth follows the size of the whole index."""
    n = index.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / LEAF_ROWS)))))
    share = int(min(1.0, SAMPLE_ROWS / max(n, 1)) * 1_000_000)
    drawn = index.filter(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < share).select("v", F.xxhash64("v").alias("h")).toArrow()  # about SAMPLE_ROWS rows
    v = matrix(drawn.column("v"))
    v = unit(v[np.argsort(drawn.column("h").to_numpy(), kind="stable")]) if len(v) else np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    return Forest([Tree.fit(v, depth, rng) for _ in range(trees)])


def counted(df: DataFrame) -> dict[tuple[int, int], int]:
    """Rows by (tree, leaf): at most TREES * 2^MAX_DEPTH."""
    return {(r[0], r[1]): r[2] for r in df.groupBy("tree", "leaf").count().collect()}


def blocks(df: DataFrame, key: str, counts: dict[tuple[int, int], int], rows: int, name: str) -> DataFrame:
    """`df` with a block number, so that a (tree, leaf, block) has about `rows` rows."""
    table = [(t, leaf, -(-n // rows)) for (t, leaf), n in counts.items()]
    sizes = df.sparkSession.createDataFrame(table, "tree int, leaf int, blocks int")
    joined = df.join(F.broadcast(sizes), ["tree", "leaf"])
    return joined.withColumn(name, F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")


FOUND = "query_id bigint, rank int, vec_id bigint, score double"


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, effort: float = EFFORT, trees: int = TREES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query.

    `queries` has vec_id and embedding like `vectors`; rows of the query's own id are no candidates."""
    rows = usable(vectors)
    asked = usable(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).distinct()
    lengths = sorted(r[0] for r in asked.select(F.size("q")).distinct().collect())  # a row for each vector length
    found = [search_one(rows.filter(F.size("v") == n), asked.filter(F.size("q") == n), k, effort, trees) for n in lengths]
    out = vectors.sparkSession.createDataFrame([], FOUND)
    near = reduce(DataFrame.unionByName, found, out.drop("rank")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_one(rows: DataFrame, asked: DataFrame, k: int, effort: float, trees: int) -> DataFrame:
    """query_id, vec_id and score of the nearest found, the k nearest of every query among them; all
    vectors have one length."""
    spark = rows.sparkSession
    index = settle(classes(rows, k), "vectors")
    forest = fit(index, trees)
    shared = spark.sparkContext.broadcast(forest)  # trees * 2^MAX_DEPTH splits at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit(matrix(batch.column(0)))
            for t, tree in enumerate(f.trees):
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(u), pa.int32()), pa.array(tree.leaves(u), pa.int32()), *batch.columns], names=["tree", "leaf", "v", "ids"])

    placed = index.select("v", "ids").mapInArrow(place, "tree int, leaf int, v array<double>, ids array<bigint>")
    placed = settle(placed, "leaves")
    held = counted(placed)
    total = max(1, sum(n for (t, _), n in held.items() if t == 0))
    forest.share = [np.asarray([held.get((t, leaf), 0) / total for leaf in range(1 << tree.depth)]) for t, tree in enumerate(forest.trees)]
    probing = spark.sparkContext.broadcast(forest)

    def probe(after: float, until: float):
        """Queries (query_id, q, bound) by the leaves that they open."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = probing.value
            for batch in batches:
                for i in range(0, batch.num_rows, 200):
                    part = batch.slice(i, 200)
                    u = unit(matrix(part.column(1)))
                    where = [f.search(q, until, after, b) for q, b in zip(u, part.column(2).to_pylist())]
                    at = np.repeat(np.arange(len(u)), [len(x) for x in where])
                    flat = [x for xs in where for x in xs]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), *(part.column(c).take(pa.array(at)) for c in (0, 1))], names=["tree", "leaf", "query_id", "q"])

        return run

    def pack_rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flat = [x for ids in pdf["ids"] for x in ids]
        of = np.repeat(np.arange(len(pdf), dtype="<i4"), [len(ids) for ids in pdf["ids"]])
        return pd.DataFrame({"tree": [key[0]], "leaf": [key[1]], "rows": [np.stack(pdf["v"]).astype("<f8").tobytes()], "ids": [np.asarray(flat, "<i8").tobytes()], "of": [of.tobytes()]})

    def pack_queries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree": [key[0]], "leaf": [key[1]], "asked": [np.stack(pdf["q"]).astype("<f8").tobytes()], "query_ids": [np.asarray(pdf["query_id"], "<i8").tobytes()]})

    left = blocks(placed, "v", held, BLOCK_ROWS, "block")
    row_packs = left.groupBy("tree", "leaf", "block").applyInPandas(pack_rows, "tree int, leaf int, rows binary, ids binary, of binary")
    row_packs = settle(row_packs, "row-packs")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, ids, of, asked_, query_ids = (batch.column(c)[row].as_py() for c in range(5))
                ids, of, query_ids = np.frombuffer(ids, "<i8"), np.frombuffer(of, "<i4"), np.frombuffer(query_ids, "<i8")
                v = np.frombuffer(raw, "<f8").reshape(int(of[-1]) + 1, -1)
                q = np.frombuffer(asked_, "<f8").reshape(len(query_ids), -1)
                out = [_nearest(int(i), x, y, v, w, ids, of, k) for i, x, y, w in zip(query_ids, q, unit(q), [unit(v)] * len(q))]
                at = np.repeat(query_ids, [len(o[0]) for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.concatenate([o[0] for o in out]), pa.int64()), pa.array(np.concatenate([o[1] for o in out]), pa.float64())], names=["query_id", "vec_id", "score"])

    def nearest(bounded: DataFrame, after: float, until: float, name: str) -> DataFrame:
        opened = settle(bounded.mapInArrow(probe(after, until), "tree int, leaf int, query_id bigint, q array<double>"), "probes")
        right = blocks(opened, "query_id", counted(opened), BLOCK_QUERIES, "pack")
        packs = right.groupBy("tree", "leaf", "pack").applyInPandas(pack_queries, "tree int, leaf int, asked binary, query_ids binary")
        pairs = row_packs.join(packs, ["tree", "leaf"]).select("rows", "ids", "of", "asked", "query_ids")
        return settle(map_arrow(pairs, rank, "query_id bigint, vec_id bigint, score double"), name)

    first = nearest(asked.withColumn("bound", F.lit(float("inf"))), 0.0, min(FIRST, effort), "first-found")
    # the k-th best of different ids; a query has k candidates for each leaf at most
    best = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") == k)
    far = 2 - 2 * F.col("score") + 1e-9  # squared distance of unit vectors
    again = asked.join(kth.select("query_id", far.alias("bound")), "query_id", "left").select("query_id", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return first.unionByName(nearest(again, min(FIRST, effort), effort, "found"))


def _nearest(query_id: int, q: np.ndarray, q_unit: np.ndarray, v: np.ndarray, v_unit: np.ndarray, ids: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k nearest in a block but the query's own, ties to smaller ids."""
    rough = v_unit @ q_unit
    m = min(len(rough), k + 1 + 8)
    best = np.flatnonzero(rough >= np.partition(rough, len(rough) - m)[len(rough) - m] - 1e-12)
    exact = np.asarray([cosine(v[i], q) for i in best])
    place = np.full(len(v), -1)
    place[best] = np.arange(len(best))
    at = np.flatnonzero((place[of] >= 0) & (ids != query_id))
    scores = exact[place[of[at]]]
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at][order], scores[order]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors in double precision."""
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
