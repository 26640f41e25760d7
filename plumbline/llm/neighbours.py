"""Nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts, by halving it
again and again along its slowest-mixing direction. A small network learns to
tell a vector's part; it places every row in its most probable part and sends a
query to as many of the most probable parts as are needed, on held-out sample
queries, to find their true neighbours. Rows of those parts are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.tables import stash

NEIGHBOURS = 5
# Vectors the index is fitted on (least id hash), and how many of them only measure it.
SAMPLE = 8_192
MEASURE = 512
DEGREE = 12
PARTS = 16
HIDDEN = 128
# Share of true neighbours that the probed parts must hold on the held-out queries.
RECALL = 0.94
# Vectors and queries that meet in one group.
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 1_024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by a power of two first so that squares neither overflow nor vanish."""
    scale = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1]
    vectors = np.ldexp(vectors, -scale[:, None])
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each depends on its two vectors only, not on what else is in the block."""
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return (vectors * query).sum(axis=1) / (
        np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    )


def nearest(vectors: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest of each query, by blocks of queries."""
    k = min(k, len(vectors))
    found = [
        np.argpartition(-(queries[i : i + 512] @ vectors.T), k - 1, axis=1)[:, :k] for i in range(0, len(queries), 512)
    ]
    return np.concatenate(found) if found else np.zeros((0, k), np.int64)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each node of a neighbour graph (rows of neighbour indices); sizes differ by one at each halving."""
    size = len(graph)
    part = np.zeros(size, np.int64)
    draw = np.random.default_rng(seed)
    for _ in range(int(np.log2(parts))):
        fresh = np.zeros(size, np.int64)
        value = draw.standard_normal(size)
        same = part[graph] == part[:, None]
        for step in range(60):
            # the mean over a node's neighbours in its part, and itself
            near = np.where(same, value[graph], 0.0).sum(axis=1) + value
            value = near / (same.sum(axis=1) + 1)
            for p in range(part.max() + 1):
                mine = part == p
                if mine.any():
                    v = value[mine] - value[mine].mean()
                    value[mine] = v / (np.sqrt((v * v).mean()) + 1e-12)
        for p in range(part.max() + 1):
            mine = np.flatnonzero(part == p)
            order = mine[np.lexsort((mine, value[mine]))]
            fresh[order] = 2 * p + (np.arange(len(order)) >= (len(order) + 1) // 2)
        part = fresh
    return part


@dataclass
class Router:
    """A network with one hidden layer; gives log probabilities of the parts up to a constant."""

    layers: list[np.ndarray]
    parts: int
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum(vectors @ w + b, 0) @ v + c


def fit_router(vectors: np.ndarray, goal: np.ndarray, parts: int, rounds: int = 30, seed: int = 5) -> list[np.ndarray]:
    """Adam on the cross entropy between ``goal`` (a distribution over parts per vector) and the network."""
    draw = np.random.default_rng(seed)
    width = vectors.shape[1]
    layers = [
        draw.standard_normal((width, HIDDEN)) * np.sqrt(2 / width) * 4, np.zeros(HIDDEN),
        draw.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts),
    ]
    first, second, step = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers], 0
    for _ in range(rounds):
        order = draw.permutation(len(vectors))
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            x = vectors[rows]
            hidden = np.maximum(x @ layers[0] + layers[1], 0)
            out = hidden @ layers[2] + layers[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (error @ layers[2].T) * (hidden > 0)
            slopes = [x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = 3e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                layers[i] -= rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    return layers


def fit_index(sample: np.ndarray, parts: int = PARTS, recall: float = RECALL) -> Router:
    """Graph, parts, router and number of probes from a sample of vectors of length one."""
    if len(sample) < 8 * parts:
        width = sample.shape[1] if sample.ndim == 2 else 0
        return Router([np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    measure = sample[: min(MEASURE, len(sample) // 8)]
    known = sample[len(measure) :]
    graph = nearest(known, known, DEGREE + 1)
    part = balanced_parts(graph, parts)
    goal = np.eye(parts)[part[graph]].mean(axis=1)  # the parts of a vector's neighbours, its own among them
    router = Router(fit_router(known, goal, parts), parts, parts)
    placed = router.logits(known).argmax(axis=1)
    truth = placed[nearest(known, measure, NEIGHBOURS)]
    ranked = np.argsort(-router.logits(measure), axis=1, kind="stable")
    at = np.argmax(ranked[:, None, :] == truth[:, :, None], axis=2)  # probes needed for each true neighbour
    for probes in range(1, parts + 1):
        if (at < probes).mean() >= recall:
            router.probes = probes
            break
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: not NULL, not zero, all components finite, of the usual length.

    Equal rows count once. If vectors differ in length, those of the length most
    rows have take part.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL").where(finite)
    rows = rows.where(F.exists("vector", lambda x: x != 0)).dropDuplicates()
    widths = rows.groupBy(F.size("vector").alias("width")).count()
    most = widths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    return rows.where(F.size("vector") == (most[0]["width"] if most else 0))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    parts: int = PARTS,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query row, itself excluded.

    Rows with equal vectors are compared once: of each distinct vector the k + 1
    least ids suffice. Parts are cut into blocks, so a part or a vector that
    holds a third of all rows is spread over many groups. Ties go to the smaller
    id. Rows that cannot take part (see ``usable``) are neither queries nor
    results; with fewer than k others, all are returned.
    """
    spark = vectors.sparkSession
    rows = stash(usable(vectors, id_col, vector_col), "vectors")
    if rows.isEmpty():
        return rows.select(
            F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")
        )
    sample = rows.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("index")), "id", "vector").limit(SAMPLE).toPandas()
    router = spark.sparkContext.broadcast(fit_index(unit(np.array(sample["vector"].tolist())), parts, recall))

    # the window's limit is applied before the shuffle, so a common vector is k + 1 rows per task
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = stash(asked.join(rows, (asked["query_id"] == rows["id"]) & (asked["vector"] == rows["vector"]))
                  .select("query_id", rows["vector"]).distinct(), "queries")
    points = asked.groupBy("vector").agg(F.min("query_id").alias("point"))

    placed = stash(kept.withColumn("part", _routed(router, 1)("vector")[0]), "placed")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row per part
    blocks = F.create_map(*[F.lit(int(x)) for p, n in sizes.items() for x in (p, -(-n // BLOCK_ROWS))])
    points = stash(points.withColumn("at", _routed(router, None)("vector")), "points")
    shares = max(1, -(-points.count() // BLOCK_QUERIES))
    draw = F.xxhash64(F.col("id"), F.col("vector"))
    placed = placed.withColumn("block", F.pmod(draw, blocks[F.col("part")]).cast("int"))
    placed = placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    points = points.withColumn("share", F.pmod(F.xxhash64("point", "vector"), F.lit(shares)).cast("int"))
    points = points.select("point", "vector", "share", F.explode("at").alias("part"))
    points = points.where(F.col("part").isin(list(sizes)))
    points = points.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)))

    found = points.groupBy("part", "block", "share").cogroup(placed.groupBy("part", "block", "share"))
    id_type = rows.schema["id"].dataType.simpleString()
    near = found.applyInPandas(_ranker(k + 1), f"point {id_type}, vector array<double>, id {id_type}, score double")
    best = Window.partitionBy("point", "vector").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = asked.join(near.select("vector", "id", "score"), "vector").where("id <> query_id")
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "id", "score")


def _routed(router, probes: int | None):
    """Most probable parts of a vector, best first; ``None`` for as many as the router probes."""

    @F.pandas_udf("array<int>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = router.value
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            logits = known.logits(unit(np.array(vectors.tolist())))
            order = np.argsort(-logits, axis=1, kind="stable")[:, : probes or known.probes]
            yield pd.Series(list(order.astype(np.int32)))

    return parts


def _ranker(k: int):
    def rank(points: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(rows):
            vectors = np.array(rows["vector"].tolist())
            near, ids = unit(vectors), rows["id"].to_numpy()
            asked = np.array(points["vector"].tolist())
            for at in range(0, len(asked), 256):
                rough = unit(asked[at : at + 256]) @ near.T
                cut = -np.partition(-rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for i, (row, least) in enumerate(zip(rough, cut), at):
                    some = np.flatnonzero(row >= least - 1e-9)
                    exact = cosine(asked[i], vectors[some])
                    order = np.lexsort((ids[some], -exact))[:k]
                    out.append(pd.DataFrame({
                        "point": points["point"].iloc[i], "vector": [points["vector"].iloc[i]] * len(order),
                        "id": ids[some][order], "score": exact[order],
                    }))
        return pd.concat(out) if out else pd.DataFrame({"point": [], "vector": [], "id": [], "score": []})

    return rank


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = search(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
