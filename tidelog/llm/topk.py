"""Exact top-k by inner product with a pivot table.

Every vector's distances to many pivots are computed once, where vectors are packed into blocks, and travel with
the blocks. By the triangle inequality the greatest difference of two vectors' pivot distances is a lower bound of
their distance, and so gives an upper bound of their inner product: (|q|^2 + |c|^2 - bound^2) / 2. A query evaluates a
block's candidates in the order of that bound and stops exactly when its k-th score is above every bound that is
left (a bound equal to the score is still evaluated, for ties).

Queries and candidates meet in blocks: candidates are packed CANDIDATE_BLOCK rows to a row, queries QUERY_BLOCK, and
each query block is sent to each partition of candidates. A task meets a query block with all its candidate blocks in
turn, so the best k of the blocks before prune the next one, and gives k rows at most for each query.

Vectors are integers: floor(scale * x), x as double. Defined results. Vectors that are null or hold a
null or non-finite component, and rows with a null vec_id, take no part. Vectors of different lengths are not compared.
Rows that repeat both vec_id and vector count once; if a vec_id has several vectors, every one is a
query or a candidate (never of its own id). Ties: the smaller vec_id. No candidates: no rows. Other columns are not read.
Scores are exact: in double precision while sums stay below 2**53, beyond in 64-bit integers, beyond those in Python's. A component or
score that no bigint holds is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, PIVOTS, STEP = 512, 4096, 32, 64
#: Query blocks whose best a task holds at once.
HELD = 16


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: array of bigint, dim, for the rows that take part; distinct."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    v = good.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))
    return v.distinct().withColumn("dim", F.size("v"))


def pivots_of(dim: int, n: int = PIVOTS, spread: float = 128.0) -> np.ndarray:
    """Fixed pivots: directions of a seeded generator; any points keep the bounds valid."""
    return np.random.default_rng(dim + 1).standard_normal((n, dim)) * spread


def pivot_distances(vectors: np.ndarray) -> np.ndarray:
    """(pivots, vectors)."""
    x, pivots = vectors.astype(np.float64), pivots_of(vectors.shape[1])
    return np.sqrt(np.maximum((pivots * pivots).sum(1)[:, None] + (x * x).sum(1) - 2 * pivots @ x.T, 0)).astype("<f4")


def _packed(size: int):
    """Blocks of up to size rows of one dimension from each partition: dim, ids, matrix, far (distances to the pivots)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            ids = np.array([i for i, _ in rows], "<i8")
            matrix = np.stack([v for _, v in rows]) if dim else np.zeros((len(rows), 0), "<i8")
            small = np.abs(matrix.astype(np.float64)).max(initial=0) < 1 << 31
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                "matrix": pa.array([matrix.astype("<i4" if small else "<i8").tobytes()], pa.binary()), "far": pa.array([pivot_distances(matrix).tobytes()], pa.binary()),
            })

        for batch in batches:
            vectors = batch.column("v")
            flat, o = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column("vec_id").to_numpy()):
                v = flat[o[i] : o[i + 1]]
                rows = held.setdefault(len(v), [])
                rows.append((vec_id, v))
                if len(rows) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return pack


class Block:
    """Packed vectors: ids, integer matrix, its float64 form, squared norms, distances to the pivots."""

    def __init__(self, dim: int, ids: bytes, matrix: bytes, far: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        wide = dim and len(matrix) == 8 * dim * len(self.ids)
        self.whole = np.frombuffer(matrix, "<i8" if wide else "<i4").reshape(len(self.ids), dim)
        self.real = self.whole.astype(np.float64)
        self.norms = (self.real * self.real).sum(1)
        self.far = np.frombuffer(far, "<f4").reshape(PIVOTS, len(self.ids))
        self.top = np.abs(self.real).max(initial=0)


def _scores(q: Block, i: int, c: Block, rows: np.ndarray) -> np.ndarray:
    """Inner products of query i with rows of c, as exact integers."""
    most = q.top * c.top * max(q.whole.shape[1], 1)
    if most < 2.0**53:
        few = 4 * len(rows) < len(c.ids)  # else the whole block costs less than taking its rows out
        return (c.real[rows] @ q.real[i] if few else (c.real @ q.real[i])[rows]).astype(np.int64)
    if most < 2.0**62:
        return c.whole[rows].astype(np.int64) @ q.whole[i].astype(np.int64)
    exact = [sum(map(int.__mul__, x, y)) for y in [q.whole[i].tolist()] for x in c.whole[rows].tolist()]
    if max(map(abs, exact), default=0) >= 1 << 63:
        raise OverflowError("a score does not fit in 64 bits")
    return np.array(exact, np.int64)


def block_topk(q: Block, c: Block, k: int, best: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Improves best, the scores and vec_ids of each query of q so far, by the candidates of c."""
    slack = np.float32(1e-6 * (np.sqrt(q.norms.max(initial=0)) + np.sqrt(c.norms.max(initial=0)) + 1) + 1e-3)
    for i in range(len(q.ids)):
        far = np.zeros(len(c.ids), np.float32)
        for p in range(PIVOTS):
            np.maximum(far, np.abs(c.far[p] - q.far[p, i]), out=far)
        far = np.maximum(far - slack, 0).astype(np.float64)
        bound = (q.norms[i] + c.norms - far * far) / 2 + 1e-6 * (q.norms[i] + c.norms) + 1
        bound[c.ids == q.ids[i]] = -np.inf
        scores, ids = best[i]
        live, step = np.flatnonzero(bound >= scores[-1] if len(scores) >= k else bound > -np.inf), STEP
        while len(live):
            # the next ones in the order of the bound, in ever larger steps
            rows, live = (live, live[:0]) if len(live) <= step else np.split(live[np.argpartition(-bound[live], step)], [step])
            s, step = _scores(q, i, c, rows), step * 8
            if len(scores) >= k:
                good = s >= scores[-1]
                s, rows = s[good], rows[good]
            s, found = np.append(scores, s), np.append(ids, c.ids[rows])
            keep = np.lexsort((found, -s))
            # several vectors of one id with equal scores count once
            new = np.append(True, (s[keep][1:] != s[keep][:-1]) | (found[keep][1:] != found[keep][:-1]))[: len(keep)]
            scores, ids = s[keep][new][:k], found[keep][new][:k]
            if len(scores) >= k:
                live = live[bound[live] >= scores[-1]]
        best[i] = scores, ids


def _searcher(k: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: dict[tuple[int, int], tuple[Block, list]] = {}

        def out(key: tuple[int, int]) -> pd.DataFrame:
            q, best = held.pop(key)
            sizes = [len(s) for s, _ in best]
            return pd.DataFrame({
                "query_id": np.repeat(q.ids, sizes), "vec_id": np.concatenate([i for _, i in best]), "score": np.concatenate([s for s, _ in best]),
            })

        for frame in frames:
            for row in frame.itertuples(index=False):
                key = row.q_block, row.dim
                if key not in held:
                    if len(held) >= HELD:
                        yield out(next(iter(held)))
                    q = Block(row.dim, row.q_ids, row.q_matrix, row.q_far)
                    held[key] = q, [none] * len(q.ids)
                q, best = held[key]
                block_topk(q, Block(row.dim, row.ids, row.matrix, row.far), k, best)
        for key in list(held):
            yield out(key)

    return search


def top_k(rows: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all rows but its own."""
    vectors = integer_vectors(rows, scale)
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "dim int, ids binary, matrix binary, far binary"
    dealt = vectors.repartition(n, F.xxhash64("vec_id"))
    queries = (
        dealt.filter(is_query).coalesce(max(1, n // 8)).select("vec_id", "v").mapInArrow(_packed(QUERY_BLOCK), schema)
        .select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("far").alias("q_far"), F.monotonically_increasing_id().alias("q_block"))
    )
    candidates = dealt.select("vec_id", "v").mapInArrow(_packed(CANDIDATE_BLOCK), schema).withColumn("part", F.spark_partition_id())
    # each query block goes to each partition of candidate blocks: the given set against all rows, in blocks
    sent = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # query blocks on the left: a merge join meets each of them with all candidates of its partition in turn
    met = sent.join(candidates.hint("merge"), ["part", "dim"])
    columns = ("dim", "q_block", "q_ids", "q_matrix", "q_far", "ids", "matrix", "far")
    found = met.select(*columns).mapInPandas(_searcher(k), "query_id bigint, vec_id bigint, score bigint")
    ranked = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0, k=5, scale=256)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
