"""Exact top-k search by inner product (operator 12): columnar branch-and-bound.

Candidates lie in blocks in vertical layout: one array for each dimension. A query takes its
dimensions from the largest component down, a few at a time, and adds their share to the
scores of the candidates left. What the other dimensions can still add is bounded by the
query's and the candidate's remaining mass (Cauchy-Schwarz); candidates that cannot reach
the k-th score go, and the rest are compacted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector_blocks import (
    LEAST, BlockIndex, Packed, exact_kind, first_rows, one_per_id, packed, rows_in_block, seed_rows, whole_vectors,
    written,
)

STEP = 8  # dimensions between two prunings


def _nth_largest(values: np.ndarray, n: int):
    return np.partition(values, len(values) - n)[len(values) - n]


def best_candidates(block: Packed, chunk: Packed, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` candidates of a block for each query of a chunk, if they reach the query's ``low``.

    ``block.matrix`` has a row for each dimension.
    """
    dims = min(len(block.matrix), chunk.matrix.shape[1])
    kind = exact_kind(block.matrix, chunk.matrix, dims)
    planes = block.matrix[:dims].astype(kind)
    full_mass = (planes.astype(np.float64) ** 2).sum(axis=0)
    most = full_mass.max(initial=0)
    ids, out = block.columns["id"], ([], [], [])
    for place, query in enumerate(chunk.matrix):
        order = np.argsort(-np.abs(query[:dims]), kind="stable")
        weights = query[order].astype(kind)
        query_mass = np.append(np.cumsum(weights[::-1].astype(np.float64) ** 2)[::-1], 0.0)
        # scores are integers; the rest covers the rounding of the masses and bounds, exact below 2 ** 53
        margin = 1 + (1e-12 if max(most, query_mass[0]) < 2.0**53 else 1e-6) * np.sqrt(most * query_mass[0])
        left = np.flatnonzero(ids != chunk.columns["id"][place])
        low, score, mass = chunk.columns["low"][place], np.zeros(len(left), kind), full_mass[left]
        for at in range(0, dims, STEP):
            some = order[at:at + STEP]
            part = planes[some] if len(left) == planes.shape[1] else planes[np.ix_(some, left)]
            score = score + weights[at:at + STEP] @ part
            if query_mass[min(at + STEP, dims)] == 0 or not len(left):
                break  # nothing can be added any more
            mass = mass - (part.astype(np.float64) ** 2).sum(axis=0)
            bound = np.sqrt(np.maximum(mass, 0) * query_mass[at + STEP])
            if len(left) >= k:
                low = max(low, _nth_largest(score - bound - margin, k))
            kept = score + bound + margin >= low
            if not kept.all():
                left, score, mass = left[kept], score[kept], mass[kept]
        score = score.astype(np.int64)
        kept = score >= low
        left, score = left[kept], score[kept]
        best = np.lexsort((ids[left], -score))[:k]
        out[0].append(np.full(len(best), place))
        out[1].append(ids[left[best]])
        out[2].append(score[best])
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in out)


def exact_top_k(
    df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """For each row that ``queries`` holds for, its ``k`` best other rows by integer inner product.

    Components become ``floor(scale * x)``. Returns ``query_id``, ``rank`` (from 1), the id of
    the row found and ``score``; ties go to the smaller id. All rows are candidates. Queries
    meet them in blocks, each block in one task; a bounded sample of the rows gives every query
    a first lower bound, which changes no result.

    Rows whose id or vector is null, and vectors with null or non-finite components, take no
    part. Vectors of different lengths are compared as if filled up with zeros. Of rows that
    share an id, one is a query (that with the least vector), and none is a candidate of that
    query; as candidates of others each counts. Fewer than ``k`` candidates are all returned;
    an empty table gives an empty result. Other columns are not read. Inner products beyond
    64-bit integers raise an error.
    """
    rows = whole_vectors(df, id_col, vector_col)
    total = df.count()
    dims = rows.select(F.max(F.size("vec"))).first()[0] or 0
    size = rows_in_block(df.sparkSession, total, dims)
    answer = lambda block, chunk: best_candidates(block, chunk, k)

    def index(source: DataFrame, most: int, name: str) -> BlockIndex:
        return BlockIndex(written(packed(source, most, scale, by_column=True), name), ["id"], True, scale, answer)

    asked = one_per_id(whole_vectors(df.where(queries), id_col, vector_col)).withColumn("low", F.lit(LEAST))
    best = first_rows(
        index(seed_rows(rows, total), size, "seeds"), index(rows, size, "blocks"), asked, ["id"], k
    )
    return best.select(F.col("id").alias("query_id"), F.col("rank").cast("int"), F.col("found").alias(id_col), "score")


OP12_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op12_exact_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(vectors, F.col("vec_id") % 100 == 0)
