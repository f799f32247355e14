"""Blocks of integer vectors and the requests that meet them, for exact searches (operators 12 and 13)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilsift.operators.joins import join_unique
from veilsift.session import scratch_root

BLOCK_VALUES = 1 << 20  # components in a block, at most: 4 to 8 MB
CHUNK = 256  # requests that meet a block at once
SEED_ROWS = 4096  # rows, at most, that give the searches their first bounds
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """``id``, ``vec`` and the columns ``more`` of the rows that take part.

    Left out are rows whose id or vector is null and vectors with a null or non-finite component.
    """
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return df.where(F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"), *(c.alias(n) for n, c in more.items())
    )


def one_per_id(requests: DataFrame) -> DataFrame:
    """Of requests that share an id, the one with the least columns."""
    rest = [c for c in requests.columns if c != "id"]
    return requests.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select("id", *(F.col(f"_r.{c}") for c in rest))


@dataclass
class Packed:
    """Vectors, one a row (or one component a row if so packed), and their other columns."""

    matrix: np.ndarray
    columns: dict[str, np.ndarray]


def _matrix(vectors: pa.ListArray, scale: int) -> np.ndarray:
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise OverflowError("vector components too large for 64-bit integers")
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
    return out


def packed(
    df: DataFrame, most: int, scale: int, by_column: bool = False,
    arrange: Callable[[Packed], Packed] | None = None, extra: Sequence[str] = (),
) -> DataFrame:
    """Up to ``most`` neighbouring rows of a partition as one row of binary columns, in one narrow step.

    Components become ``floor(scale * x)``; shorter vectors are filled up with zeros. All other
    columns are 64-bit integers. ``arrange`` may put the rows in another order and add the
    columns ``extra``.
    """
    numbers = [c for c in df.columns if c != "vec"]
    names = [*numbers, *extra]
    schema = "block long, size long, dims int, kind string, vec binary" + "".join(f", {c} binary" for c in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, count = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, count
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = table.column("vec").combine_chunks()
            rows = Packed(_matrix(vectors, scale), {
                c: table.column(c).to_numpy().astype(np.int64) for c in numbers
            })
            rows = arrange(rows) if arrange else rows
            kind = "<i4" if np.abs(rows.matrix).max(initial=0) < 1 << 31 else "<i8"
            matrix = rows.matrix.T if by_column else rows.matrix
            row = [
                (part << 32) + number, len(rows.matrix), rows.matrix.shape[1], kind,
                np.ascontiguousarray(matrix.astype(kind)).tobytes(),
                *(rows.columns[c].astype("<i8").tobytes() for c in names),
            ]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * (1 + len(names))]
            number, held, count = number + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, kinds)], names=["block", "size", "dims", "kind", "vec", *names]
            )

        for batch in batches:
            at = 0
            while at < len(batch):
                held.append(batch.slice(at, most - count))
                count += len(held[-1])
                at += len(held[-1])
                if count == most:
                    yield close()
        if count:
            yield close()

    return df.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, row: int, prefix: str, names: Sequence[str], by_column: bool = False) -> Packed:
    """One packed row of a batch whose columns have a prefix."""

    def value(name: str):
        return batch.column(prefix + name)[row].as_py()

    shape = (value("dims"), value("size")) if by_column else (value("size"), value("dims"))
    return Packed(
        np.frombuffer(value("vec"), value("kind")).reshape(shape),
        {c: np.frombuffer(value(c), "<i8") for c in names},
    )


def exact_kind(a: np.ndarray, b: np.ndarray, dims: int) -> type:
    """The type that holds all inner products of two matrices' vectors exactly."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, dims)
    if most >= 1 << 63:
        raise OverflowError("inner products too large for 64-bit integers")
    return np.float64 if most < 1 << 53 else np.int64


Search = Callable[[Packed, Packed], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class BlockIndex:
    """A written table of packed blocks, and how a block answers a chunk of requests.

    ``answer(block, chunk)`` returns three arrays: the requests' places in the chunk, ids and
    scores of at least those rows of the block that are among the request's first ``k`` overall.
    """

    blocks: DataFrame
    names: Sequence[str]
    by_column: bool
    scale: int
    answer: Search

    def met_by(self, requests: DataFrame) -> DataFrame:
        """``requests`` without their vectors, with ``found`` (id) and ``score``.

        Each block and each chunk of requests meet once. Blocks are not copied; chunks are, to
        every bucket of blocks. Both have a bounded size, and what a task holds is one of each.
        """
        kept = [c for c in requests.columns if c != "vec"]
        buckets = max(1, self.blocks.count())
        left = self.blocks.select(
            F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int").alias("_bucket"),
            *(F.col(c).alias("b_" + c) for c in self.blocks.columns),
        )
        chunks = packed(requests, CHUNK, self.scale)
        right = chunks.select(
            F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"),
            *(F.col(c).alias("r_" + c) for c in chunks.columns),
        )
        names, by_column, answer = list(self.names), self.by_column, self.answer

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, block = None, None
            for batch in batches:
                for row in range(len(batch)):
                    if batch.column("b_block")[row].as_py() != number:
                        number = batch.column("b_block")[row].as_py()
                        block = unpacked(batch, row, "b_", names, by_column)
                    chunk = unpacked(batch, row, "r_", kept)
                    at, found, score = answer(block, chunk)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(chunk.columns[c][at]) for c in kept), pa.array(found), pa.array(score)],
                        names=[*kept, "found", "score"],
                    )

        met = left.repartition(buckets, "_bucket").join(right.repartition(buckets, "_bucket"), "_bucket")
        return met.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "found", "score"]))


def first_of(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` by score, ties by smaller id, with their ``rank``; Spark cuts groups before the shuffle, too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_rows(
    seeds: BlockIndex, index: BlockIndex, requests: DataFrame, keys: Sequence[str], k: int
) -> DataFrame:
    """The first ``k`` rows for each request, exactly.

    The seeds are some of the index's rows: a request's k-th score among them is no more than
    its k-th score among all, so it raises the request's ``low``. ``requests`` is read twice.
    """
    bounds = first_of(seeds.met_by(requests), keys, k).where(F.col("rank") == k)
    bounds = bounds.select(*keys, F.col("score").alias("_bound"))
    raised = join_unique(requests, bounds, keys).withColumn(
        "low", F.greatest("low", F.coalesce("_bound", F.lit(LEAST)))
    ).drop("_bound")
    return first_of(index.met_by(raised.sortWithinPartitions(*keys)), keys, k)


def seed_rows(rows: DataFrame, total: int) -> DataFrame:
    """At most ``SEED_ROWS`` rows in one partition, drawn by a hash of their ids."""
    drawn = F.pmod(F.xxhash64("id"), F.lit(max(1, total))) < SEED_ROWS
    return rows.where(drawn).limit(SEED_ROWS).coalesce(1)


def rows_in_block(spark: SparkSession, total: int, dims: int) -> int:
    """Rows for a block: work for every core where there are few rows, a bounded size where there are many."""
    share = -(-total // (4 * spark.sparkContext.defaultParallelism))
    return min(max(share, 256), max(1, BLOCK_VALUES // max(1, dims)))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared scratch folder."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
