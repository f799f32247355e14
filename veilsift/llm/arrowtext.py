"""Arrow helpers for operators that read text in Python: columns in, columns out, by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts hold about ``limit`` bytes; no row is left out."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def plain_texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The texts of a batch; null reads as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until no column has it."""
    while name in df.columns:
        name += "_"
    return name


def with_arrow_columns(
    df: DataFrame,
    text_col: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with the columns ``fields``, computed from ``text_col`` in one narrow step.

    ``make`` runs once per task and returns the function from texts to columns, which
    sees about ``limit`` bytes at a time. All other columns pass through; a column that
    already has the name of a new one is replaced.
    """
    names = [f.name for f in fields]
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in names or c == text_col])
    passed = [c for c in kept.columns if c not in names]
    schema = T.StructType([*(kept.schema[c] for c in passed), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in byte_slices(batch, text_col, limit):
                columns = [part.column(c) for c in passed] + list(compute(plain_texts(part, text_col)))
                yield pa.RecordBatch.from_arrays(columns, names=[*passed, *names])

    return kept.mapInArrow(run, schema)


@dataclass
class Words:
    """The words of some texts: row ``i`` has ``codes[offsets[i]:offsets[i + 1]]``."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: list[str]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def distinct_parts(lists: pa.ListArray, keep_empty: bool = False) -> Words:
    """Dictionary-coded parts of split texts, without empty ones unless asked for."""
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if not keep_empty and "" in distinct:
        kept = codes != distinct.index("")
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return Words(offsets, codes, distinct)


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words between white space, in lower case if asked for."""
    return distinct_parts(pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts))


def word_hashes(distinct: Sequence[str]) -> np.ndarray:
    """One 64-bit hash for each distinct word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))


MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX[0]
    x ^= x >> np.uint64(27)
    x *= MIX[1]
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` neighbours; shorter by ``size - 1``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j:j + n]
    return mixed(out)


def inside_rows(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` that stay in one row: their starts, and their rows."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) - first[rows] + offsets[:-1][rows]
    return starts, rows


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``flat[s:s + n]`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of each row; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def binary_column(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are runs of ``flat``, ``offsets`` counted in items."""
    step = flat.dtype.itemsize
    bounds = (offsets * step).astype(np.int64)
    wide = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))],
    )
    return wide.cast(pa.binary())
