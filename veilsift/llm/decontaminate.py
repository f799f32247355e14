"""Benchmark decontamination (operator 10): greedy string tiling over seeded pairs."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrowtext import (
    inside_rows, split_words, unused_name, window_hashes, with_arrow_columns, word_hashes,
)

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MARKS = re.compile(r"[\W_]+")


def bare_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in lower case without marks: offsets per text, word hashes, and the number of
    each among the white-space words of its text. Words of marks only fall out."""
    words = split_words(texts)
    bare = [MARKS.sub("", w) for w in words.distinct]
    kept = np.fromiter((bool(w) for w in bare), bool, len(bare))[words.codes]
    place = np.arange(len(words.codes)) - np.repeat(words.offsets[:-1], np.diff(words.offsets))
    offsets = np.concatenate([[0], np.cumsum(kept)])[words.offsets]
    return offsets, word_hashes(bare)[words.codes[kept]], place[kept]


class SeedIndex:
    """The runs of ``size`` words of some items, by hash."""

    def __init__(self, texts: Sequence[str | None], size: int):
        self.size = size
        offsets, self.words, _ = bare_words(pa.array([t or "" for t in texts], pa.string()))
        self.offsets = offsets
        starts, rows = inside_rows(offsets, size)
        seeds = window_hashes(self.words, size)[starts] if len(starts) else np.empty(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.items = seeds[order], rows[order]
        self.places = (starts - offsets[:-1][rows])[order]
        # a table of bits that lets most windows of a text go without a search
        self.bits = max(16, int(2 * len(seeds) + 1).bit_length() + 3)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[seeds >> np.uint64(64 - self.bits)] = True

    def item(self, n: int) -> np.ndarray:
        return self.words[self.offsets[n]:self.offsets[n + 1]]

    def hits(self, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Seeds shared with texts: row, item, place in the row, place in the item."""
        starts, rows = inside_rows(offsets, self.size)
        if not len(starts) or not len(self.seeds):
            return (np.empty(0, np.int64),) * 4
        found = window_hashes(words, self.size)[starts]
        maybe = np.flatnonzero(self.table[found >> np.uint64(64 - self.bits)])
        low = np.searchsorted(self.seeds, found[maybe], "left")
        n = np.searchsorted(self.seeds, found[maybe], "right") - low
        at = np.repeat(maybe, n)
        seed = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return rows[at], self.items[seed], (starts - offsets[:-1][rows])[at], self.places[seed]


def covered_at_most(places: np.ndarray, size: int) -> int:
    """How many words runs of ``size`` that start at sorted distinct ``places`` cover."""
    return int(np.minimum(np.diff(places), size).sum()) + size if len(places) else 0


def _rolled(words: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix values modulo 2^64: sums of word * base^place."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:len(words)])])


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _windows(prefix: np.ndarray, powers: np.ndarray, size: int, top: int) -> np.ndarray:
    """Values of all windows of ``size``, scaled as if they started at place ``top``."""
    n = len(prefix) - size
    scale = powers[top - np.arange(n)] if n > 0 else powers[:0]
    return (prefix[size:] - prefix[:-size]) * scale if n > 0 else prefix[:0]


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length), longest matches first.

    Takes the longest match of words not yet marked, of equal ones the first in the text,
    then in the item, marks it on both sides, and goes on until none of ``least`` words is
    left. Matches are looked for by running Karp-Rabin hashes of a search length that
    falls by halves to ``least``; a match is compared word by word before it counts.
    """
    tiles: list[tuple[int, int, int]] = []
    size = min(len(text), len(item))
    if size < least:
        return tiles
    text_free, item_free = np.ones(len(text), bool), np.ones(len(item), bool)
    top = max(len(text), len(item))
    powers = np.cumprod(np.full(top + 1, BASE, np.uint64)) * _INVERSE
    text_hash, item_hash = _rolled(text, powers), _rolled(item, powers)
    while True:
        queue = _free_matches(text, item, text_free, item_free, text_hash, item_hash, powers, size, top)
        heapq.heapify(queue)
        while queue:
            length, t, i = heapq.heappop(queue)
            length = -length
            free = text_free[t:t + length] & item_free[i:i + length]
            if free.all():
                text_free[t:t + length] = False
                item_free[i:i + length] = False
                tiles.append((t, i, length))
                continue
            ends = np.flatnonzero(np.diff(free, prepend=False, append=False))
            for a, b in zip(ends[::2].tolist(), ends[1::2].tolist()):  # what is left of it
                if b - a >= size:
                    heapq.heappush(queue, (a - b, t + a, i + a))
        if size == least:
            return tiles
        size = max(least, size // 2)


def _free_matches(text, item, text_free, item_free, text_hash, item_hash, powers, size, top):
    """Maximal unmarked matches of at least ``size`` words, each as (-length, t, i)."""

    def open_windows(free: np.ndarray) -> np.ndarray:
        marked = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(marked[size:] == marked[:-size])

    text_at, item_at = open_windows(text_free), open_windows(item_free)
    if not len(text_at) or not len(item_at):
        return []
    text_values = _windows(text_hash, powers, size, top)[text_at]
    item_values = _windows(item_hash, powers, size, top)[item_at]
    order = np.argsort(item_values, kind="stable")
    low = np.searchsorted(item_values[order], text_values, "left")
    n = np.searchsorted(item_values[order], text_values, "right") - low
    at = np.repeat(text_at, n)
    to = item_at[order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
    found, seen = [], set()
    for t, i in zip(at.tolist(), to.tolist()):
        if (t - 1, i - 1) in seen:  # the inside of a match already held
            seen.add((t, i))
            continue
        length = 0
        while (
            t + length < len(text) and i + length < len(item) and text[t + length] == item[i + length]
            and text_free[t + length] and item_free[i + length]
        ):
            length += 1
        if length >= size:
            seen.add((t, i))
            found.append((-length, t, i))
    return found


LEAK = T.StructType([
    T.StructField("item", T.IntegerType()), T.StructField("item_words", T.IntegerType()),
    T.StructField("covered_words", T.IntegerType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("tiles", T.ArrayType(T.StructType([
        T.StructField("text_word", T.IntegerType()), T.StructField("item_word", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
    ]))),
])


def leaks_in(index: SeedIndex, texts: pa.Array, coverage: float) -> list[list[dict]]:
    """For each text, the items whose tiles cover enough of them."""
    offsets, words, place = bare_words(texts)
    rows, items, at, item_at = index.hits(offsets, words)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(rows):
        return out
    order = np.lexsort((at, items, rows))
    rows, items, at, item_at = rows[order], items[order], at[order], item_at[order]
    cuts = np.flatnonzero((np.diff(rows) != 0) | (np.diff(items) != 0)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
        row, n = int(rows[low]), int(items[low])
        item = index.item(n)
        if covered_at_most(np.unique(item_at[low:high]), index.size) < coverage * len(item):
            continue
        # all tiles lie where seeds do: keep these stretches, with a word of no item between
        inside = np.zeros(int(offsets[row + 1] - offsets[row]), bool)
        for s in np.unique(at[low:high]).tolist():
            inside[s:s + index.size] = True
        kept = np.flatnonzero(inside)
        gaps = np.flatnonzero(np.diff(kept) > 1) + 1
        here = words[offsets[row]:offsets[row + 1]][kept]
        stretch = np.insert(here, gaps, np.uint64(0))
        origin = np.insert(kept, gaps, -1)
        tiles = greedy_tiles(stretch, item, index.size)
        covered = sum(length for _, _, length in tiles)
        if covered >= coverage * len(item):
            first = place[offsets[row]:offsets[row + 1]]
            out[row].append({
                "item": n, "item_words": len(item), "covered_words": covered,
                "coverage": covered / len(item),
                "tiles": [
                    {"text_word": int(first[origin[t]]), "item_word": i, "words": length}
                    for t, i, length in sorted(tiles)
                ],
            })
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The items, block by block, each block of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = items.where(part == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def with_leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES, out_col: str = "leaks",
) -> DataFrame:
    """``df`` with ``leaks``: the benchmark items whose words its text covers.

    A leak has ``item_id``, ``item_words``, ``covered_words``, ``coverage`` and ``tiles``
    (places count white-space words in the text, bare words in the item). Words are
    compared in lower case without marks. Tiles are matches of at least ``min_match``
    words in any order, so reordered passages are caught; an item leaks if its tiles cover
    at least the share ``coverage`` of its words.

    Items go to the workers as an index of seeds (runs of ``min_match`` words), in blocks
    of ``block_bytes`` of text: the tasks of a block hold this much and no more, whatever
    the number of items, and each block is one more narrow pass. The texts are not
    shuffled, so a passage that a third of all rows hold gathers nowhere. A pair is tiled
    only if its seeds could cover enough, which drops no leak.

    Null and empty texts have no leaks. An item of fewer than ``min_match`` words has no
    seed and leaks nowhere. Items that are repeated with the same id and text count once.
    """
    spark = df.sparkSession
    id_type = benchmark.schema[item_id_col].dataType
    struct = T.StructType([T.StructField("item_id", id_type), *LEAK.fields[1:]])
    names, rest = [], [c for c in df.columns if c != out_col]
    for n, (ids, texts) in enumerate(_blocks(benchmark, item_id_col, item_text_col, block_bytes)):
        held = spark.sparkContext.broadcast((ids, SeedIndex(texts, min_match)))
        kind = to_arrow_type(T.ArrayType(struct))

        def make(held=held, kind=kind):
            ids, index = held.value

            def compute(texts: pa.Array) -> list[pa.Array]:
                found = leaks_in(index, texts, coverage)
                for row in found:
                    for leak in row:
                        leak["item_id"] = ids[leak.pop("item")]
                return [pa.array(found, kind)]

            return compute

        names.append(unused_name(df, f"_leaks_{n}"))
        df = with_arrow_columns(df, text_col, [T.StructField(names[-1], T.ArrayType(struct))], make)
    return df.select(*[f"`{c}`" for c in rest], F.concat(*names).alias(out_col))


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per text and leaked item: ``doc_id`` and the fields of the leak."""
    rows = with_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op10_string_tiling(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = leaked_items(docs, benchmark)
    return leaks.select(
        "doc_id", "item_id", "item_words", "covered_words", F.round("coverage", 6).alias("coverage"),
        F.size("tiles").alias("n_tiles"),
    )
