"""Periodic runs of words (operator 11): internal pattern matching over a suffix array.

A run is a stretch of a text's words with smallest period ``q`` (words ``q`` apart are
equal) that is at least ``LEAST`` words and ``POWER`` periods long and that no neighbouring
word extends. Dyadic blocks of the text ask for their next occurrence in the window behind
them. The suffixes that start with a block are one interval of the suffix array, and the
least of them behind the block is a range successor, which a wavelet matrix over the suffix
array answers. The distance to it is a candidate period; equal dyadic blocks then extend the
candidate to both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, distinct_parts, gathered, mixed, row_sums, with_arrow_columns

LEAST = 6  # words in a run, at least
POWER = 4  # periods in a run, at least: the block grid below relies on four
SEED = 3  # words of the windows that tell which stretches can hold a run
WHITE_SPACE = r"[\x20\x09-\x0D]+"

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _group_starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and for each key how many keys are smaller."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.arange(len(keys))
    first = np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1])[:len(keys)], at, 0))
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = first
    return order, ranks


class SuffixRanks:
    """Ranks of all blocks of 1, 2, 4, ... values, by prefix doubling; the last order is the suffix array.

    ``ranks[k][i]`` is the number of suffixes whose first ``2 ** k`` values are smaller than
    those at ``i``: equal blocks have equal ranks, and the suffixes that start with the block
    at ``i`` stand in the suffix array from that rank on. It is sorted by the longest block
    asked for, which is as much as the queries need.
    """

    def __init__(self, keys: np.ndarray, longest: int):
        n = len(keys)
        self.order, first = _group_starts(keys)
        self.ranks = [first]
        while 1 << len(self.ranks) - 1 < longest:
            last, half = self.ranks[-1], 1 << len(self.ranks) - 1
            follow = np.zeros(n, np.int64)
            follow[:n - half] = last[half:].astype(np.int64) + 1
            self.order, ranks = _group_starts(last.astype(np.int64) * (n + 1) + follow)
            self.ranks.append(ranks)

    def sizes(self, k: int) -> np.ndarray:
        """How many suffixes start with the same ``2 ** k`` values."""
        return np.bincount(self.ranks[k], minlength=len(self.order))[self.ranks[k]]

    def common_after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal values from ``x`` and from ``y`` on; ``x < y``, and the last value is unique."""
        n, out = len(self.order), np.zeros(len(x), np.int64)

        def step(k: int) -> np.ndarray:
            a, b = x + out, y + out
            inside = b + (1 << k) <= n
            return inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])

        return self._steps(step, out)

    def common_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal values before ``x`` and before ``y``."""
        out = np.zeros(len(x), np.int64)

        def step(k: int) -> np.ndarray:
            a, b = x - out - (1 << k), y - out - (1 << k)
            inside = a >= 0
            return inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])

        return self._steps(step, out)

    def _steps(self, step, out: np.ndarray) -> np.ndarray:
        top = len(self.ranks) - 1
        while (up := step(top)).any():  # the longest block as often as it fits
            out[up] += 1 << top
        for k in reversed(range(top)):
            out[step(k)] += 1 << k
        return out


class RangeSuccessor:
    """A wavelet matrix of a permutation: the least value of at least ``x`` among the places from ``low`` to ``high``."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        order, self.ones, self.zeros = values.astype(np.int32), [], []
        for k in reversed(range(self.bits)):
            bit = order >> k & 1 != 0
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(order) - int(self.ones[-1][-1]))
            order = np.concatenate([order[~bit], order[bit]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the places are smaller than ``x``."""
        low, high, out = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = x >> (self.bits - 1 - k) & 1 != 0
            a, b = ones[low], ones[high]
            out += np.where(bit, high - low - (b - a), 0)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return out

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value that ``n`` values of the places are smaller than."""
        low, high, n, out = low.copy(), high.copy(), n.copy(), np.zeros(len(low), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[low], ones[high]
            left = high - low - (b - a)
            bit = n >= left
            out = out << 1 | bit
            n = np.where(bit, n - left, n)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The range successors; -1 where no value of the places is as large as ``x``."""
        out = np.full(len(low), -1, np.int64)
        before = self.below(low, high, x)
        some = np.flatnonzero(before < high - low)
        out[some] = self.nth(low[some], high[some], before[some])
        return out


@dataclass
class Runs:
    """Runs of some texts: text, first word in it, words, period; by text, start, period."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _stretches(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that can hold a run, in order.

    In a run of ``L >= 4q`` words, and ``L >= 6``, each of the ``L - 2`` windows of three
    words comes back every ``q`` words, so it is in the text three times or more. A run
    therefore lies whole in one stretch of such windows; all others hold none.
    """
    n = len(words.codes)
    if n < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = words.rows
    keys = rows[:-2].astype(np.uint64)
    for j in range(SEED):  # a hash: two windows with one hash only keep a stretch too many
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + words.codes[j:n - 2 + j].astype(np.uint64))
    ordered = np.sort(keys)
    triple = ordered[:-2][ordered[:-2] == ordered[2:]]
    if not len(triple):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    triple = triple[np.append(True, triple[1:] != triple[:-1])]
    at = np.minimum(np.searchsorted(triple, keys), len(triple) - 1)
    often = (triple[at] == keys) & (rows[:-2] == rows[2:])  # no stretch reaches into the next text
    edge = np.diff(np.concatenate([[0], often.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + SEED - 1
    long = ends - starts >= LEAST
    return starts[long], ends[long]


def find_runs(words: Words) -> Runs:
    """All runs of the texts."""
    starts, ends = _stretches(words)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none)
    sizes = ends - starts
    places = gathered(np.arange(len(words.codes)), starts, sizes)
    closing = np.cumsum(sizes + 1) - 1
    n = int(closing[-1]) + 1
    inside = np.ones(n, bool)
    inside[closing] = False
    place = np.zeros(n, np.int64)  # where each kept word stands among all words
    place[inside] = places
    keys = np.empty(n, np.int64)
    keys[inside] = words.rows[places] * (int(words.codes.max()) + 1) + words.codes[places]
    keys[closing] = -1 - np.arange(len(closing))  # ends each stretch; unique
    stretch_end = np.repeat(closing, sizes + 1)

    longest = 1
    while longest < int(sizes.max()) // POWER:
        longest *= 2
    suffixes = SuffixRanks(keys, longest)
    finder = RangeSuccessor(suffixes.order)
    firsts, periods = [], []
    for k in range(len(suffixes.ranks)):
        block = 1 << k
        # Blocks at every half length: a run of four periods with block / 2 < period <= block
        # holds a block and its next occurrence whole.
        at = np.arange(0, n, max(1, block // 2))
        low = suffixes.ranks[k][at].astype(np.int64)
        high = low + suffixes.sizes(k)[at]
        asked = (high - low > 1) & (at + block <= stretch_end[at])
        at, low, high = at[asked], low[asked], high[asked]
        if not len(at):
            continue
        gap = finder.successor(low, high, at + 1) - at
        near = (gap > block // 2) & (gap <= block)
        firsts.append(at[near])
        periods.append(gap[near])
    first, period = np.concatenate(firsts or [places[:0]]), np.concatenate(periods or [places[:0]])
    start = first - suffixes.common_before(first, first + period)
    end = first + period + suffixes.common_after(first, first + period)
    real = end - start >= np.maximum(LEAST, POWER * period)
    found = np.unique(np.stack([start[real], period[real], end[real]]), axis=1)
    start, period, end = found
    row = words.rows[place[start]] if len(start) else start
    return Runs(row, place[start] - words.offsets[row] if len(start) else start, end - start, period)


def kept_words(words: Words, runs: Runs) -> np.ndarray:
    """For each word, whether no run has it behind its first period."""
    change = np.zeros(len(words.codes) + 1, np.int64)
    first = words.offsets[runs.row] + runs.start
    np.add.at(change, first + runs.period, 1)
    np.add.at(change, first + runs.length, -1)
    return np.cumsum(change)[:-1] == 0


def _columns(texts: pa.Array) -> list[pa.Array]:
    words = distinct_parts(pc.ascii_split_whitespace(texts))
    runs = find_runs(words)
    kept = kept_words(words, runs)
    n_runs = np.bincount(runs.row, minlength=len(texts)) if len(runs.row) else np.zeros(len(texts), np.int64)
    values = pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (runs.start, runs.length, runs.period)],
        fields=[pa.field(n, pa.int64()) for n in RUN.names],
    )
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_runs)), pa.int32()), values)
    left = np.append(0, np.cumsum(row_sums(kept.astype(np.int64), words.offsets)))
    spelled = pa.array(words.distinct, pa.string()).take(pa.array(words.codes[kept]))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), spelled), " ")
    return [pa.array(np.diff(words.offsets)), lists, collapsed]


def find_periodic_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words`` (long), ``runs`` (array of start, length, period) and ``collapsed``.

    Words stand between ASCII white space and are numbered from 0. ``runs`` has every run
    (see above), by start, then period. ``collapsed`` is the text's words joined by one
    space, without the words that stand in a run behind its first period.

    Whole texts, a few megabytes of them at a time, in one narrow step: no shuffle, nothing
    is gathered beyond a text. A text's memory is about 200 bytes for each word that stands
    in a stretch that could be periodic.

    Null text counts as empty: no words, no runs, an empty text. Repeated rows give equal
    results. An empty table gives an empty one. Columns named like the new ones are replaced.
    """
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
    return with_arrow_columns(df, text_col, fields, lambda: _columns)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts by the rule of the query: in every tenth, the words from one place on repeat.

    The words of a text that is not changed keep their white space, which is of no account.
    A row without ``doc_id`` is not changed.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", WHITE_SPACE), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("_h")).select(
        "doc_id", "text", F.floor(F.col("_h") / 10).alias("_g"),
        F.when(F.col("_h") % 10 == 0, words).alias("_words"),
    )
    n, g = F.size("_words"), F.col("_g")
    placed = chosen.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")).cast("int"))
    placed = placed.withColumn(
        "_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int")
    )
    rest = F.col("_n") - F.col("_a")
    repeated = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    planted = F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.slice(repeated, F.lit(1), rest))
    return placed.select(
        "doc_id", F.when(F.col("_n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text")
    )


def op11_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = find_periodic_runs(docs).select("doc_id", "n_words", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("_most", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_most.s")).alias("start"), F.col("_most.l").alias("length"), (-F.col("_most.q")).alias("period"),
        F.floor(1000 * F.col("_most.l") / (-F.col("_most.q"))).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
