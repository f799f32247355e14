"""LM scoring (operator 2): cross-entropy difference of matched n-gram models."""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.operators.joins import join_unique
from veilsift.session import scratch_root

from .arrowtext import (
    Words, byte_slices, plain_texts, row_sums, split_words, unused_name, word_hashes,
)

DISCOUNT = 0.75
ADDED = 0.5
UNKNOWN, START = 0, 1  # stand for the unknown word and a text's start among the words' hashes
COUNT_BYTES = 16 << 20
#: Pairs with this share of all pairs are looked up without a shuffle, all others by a join.
#: It decides where a loss is looked up, never what it is; at most its inverse is sent to workers.
HOT_SHARE = 1e-6
#: A bucket gets the counts of so many words of the input, or of so many distinct words of its slices.
BUCKET_WORDS = {"pair": 2 << 20, "word": 1 << 20}
#: Bytes of text in a slice of coded texts, which a task holds with all its pairs.
SLICE_BYTES = 8 << 20
#: Bytes of text for each bucket of the coded texts' table.
TABLE_BYTES = 4 << 20


def _written(df: DataFrame) -> DataFrame:
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hashed(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's xxhash64 of 64-bit integers."""
    p1, p2, p3, p4, p5 = map(np.uint64, (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
    ))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (seed + p5 + np.uint64(8)) ^ (turned(value * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def places(codes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring words, as codes below ``n``, with ``n`` for a text's start:
    first words, second words, and for each word the place of its pair."""
    before = np.concatenate([[n], codes])[:len(codes)]
    before[starts] = n
    found, place = np.unique(before * (n + 1) + codes, return_inverse=True)
    return found // (n + 1), found % (n + 1), place


def pair_hashes(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(h, w)`` of words' hashes."""
    return hashed(tails.view(np.uint64), hashed(heads.view(np.uint64), np.uint64(42)))


def neighbours(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a slice, each word with the one before it or the text's start: hash of
    the pair (``xxhash64(h, w)``), hashes of its two words, and for each word of the slice the place of its pair."""
    hashes = np.concatenate([word_hashes(words.distinct).view(np.int64), np.array([START], np.int64)])
    heads, tails, place = places(words.codes, words.offsets[:-1][np.diff(words.offsets) > 0], len(hashes) - 1)
    heads, tails = hashes[heads], hashes[tails]
    return pair_hashes(heads, tails).view(np.int64), heads, tails, place


def pair_counts(texts: DataFrame) -> DataFrame:
    """Counts of neighbouring words: ``h``, ``w`` (the words' hashes), ``target`` (in target texts), ``background`` (in all)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", COUNT_BYTES):
                words = split_words(plain_texts(part, "text"))
                _, heads, tails, place = neighbours(words)
                wanted = part.column("target").to_numpy(zero_copy_only=False)[words.rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(heads), pa.array(tails),
                    pa.array(np.bincount(place, wanted, len(heads)).astype(np.int64)),
                    pa.array(np.bincount(place, minlength=len(heads))),
                ], names=["h", "w", "target", "background"])

    return texts.select("text", "target").mapInArrow(
        run, "h long, w long, target long, background long"
    ).groupBy("h", "w").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Models:
    """Two interpolated bigram models over one vocabulary, of target texts and of all.

    The tables are made when they are first asked for, and stay in Spark. ``words``: ``word``, its
    share as second of a pair (``target_share``, ``background_share``), how often it is first
    (``target_heads``, ``background_heads``) and what its pairs leave over then (``target_rest``,
    ``background_rest``). ``pairs``: ``h``, ``w`` and counts. ``unknown`` is the row of a word outside
    the vocabulary. ``whole``: every word and pair is kept.
    """

    def __init__(self, docs: DataFrame, word_share: float, pair_share: float, targets: DataFrame | None):
        self.docs, self.word_share, self.pair_share, self.targets = docs, word_share, pair_share, targets
        self.whole = word_share <= 0 and pair_share <= 0

    @cached_property
    def tables(self) -> tuple[DataFrame, DataFrame, dict[str, float]]:
        docs = self.docs
        if self.targets is not None:
            (key,) = self.targets.columns
            marks = self.targets.distinct().withColumn("_target", F.lit(True))
            docs = join_unique(docs, marks, key).withColumn("target", F.coalesce("_target", F.lit(False)))
        return model_tables(docs, self.word_share, self.pair_share)

    words = property(lambda self: self.tables[0])
    pairs = property(lambda self: self.tables[1])
    unknown = property(lambda self: self.tables[2])

    def figures(self, pairs: DataFrame, side: str, columns: list[str]) -> DataFrame:
        """``pairs`` with the columns of the word ``side``; one outside the vocabulary is UNKNOWN."""
        known = self.words.select(F.col("word").alias(side), F.lit(True).alias("_known"), *columns)
        rows = join_unique(pairs, known, side)
        return rows.withColumn(side, F.when(F.col("_known"), F.col(side)).otherwise(F.lit(UNKNOWN))).withColumns(
            {c: F.coalesce(c, F.lit(self.unknown[c])) for c in columns}
        ).drop("_known")

    def losses(self, pairs: DataFrame) -> DataFrame:
        """Bits that either model needs for the second word of each pair: ``pair``, ``n``,
        ``target_bits``, ``background_bits``."""
        raw = pairs.select(F.xxhash64("h", "w").alias("pair"), "h", "w", F.col("background").alias("n"))
        rows = self.figures(raw, "w", ["target_share", "background_share"])
        rows = self.figures(rows, "h", ["target_heads", "background_heads", "target_rest", "background_rest"])
        rows = join_unique(rows, self.pairs, ["h", "w"])

        def bits(m: str) -> Column:
            seen = F.greatest(F.coalesce(m, F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col(f"{m}_heads")
            return (-F.log2(seen + F.col(f"{m}_rest") * F.col(f"{m}_share"))).alias(f"{m}_bits")

        return rows.select("pair", "n", bits("target"), bits("background"))


def in_vocabulary(pairs: DataFrame, word_share: float) -> DataFrame:
    """``pairs`` over the words with at least the share ``word_share`` of all; others are UNKNOWN."""
    counts = _written(pairs.groupBy("w").agg(F.sum("background").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where(F.col("n") >= F.lit(float(word_share * total)))
    for side in ("w", "h"):
        held = known.select(F.col("w").alias(side), F.lit(True).alias("_known"))
        kept = F.col("_known") | (F.col(side) == START)
        pairs = join_unique(pairs, held, side).withColumn(
            side, F.when(kept, F.col(side)).otherwise(F.lit(UNKNOWN))
        ).drop("_known")
    return pairs.groupBy("h", "w").agg(
        F.sum("target").alias("target"), F.sum("background").alias("background")
    )


def fit_models(
    docs: DataFrame, word_share: float = 0.0, pair_share: float = 0.0, targets: DataFrame | None = None,
) -> Models:
    """Models from all texts (columns ``text``, ``target``): target texts against all.

    Every word and every pair of neighbours of all texts is counted, by Arrow per slice and
    by Spark over all, and kept: the counts grow with the input and stay in Spark. Nothing
    of them is collected but three totals. On request words under the share ``word_share``
    of all words are UNKNOWN, and pairs with neither the share ``pair_share`` of target nor
    of all pairs back off to single words. ``targets``, a table of one column that ``docs`` has too,
    can name the target texts instead of ``target``.

    p(w) = (n(w) + ADDED) / (N + ADDED V); p(w | h) = max(n(h, w) - DISCOUNT, 0) / n(h) for a
    kept pair, plus p(w) times what the kept pairs of h leave over. Both models differ in
    their counts only.
    """
    return Models(docs, word_share, pair_share, targets)


def model_tables(docs: DataFrame, word_share: float, pair_share: float) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """The models' words and pairs, and the row of an unknown word."""
    pairs = _written(pair_counts(docs))
    if word_share > 0:
        pairs = _written(in_vocabulary(pairs, word_share))
    sides = {"target": F.lit(1.0), "background": F.lit(1.0)}
    if pair_share > 0:
        n = pairs.agg(*[F.sum(m) for m in sides]).first()
        sides = {m: F.lit(float(max(pair_share * (n[k] or 0), 1))) for k, m in enumerate(sides)}
    kept = (F.col("target") >= sides["target"]) | (F.col("background") >= sides["background"])
    spent = {m: F.when(kept, F.greatest(F.col(m) - DISCOUNT, F.lit(0.0))).otherwise(0.0) for m in sides}
    none = pairs.sparkSession.sql(f"""SELECT CAST({UNKNOWN} AS BIGINT) AS word, 0L AS target_after, 0L AS background_after,
        0L AS target_before, 0L AS background_before, 0D AS target_spent, 0D AS background_spent""")
    ends = pairs.select(
        F.col("w").alias("word"), *[F.col(m).alias(f"{m}_after") for m in sides],
        *[F.lit(0).cast("long").alias(f"{m}_before") for m in sides], *[F.lit(0.0).alias(f"{m}_spent") for m in sides],
    )
    starts = pairs.select(
        F.col("h").alias("word"), *[F.lit(0).cast("long").alias(f"{m}_after") for m in sides],
        *[F.col(m).alias(f"{m}_before") for m in sides], *[spent[m].alias(f"{m}_spent") for m in sides],
    )
    sums = [f"{m}_{x}" for x in ("after", "before", "spent") for m in sides]
    words = _written(ends.unionByName(starts).unionByName(none).groupBy("word").agg(*[F.sum(c).alias(c) for c in sums]))
    total = words.agg(
        F.sum("target_after").alias("target"), F.sum("background_after").alias("background"),
        F.count_if(~F.col("word").isin(UNKNOWN, START)).alias("size"),
    ).first()
    heads = {m: F.greatest(F.col(f"{m}_before"), F.lit(1)) for m in sides}
    words = words.select("word", *[
        ((F.col(f"{m}_after") + ADDED) / F.lit(total[m] + ADDED * (total["size"] + 1))).alias(f"{m}_share") for m in sides
    ], *[F.greatest(1 - F.col(f"{m}_spent") / heads[m], F.lit(1e-12)).alias(f"{m}_rest") for m in sides],
        *[heads[m].alias(f"{m}_heads") for m in sides])
    return words, pairs.where(kept), words.where(F.col("word") == UNKNOWN).first().asDict()


def packed(values: np.ndarray) -> bytes:
    """64-bit integers byte by byte, compressed: small ones and sorted ones' differences take little."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def coded_texts(models: Models) -> tuple[DataFrame, DataFrame]:
    """The models' texts in slices of ``SLICE_BYTES``, one row each, and the numbers of each slice's target texts.

    A slice has its texts' ``keys`` and ``sizes`` in words, the hashes of its distinct ``words``, and
    all its words as ``codes`` among these. The table is bucketed by slice: what is counted over
    all slices comes back to it, and the slices never move.
    """
    docs, targets = models.docs, models.targets
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.col("target") if targets is None else F.col(targets.columns[0])
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text"), mark.alias("mark"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                words = split_words(plain_texts(part, "text"))
                marks = part.column("mark")
                columns = [
                    part.column("key").to_numpy(), np.diff(words.offsets), word_hashes(words.distinct).view(np.int64), words.codes,
                ]
                yield pa.RecordBatch.from_arrays([
                    pa.array([secrets.randbits(62)]), pa.array([len(words.codes)]), pa.array([len(words.distinct)]),
                    pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), marks),
                    *[pa.array([packed(np.ascontiguousarray(c, np.int64))], pa.binary()) for c in columns],
                ], names=["slice", "n", "n_distinct", "marks", "keys", "sizes", "words", "codes"])

    kind = texts.schema["mark"].dataType.simpleString()
    name = f"lm_texts_{uuid.uuid4().hex}"
    (texts.mapInArrow(run, f"slice long, n long, n_distinct long, marks array<{kind}>, keys binary, sizes binary, words binary, codes binary")
     .write.bucketBy(max(1, -(-size // TABLE_BYTES)), "slice").sortBy("slice")
     .option("path", f"{scratch_root(spark)}/{uuid.uuid4().hex}").saveAsTable(name))
    slices = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files stay where they are
    marks = slices.select("slice", F.posexplode("marks").alias("place", "mark"))
    if targets is None:
        marks = marks.where("mark")
    else:
        marks = marks.join(targets.select(F.col(targets.columns[0]).alias("mark")).distinct(), "mark")
    marks = marks.groupBy("slice").agg(F.collect_list("place").alias("places"))
    return slices, _written(marks.withColumn("kind", F.lit("target")))


class Slice:
    """A slice of coded texts: its words, its pairs by ascending hash, and what came back for it."""

    def __init__(self, row: pa.Table, answers: pa.Table):
        self.number = row["slice"][0].as_py()
        self.keys, self.sizes, self.words, codes = [unpacked(row[c][0].as_py()) for c in ("keys", "sizes", "words", "codes")]
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        heads, tails, place = places(codes, starts, len(self.words))
        self.words = np.append(self.words, START)  # code n is the text's start
        pairs = pair_hashes(self.words[heads], self.words[tails])
        order = np.argsort(pairs)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pairs, self.heads, self.tails, self.place = pairs[order], heads[order], tails[order], rank[place]
        self.answers = answers.to_pylist()

    def totals(self, kind: str, n: int) -> np.ndarray:
        """``n`` columns that came back for the slice's sorted keys."""
        rows = sorted((r["bucket"], r["counts"]) for r in self.answers if r["kind"] == kind)
        return np.concatenate([np.empty((n, 0), np.int64), *[unpacked(c).reshape(n, -1) for _, c in rows]], axis=1)

    def pair_counts(self) -> list[np.ndarray]:
        """How often each pair stands in the slice's target texts, and in all."""
        wanted = np.zeros(len(self.sizes), bool)
        for r in self.answers:
            if r["kind"] == "target":
                wanted[r["places"]] = True
        n = len(self.pairs)
        return [np.bincount(self.place, wanted[self.rows], n).astype(np.int64), np.bincount(self.place, minlength=n)]

    def requests(self, keys: np.ndarray, columns: list[np.ndarray], bits: int) -> pa.Table:
        """Counts of sorted keys, a row for each bucket: the keys with the same first ``bits``."""
        ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        cuts = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < b]
        return pa.table({
            "slice": pa.array([self.number] * len(cuts), pa.int64()), "bucket": pa.array([k for k, _, _ in cuts], pa.int32()),
            "keys": pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in cuts], pa.binary()),
            "counts": pa.array([packed(np.concatenate([c[a:b] for c in columns])) for _, a, b in cuts], pa.binary()),
        })


REQUESTS = "slice long, bucket int, keys binary, counts binary"


def over_all(requests: DataFrame, n: int, kind: str) -> DataFrame:
    """For each request the totals of its keys over all slices, after a column that is 1 for each key in one
    of its requests only. Once a bucket: ``found``, its keys met at all, without UNKNOWN and START, and
    ``target`` and ``background``, the sums of the first two columns."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(k).view(np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
        counts = np.concatenate([unpacked(c).reshape(n, -1) for c in table["counts"].to_pylist()], axis=1)
        ends = np.cumsum([len(k) for k in keys]).tolist()
        found, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        totals = np.zeros((n + 1, len(place)), np.int64)
        totals[0, first] = 1
        for k in range(n):
            totals[k + 1] = np.bincount(place, counts[k]).astype(np.int64)[place]
        met = (found > max(UNKNOWN, START)) & (totals[2, first] > 0)  # the empty word is no word
        once = [int(met.sum()), int(counts[0].sum()), int(counts[1].sum())]
        rest = [0] * (len(keys) - 1)
        return pa.table({
            "slice": table["slice"], "bucket": table["bucket"],
            "counts": pa.array([packed(totals[:, a:b].ravel()) for a, b in zip([0, *ends], ends)], pa.binary()),
            **{c: pa.array([x, *rest], pa.int64()) for c, x in zip(("found", "target", "background"), once)},
        })

    schema = "slice long, bucket int, counts binary, found long, target long, background long"
    return _written(requests.groupBy("bucket").applyInArrow(run, schema).withColumn("kind", F.lit(kind)))


def fitted_losses(models: Models, token_differences: bool) -> DataFrame:
    """Sums over each text that whole models were fitted on: ``key``, ``n_words``, ``target_bits``,
    ``background_bits`` and, if asked for, ``token_differences``.

    Counts meet in Spark bucket by bucket, those of pairs first, then those of words, and their totals
    come back to the slices that asked. Pairs are dealt by hash, and a slice asks once for a pair,
    so a frequent word or pair makes no bucket larger.
    """
    slices, marks = coded_texts(models)
    size = slices.agg(F.sum("n"), F.sum("n_distinct")).first()
    bits = {k: max(3, (int(x or 0) // BUCKET_WORDS[k]).bit_length()) for k, x in zip(("pair", "word"), size)}
    pair_bits, word_bits = bits["pair"], bits["word"]

    def met(run: Callable[[Slice], pa.Table], schema: str, *answers: DataFrame) -> DataFrame:
        rows = answers[0]
        for more in answers[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
        return slices.groupBy("slice").cogroup(rows.groupBy("slice")).applyInArrow(
            lambda row, answer: run(Slice(row, answer)), schema
        )

    def pair_requests(s: Slice) -> pa.Table:
        return s.requests(s.pairs, s.pair_counts(), pair_bits)

    def word_requests(s: Slice) -> pa.Table:
        only, *totals = s.totals("pair", 3)
        n, order = len(s.words), np.argsort(s.words.view(np.uint64))
        columns = [np.bincount(side, c, n) for side in (s.tails, s.heads) for c in s.pair_counts()]
        columns += [np.bincount(s.heads, (only > 0) & (c > 0), n) for c in totals]  # different pairs, each in one slice
        return s.requests(s.words.view(np.uint64)[order], [c.astype(np.int64)[order] for c in columns], word_bits)

    pairs = over_all(met(pair_requests, REQUESTS, marks), 2, "pair").select("slice", "kind", "bucket", "counts")
    words = over_all(met(word_requests, REQUESTS, marks, pairs), 6, "word")
    found, *total = [int(x or 0) for x in words.agg(*[F.sum(c) for c in ("found", "target", "background")]).first()]

    def losses(s: Slice) -> pa.Table:
        order, totals = np.argsort(s.words.view(np.uint64)), s.totals("word", 7)[1:]
        figures = np.empty(totals.shape)
        figures[:, order] = totals
        sums, each = [], []
        for m, n in enumerate(s.totals("pair", 3)[1:]):
            after, before, different = figures[m], figures[2 + m], figures[4 + m]
            share = (after + ADDED) / (total[m] + ADDED * (found + 1))
            heads = np.maximum(before, 1)
            rest = np.maximum(1 - (before - DISCOUNT * different) / heads, 1e-12)
            seen = np.maximum(n - DISCOUNT, 0) / heads[s.heads]
            each.append(-np.log2(seen + rest[s.heads] * share[s.tails]))
            sums.append(np.bincount(s.rows, each[m][s.place], len(s.sizes)).astype(np.float64))
        table = {"key": s.keys, "n_words": s.sizes, "target_bits": sums[0], "background_bits": sums[1]}
        if token_differences:
            ends = pa.array(np.concatenate([[0], np.cumsum(s.sizes)]), pa.int32())
            table["token_differences"] = pa.ListArray.from_arrays(ends, pa.array((each[0] - each[1])[s.place]))
        return pa.table(table)

    fields = "key long, n_words long, target_bits double, background_bits double" + ", token_differences array<double>" * token_differences
    rows = met(losses, fields, pairs, words.select("slice", "kind", "bucket", "counts"))
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in rows.columns if c != "key"])


def hot_losses(losses: DataFrame, hot_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the pairs with at least the share ``hot_share`` of all, and their bits."""
    total = losses.agg(F.sum("n")).first()[0] or 0
    rows = losses.where(F.col("n") >= F.lit(float(hot_share * total))).toArrow()
    order = np.argsort(rows["pair"].to_numpy())
    bits = np.stack([rows["target_bits"].to_numpy(), rows["background_bits"].to_numpy()], axis=1)
    return rows["pair"].to_numpy()[order], bits[order]


def text_sums(texts: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row per text: ``key``, ``n_words``, ``target_bits``, ``background_bits`` of its hot
    pairs, and ``cold``, the other pairs with their numbers."""
    held = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = held.value
        for batch in batches:
            for part in byte_slices(batch, "text", COUNT_BYTES):
                words = split_words(plain_texts(part, "text"))
                pairs, _, _, place = neighbours(words)
                at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                is_hot = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                each = np.zeros((len(pairs), 2))
                each[is_hot] = bits[at[is_hot]]
                rare = ~is_hot[place]
                found, n = np.unique(words.rows[rare] * max(len(pairs), 1) + place[rare], return_counts=True)
                rows, which = found // max(len(pairs), 1), found % max(len(pairs), 1)
                ends = np.searchsorted(rows, np.arange(len(words.offsets)))
                cold = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(pairs[which]), pa.array(n.astype(np.int64))], names=["pair", "n"]
                ))
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), pa.array(np.diff(words.offsets)),
                    *[pa.array(row_sums(each[place, k], words.offsets)) for k in (0, 1)], cold,
                ], names=["key", "n_words", "target_bits", "background_bits", "cold"])

    return texts.mapInArrow(run, (
        "key long, n_words long, target_bits double, background_bits double, cold array<struct<pair: long, n: long>>"
    ))


def text_pairs(texts: DataFrame) -> DataFrame:
    """One row per word: ``key``, ``place`` in the text, ``pair``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", COUNT_BYTES):
                words = split_words(plain_texts(part, "text"))
                pairs, _, _, place = neighbours(words)
                keys = part.column("key").to_numpy()[words.rows]
                at = np.arange(len(place)) - words.offsets[words.rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(at), pa.array(pairs[place])], names=["key", "place", "pair"]
                )

    return texts.mapInArrow(run, "key long, place long, pair long")


def with_means(sums: DataFrame, *more: str) -> DataFrame:
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return sums.select(
        "key", "n_words", (F.col("target_bits") / words).alias("target_loss"), (F.col("background_bits") / words).alias("background_loss"),
        ((F.col("target_bits") - F.col("background_bits")) / words).alias("score"), *more,
    )


def joined_losses(texts: DataFrame, models: Models, token_differences: bool, hot_share: float) -> DataFrame:
    """Losses of texts (``key``, ``text``) that need not be the models' own, by joins with the models' tables."""
    pairs = pair_counts(texts.withColumn("target", F.lit(False))).drop("target")
    losses = _written(models.losses(pairs))
    rows = _written(text_sums(texts, hot_losses(losses, hot_share)))
    table = losses.select("pair", F.col("target_bits").alias("t"), F.col("background_bits").alias("b"))
    cold = rows.select("key", F.explode("cold").alias("_c")).select("key", "_c.pair", "_c.n").join(table, "pair")
    sums = rows.select("key", "n_words", "target_bits", "background_bits", F.lit(1).cast("long").alias("copies")).unionByName(
        cold.select(
            "key", F.lit(0).cast("long").alias("n_words"), (F.col("n") * F.col("t")).alias("target_bits"),
            (F.col("n") * F.col("b")).alias("background_bits"), F.lit(0).cast("long").alias("copies"),
        )
    ).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_words", "target_bits", "background_bits", "copies")])
    found = with_means(sums, "copies").withColumn("n_words", (F.col("n_words") / F.col("copies")).cast("long")).drop("copies")
    if token_differences:
        each = text_pairs(texts).join(table, "pair").groupBy("key").agg(
            F.sort_array(F.collect_set(F.struct("place", (F.col("t") - F.col("b")).alias("d")))).alias("each")
        ).select("key", F.col("each.d").alias("token_differences"))
        found = join_unique(found, each, "key").withColumn(
            "token_differences", F.coalesce("token_differences", F.array().cast("array<double>"))
        )
    return found


def score_texts(
    df: DataFrame, models: Models, text_col: str = "text", token_differences: bool = False,
    fitted: bool = False, hot_share: float = HOT_SHARE,
) -> DataFrame:
    """``df`` with ``n_words``, ``target_loss``, ``background_loss`` (bits a word) and ``score``.

    The score is the mean over the words of target loss less background loss: the lower,
    the more a text is like the target. ``token_differences`` adds the differences
    themselves, an array with one per word. Null and word-free texts have 0 words and
    null losses and score. Columns with the new names are replaced. ``fitted`` says that
    the models were fitted on all texts of ``df`` (and maybe more). Whole models then count and
    score these texts slice by slice (``fitted_losses``), and no pair moves as a row.

    For other texts the losses of hot pairs are sent to workers and summed where the text is; the other
    pairs of a text, each with its number, are joined to the models' tables. Copies of a
    text share a key, the hash of the text, and get equal scores. The rows of ``df``
    themselves are shuffled once, by that key.
    """
    names = ["n_words", "target_loss", "background_loss", "score"] + ["token_differences"] * token_differences
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = df.select(F.xxhash64(text).alias("key"), text.alias("text"))
    if fitted and models.whole:
        found = with_means(fitted_losses(models, token_differences), *["token_differences"] * token_differences)
    else:
        found = joined_losses(texts, models, token_differences, hot_share)
    key = unused_name(df, "_text_key")
    passed = [c for c in df.columns if c not in names]
    keyed = df.select(*[f"`{c}`" for c in passed], F.xxhash64(text).alias(key))
    return join_unique(keyed, found.withColumnRenamed("key", key), key).select(*[f"`{c}`" for c in passed], *names)


def op2_lm_difference(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.where("quality = 1").select("doc_id")
    return score_texts(docs, fit_models(docs, targets=good), fitted=True).select(
        "doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")]
    )
