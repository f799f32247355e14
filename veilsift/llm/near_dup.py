"""Near duplicates (operator 6): DartMinHash signatures, banded joins, exact checks, classes."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilsift.operators.joins import join_unique
from veilsift.session import scratch_root

from .arrowtext import (
    Words, binary_column, inside_rows, mixed, split_words, window_hashes, with_arrow_columns, word_hashes,
)

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
#: Chance that a Poisson variable of mean 1 is at most 0, 1, 2, ... (fixed values by its formula).
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def text_shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: their rows, hashes and numbers of occurrences.

    Sorted by row and hash. A text of fewer words than ``size`` has one shingle of all its
    words, one without words none.
    """
    words: Words = split_words(texts)
    hashes = word_hashes(words.distinct)[words.codes]
    starts, rows = inside_rows(words.offsets, size)
    found = window_hashes(hashes, size)[starts] if len(starts) else np.empty(0, np.uint64)
    counts = np.diff(words.offsets)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            at = words.offsets[short]
            rows = np.concatenate([rows, short])
            found = np.concatenate([found, window_hashes(hashes, n)[at] ^ np.uint64(n)])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    at = np.flatnonzero(first)
    return rows[at], found[at], np.diff(np.append(at, len(rows)))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def thrown_darts(
    elements: np.ndarray, weights: np.ndarray, ranks: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts in the regions [0, weight) x [0, rank) of hashed elements.

    The plane of an element is cut into cells of area 1 that get narrower in weight as
    they get higher in rank; a hash of element and cell gives the cell's darts (Poisson of
    mean 1) and their places, so equal elements throw equal darts wherever their regions
    overlap. Returns, per dart in a region: index of the element, rank, hash.
    """
    owners, heights, marks = [], [], []
    if not len(elements):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    for v in range(int(np.log2(1 + weights.max())) + 1):
        for r in range(int(np.log2(1 + ranks.max())) + 1):
            width, height = 2.0 ** (v - r), 2.0 ** (r - v)
            w0, r0 = 2.0 ** v - 1, 2.0 ** r - 1
            here = np.flatnonzero((weights > w0) & (ranks > r0))
            if not len(here):
                continue
            across = np.minimum(np.ceil((weights[here] - w0) / width), 2 ** r).astype(np.int64)
            up = np.minimum(np.ceil((ranks[here] - r0) / height), 2 ** v).astype(np.int64)
            cells = across * up
            owner = np.repeat(here, cells)
            cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
            tall = np.repeat(up, cells)
            column, row = cell // tall, cell % tall
            place = np.uint64((v << 58) | (r << 52)) + (column.astype(np.uint64) << np.uint64(26)) + row.astype(np.uint64)
            seed = mixed(elements[owner] ^ mixed(place))
            number = np.searchsorted(POISSON, _unit(seed), side="right")
            at = np.repeat(np.arange(len(owner)), number)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            dart = mixed(seed[at] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            second = mixed(dart ^ np.uint64(0x5851F42D4C957F2D))
            weight = w0 + (column[at] + _unit(dart)) * width
            rank = r0 + (row[at] + _unit(second)) * height
            hit = (weight < weights[owner[at]]) & (rank < ranks[owner[at]])
            owners.append(owner[at][hit])
            heights.append(rank[hit])
            marks.append(mixed(second[hit] + np.uint64(1)))
    if not owners:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(heights), np.concatenate(marks)


def dart_signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash: for each of ``n`` rows, the earliest dart of each of ``k`` coordinates.

    Ranks are cut so that a row throws ``k ln k + 2 k`` darts on average whatever its size;
    a row with an empty coordinate is thrown again with twice the rank. Two rows agree in a
    coordinate with the chance of their weighted Jaccard similarity. Rows without elements
    keep zeros.
    """
    out = np.zeros((n, k), np.uint32)
    total = np.bincount(rows, weights, minlength=n)
    limit = k * np.log(k) + 2 * k
    open_rows = total > 0
    while open_rows.any():
        use = open_rows[rows]
        owner, rank, mark = thrown_darts(elements[use], weights[use], limit / total[rows[use]])
        at = rows[use][owner] * k + (mark % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, at))
        first = order[np.diff(at[order], prepend=-1) != 0]
        filled = np.bincount(at[first] // k, minlength=n) == k
        ready = filled[at[first] // k]
        out.reshape(-1)[at[first][ready]] = (mark[first][ready] >> np.uint64(32)).astype(np.uint32)
        open_rows &= ~filled
        limit *= 2
    return out


def with_signatures(
    df: DataFrame, text_col: str = "text", k: int = BANDS * ROWS, size: int = SHINGLE, weighted: bool = False,
) -> DataFrame:
    """``df`` with ``signature`` and ``sketch`` (binary: ``k`` values of 16 and of 8 bits).

    Both are null if the text has no word. An element is a distinct shingle of ``size``
    words, of weight 1, so that agreement estimates the Jaccard similarity of shingle
    sets; ``weighted`` takes occurrences as weights.
    """

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            rows, elements, counts = text_shingles(texts, size)
            weights = counts.astype(np.float64) if weighted else np.ones(len(rows))
            made = dart_signatures(rows, elements, weights, len(texts), k)
            none = pa.array(np.bincount(rows, minlength=len(texts)) == 0)
            ends = np.arange(len(texts) + 1) * k
            columns = [
                binary_column((made >> 16).astype("<u2").reshape(-1), ends),
                binary_column((made & 255).astype(np.uint8).reshape(-1), ends),
            ]
            return [pc.if_else(none, None, c) for c in columns]

        return compute

    fields = [T.StructField(c, T.BinaryType()) for c in ("signature", "sketch")]
    return with_arrow_columns(df, text_col, fields, make, 2 << 20)


def with_shingles(df: DataFrame, text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``df`` with ``shingles``: the sorted 64-bit hashes of its distinct shingles."""

    def make():
        def compute(texts: pa.Array) -> list[pa.Array]:
            rows, found, _ = text_shingles(texts, size)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view(np.int64)))]

        return compute

    return with_arrow_columns(
        df, text_col, [T.StructField("shingles", T.ArrayType(T.LongType(), False))], make
    )


class Scratch:
    """Tables of one run in the shared folder; a written table cuts the lineage."""

    def __init__(self, spark):
        self.spark, self.folder, self.n = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}", 0

    def kept(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def bands_of(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per node and band: ``bucket`` (hash of band number and values), ``node``."""
    step = 2 * rows
    parts = [
        F.xxhash64(F.lit(b), F.substring("signature", b * step + 1, step)) for b in range(bands)
    ]
    return nodes.select("node", F.explode(F.array(*parts)).alias("bucket"))


def smallest_neighbours(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges`` (a, b): ``node`` and ``root``, the least node of its part.

    Alternates large-star and small-star: every round moves each node's links to the least
    node it has seen, which needs few rounds for long chains, too. All steps aggregate
    before they shuffle and join on sides with one row per key.
    """
    links = scratch.kept(edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a != b").distinct())
    last = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = join_unique(both, low, "a", "inner").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).where("a != b").distinct()
        large = scratch.kept(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = join_unique(large, least, "a", "inner")
        links = scratch.kept(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        last = state


def likely(pairs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs whose sketches agree in as many coordinates as a similar pair does but once in 10^9."""
    least = int(k * similarity - 6 * np.sqrt(k * similarity * (1 - similarity)))
    a = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("_sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("_sb"))
    both = join_unique(join_unique(pairs, a, "a", "inner"), b, "b", "inner")

    @F.pandas_udf("int")
    def agreeing(x, y):
        left = np.frombuffer(b"".join(x), np.uint8).reshape(-1, k)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(-1, k)
        return pd.Series((left == right).sum(axis=1).astype(np.int32))

    return both.withColumn("_n", agreeing("_sa", "_sb")).where(F.col("_n") >= least).select("a", "b")


def shingle_sets(
    members: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, scratch: Scratch
) -> DataFrame:
    """``node``, ``shingles`` of the nodes that share a bucket; reads one text for each."""
    wanted = members.select("node").distinct()
    places = join_unique(nodes.select("node", "text_key", "_id"), wanted, "node", "inner")
    found = join_unique(texts, places, ["text_key", "_id"], "inner").select("node", "text")
    return scratch.kept(
        with_shingles(found, "text", size).groupBy("node").agg(F.first("shingles").alias("shingles"))
    )


def linked(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the Jaccard similarity asked for."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = join_unique(join_unique(pairs, a, "a", "inner"), b, "b", "inner")
    shared = F.size(F.array_intersect("sa", "sb"))
    return scratch.kept(
        both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), shared.alias("n"))
        .where(F.col("n") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("n")))
        .select("a", "b")
    )


def prefix_members(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes of open buckets, dealt anew by the rare shingles that a link has to share.

    Order all shingles by how many of these nodes have them. Two sets of the similarity
    asked for share one of the first ``n - ceil(similarity n) + 1`` of either's ``n``
    (prefix filtering), so no link is lost. ``place`` is the shingle's place in that order.
    """
    roots = members.groupBy("node").agg(F.first("root").alias("root"))
    each = join_unique(sets, roots, "node", "inner").select(
        "node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")
    )
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = join_unique(each, common, "shingle", "inner").groupBy("node", "root", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared")
    )
    reach = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1
    own = F.col("n") - F.size("shared")  # shingles of this node alone come first
    return shared.select(
        "node", "root", "n", own.alias("own"),
        F.posexplode(F.slice("shared", 1, F.greatest(reach - own, F.lit(0)).cast("int"))).alias("k", "s"),
    ).select(F.col("s.shingle").alias("bucket"), "node", "root", "n", (F.col("own") + F.col("k")).alias("place"))


def _near_enough(similarity: float):
    """Whether a member and a head have enough shingles left, from the common one on, to be similar."""
    least = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))
    return (F.col("root") != F.col("head_root")) & (left >= least)


def _as_heads(members: DataFrame) -> DataFrame:
    return members.select(
        "bucket", F.col("node").alias("head"), F.col("root").alias("head_root"), F.col("n").alias("m"),
        F.col("place").alias("at"),
    )


def centre_pairs(dealt: DataFrame, similarity: float) -> DataFrame:
    """Each rare shingle's most central member with the others that could be similar.

    The member with the fewest own shingles before it is the least changed one, so in a
    group of edited copies it is similar to most that are similar to any.
    """
    centre = dealt.groupBy("bucket").agg(
        F.min(F.struct("place", "node", "root", "n")).alias("c")
    ).select("bucket", "c.*")
    met = join_unique(dealt, _as_heads(centre), "bucket", "inner").where(_near_enough(similarity))
    return _ordered(met)


def rare_shingle_pairs(dealt: DataFrame, similarity: float) -> DataFrame:
    """Pairs of two classes that share a rare shingle and have enough shingles left to be similar.

    After the common shingle the two have at most the rest of either in common. A text that
    was changed in many places has its own shingles before it, so it has too few left: in a
    group of edited copies nearly all pairs that are not similar end here. Every pair of two
    classes has an end outside the class with most members in the bucket; only these ends
    are heads.
    """
    main = dealt.groupBy("bucket", "root").agg(F.count("*").alias("c")).groupBy("bucket").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")
    ).where("roots > 1").select("bucket", "main")
    marked = join_unique(dealt, main, "bucket", "inner")
    heads = _as_heads(marked.where("root != main"))
    return _ordered(join_unique(marked, heads, "bucket", "inner").where(_near_enough(similarity)))


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each bucket's leader, drawn by hash, with all its other members."""
    leaders = members.groupBy("bucket").agg(
        F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("l")
    ).select("bucket", F.col("l.node").alias("head"))
    return _ordered(join_unique(members, leaders, "bucket", "inner").where("node != head"))


def near_duplicate_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """Near-duplicate classes of all rows: ``doc_id``, ``text_key``, ``class_id``, ``class_size``
    and ``class_key``, which tells classes apart even where ids are repeated.

    Two texts are linked if the Jaccard similarity of their sets of ``size``-word shingles
    (lower case, split at white space) is at least ``similarity``; classes are the connected
    components; ``class_id`` is the least id of the class. One result row per input row.

    1. Rows with equal text share a node, so copies never form pairs.
    2. Each node gets a DartMinHash signature; ``bands`` of ``rows`` coordinates name its
       buckets. With 40 bands of 5, a pair at 0.8 shares no bucket once in 7 million.
    3. In each bucket one leader is compared with all other members, and classes are merged.
    4. Nodes of buckets that still hold two classes are dealt anew by the rare shingles
       that similar texts must share (``prefix_members``). First each such shingle's most
       central text is compared with the others, then, when classes are merged, all pairs
       of two classes that could still be similar (``rare_shingle_pairs``).

    Comparisons are exact. A pair that shares a band bucket is compared, or in one class
    already, or not similar by the counts of 4: no link is lost, and no group forms all
    its pairs.

    A null or word-free text is a class of its own, shared by the rows that repeat its id.
    Null ids: the class id is the least id that is not null. Repeated rows fall in one
    class. An empty table gives an empty one. Other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    texts = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.md5(F.col(text_col).cast("binary")).alias("text_key"), _id_key(F.col(id_col)).alias("_id"),
    )
    signed = scratch.kept(with_signatures(texts, "text", bands * rows, size).drop("text"))
    one = F.min(F.struct("_id", "signature", "sketch")).alias("one")  # copies have equal signatures
    nodes = scratch.kept(
        signed.where("signature is not null").groupBy("text_key").agg(one)
        .select("text_key", "one.*", F.monotonically_increasing_id().alias("node"))
    )
    buckets = bands_of(nodes, bands, rows)
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = scratch.kept(join_unique(buckets, crowded, "bucket", "inner").select("bucket", "node"))
    sets = shingle_sets(members, nodes, texts, size, scratch)

    def links(pairs: DataFrame) -> DataFrame:
        some = scratch.kept(likely(pairs, nodes, bands * rows, similarity))
        return linked(some, sets, similarity, scratch)

    def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
        """Roots after edges joined the classes of their ends."""
        if edges.isEmpty():
            return roots
        up = scratch.kept(smallest_neighbours(_over_roots(edges, roots), scratch))
        return scratch.kept(_merged_roots(roots, up))

    def classed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        found = join_unique(rows.drop("root"), roots, "node")
        return scratch.kept(found.withColumn("root", F.coalesce("root", "node")))

    roots = scratch.kept(smallest_neighbours(links(leader_pairs(members)), scratch))
    dealt = scratch.kept(prefix_members(_open(classed(members, roots)), sets, similarity))
    roots = merged(roots, links(centre_pairs(dealt, similarity)))
    roots = merged(roots, links(rare_shingle_pairs(classed(dealt, roots), similarity)))
    return _labelled(signed, nodes, roots)


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold two classes."""
    mixed_up = members.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
    return join_unique(members, mixed_up.where("_low != _high").select("bucket"), "bucket", "inner")


def _id_key(column):
    return F.coalesce(column.cast("string"), F.lit("\0null"))


def _over_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        to = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = join_unique(edges, to, end).withColumn(end, F.coalesce("_root", end)).drop("_root")
    return edges


def _merged_roots(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """Roots after a merge: nodes follow their root's new root; new nodes come in."""
    to = merged.select(F.col("node").alias("root"), F.col("root").alias("_up"))
    moved = join_unique(roots, to, "root").select("node", F.coalesce("_up", "root").alias("root"))
    fresh = merged.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return moved.unionByName(fresh)


def _labelled(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    keys = join_unique(nodes.select("text_key", "node"), roots, "node").withColumn(
        "node", F.coalesce("root", "node")
    )
    rows = join_unique(signed.select("doc_id", "text_key", "_id"), keys.select("text_key", "node"), "text_key")
    # a row without words is its own class, told apart by its id
    rows = rows.withColumn(
        "class_key", F.coalesce(F.col("node").cast("string"), F.concat(F.lit("row "), "_id"))
    )
    classes = rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return join_unique(rows, classes, "class_key", "inner").select(
        "doc_id", "text_key", "class_id", "class_size", "class_key"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row of each class: the least id, and of its repeated rows one.

    Only ids and text hashes of the rows that go or stay are joined back; a class whose
    chosen row is repeated is settled by a count of equal rows.
    """
    classes = Scratch(df.sparkSession).kept(near_duplicate_classes(df, id_col, text_col, **options))
    equal = classes.groupBy("class_key", "doc_id", "text_key").agg(F.count("*").alias("_copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "_copies"))
    chosen = equal.groupBy("class_key").agg(least.alias("c")).select("c.doc_id", "c.text_key", "c._copies")
    names = df.columns
    keyed = df.select(
        F.struct(*[f"`{c}`" for c in names]).alias("_row"), _id_key(F.col(id_col)).alias("_id"),
        F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("_text"),
    )
    wanted = chosen.select(
        _id_key(F.col("doc_id")).alias("_id"),
        F.coalesce("text_key", F.lit("")).alias("_text"), "_copies",
    )
    met = join_unique(keyed, wanted, ["_id", "_text"], "inner")
    once = met.where("_copies = 1").select("_row")
    repeated = met.where("_copies > 1").groupBy("_id", "_text").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")


def op6_dart_minhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicate_classes(docs).select("doc_id", "class_id", "class_size")
