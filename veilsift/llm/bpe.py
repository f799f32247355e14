"""BPE encoding and decoding (operator 4) with a contiguous rank array per word."""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Words, binary_column, byte_slices, gathered, row_sums, with_arrow_columns
from .bytelevel import PieceCache, SPACE, byte_alphabet, per_worker, pieces_without_space, vocabulary_path

NEVER = 1 << 30
SHORT_WORD = 256
CACHED, CACHE_BYTES = 400_000, 80 << 20  # entries and bytes of each of a worker's two caches
SLICE = 3 << 20  # bytes of text that a task works on at once; a quarter of it for ids

#: How the vocabulary's texts split into words. A fixed value of the public vocabulary.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")
#: The same for ASCII text in lower case, by the quicker library.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordBpe:
    """A lower-casing BPE vocabulary with word ends, read from its public file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = self.vocab = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks, self.merged, self.follows = {}, [], {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.follows.setdefault(a, {}).setdefault(b, rank)
            self.merged.append(vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        letters = byte_alphabet()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + self.end) for c in letters]
        self.words = PieceCache(lambda ws: [packed_ids(self.encode_word(w)) for w in ws], CACHED, CACHE_BYTES)
        self.pieces = PieceCache(self.encode_pieces, CACHED, CACHE_BYTES)

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        ids = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
        return [i for i in ids if i is not None]

    def encode_word(self, word: str) -> list[int]:
        ids = self.symbols(word)
        return self.merge_short(ids) if len(ids) <= SHORT_WORD else self.merge_long(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        """Merge by the lowest adjacent rank, the leftmost first.

        ``starts`` holds the part boundaries, the end included, and ``ranks[i]`` the rank of the
        parts that meet at boundary ``i + 1``, both contiguous. A merge deletes a boundary and
        refreshes the ranks on both sides; a part's symbol is read off between its boundaries.
        """
        vocab, follows, none = self.vocab, self.follows, {}
        known = self.ranks.get
        ranks = [known(pair, NEVER) for pair in zip(ids, ids[1:])]
        if not ranks or min(ranks) == NEVER:
            return ids
        parts = [self.tokens[i] for i in ids]
        shown, starts = "".join(parts), [0, *accumulate(map(len, parts))]
        while ranks:
            lowest = min(ranks)
            if lowest == NEVER:
                break
            i = ranks.index(lowest)
            del starts[i + 1], ranks[i]
            a, b = starts[i], starts[i + 1]
            part = shown[a:b]
            if i:
                ranks[i - 1] = follows.get(shown[starts[i - 1]:a], none).get(part, NEVER)
            if i < len(ranks):
                ranks[i] = follows.get(part, none).get(shown[b:starts[i + 2]], NEVER)
        return [vocab[shown[a:b]] for a, b in zip(starts, starts[1:])]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same result for a long word, whose repeated scans would be quadratic."""
        n = len(ids)
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or self.ranks.get((ids[i], ids[j])) != r:
                continue
            ids[i], alive[j], after[i] = self.merged[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    new = self.ranks.get((ids[k], ids[after[k]]), NEVER)
                    if new != NEVER:
                        heapq.heappush(heap, (new, k))
        return [x for x, here in zip(ids, alive) if here]

    def split(self, text: str) -> list[str]:
        """Words of ordinary text: normal form, lower case letter by letter, then the pattern."""
        if text.isascii():
            text = text.lower()
            return [text] if text.isalpha() else ASCII_WORD.findall(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [text] if text.isalpha() else WORD.findall(text)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of texts without white space, their words looked up together."""
        words, cuts, marked = [], [], {}
        for k, piece in enumerate(pieces):
            if self.cut and self.cut.search(piece):
                marked[k] = self.encode_marked(piece)
                cuts.append(0)
                continue
            found = self.split(piece)
            cuts.append(len(found))
            words.extend(found)
        each, out, at = self.words(words), [], 0
        for n in cuts:
            out.append(each[at] if n == 1 else b"".join(each[at:at + n]))
            at += n
        for k, ids in marked.items():
            out[k] = ids
        return out

    def encode_marked(self, piece: str) -> bytes:
        """A text with strings of special tokens in it."""
        ids: list[bytes] = []
        at = 0
        for hit in self.cut.finditer(piece):
            ids.extend(self.words(self.split(piece[at:hit.start()])))
            ids.append(packed_ids([self.special[hit[0]]]))
            at = hit.end()
        ids.extend(self.words(self.split(piece[at:])))
        return b"".join(ids)

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens, each with a space behind it; by id where they start and how many."""
        sizes = np.zeros(max(self.tokens) + 1, np.int64)
        data = []
        for i, token in sorted(self.tokens.items()):
            data.append(token.encode() + b" ")
            sizes[i] = len(data[-1])
        return np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of rows of ids: the tokens' strings with single spaces between, for the
        vocabulary has no other decoder. Ids outside the vocabulary are passed over."""
        flat, starts, sizes = self.spelled
        known = np.flatnonzero(ids < len(sizes))
        known = known[sizes[ids[known]] > 0]
        ids, offsets = ids[known], np.searchsorted(known, offsets)
        n = sizes[ids]
        n[offsets[1:][np.diff(offsets) > 0] - 1] -= 1  # no space behind a row's last token
        return gathered(flat, starts[ids], n), np.append(0, np.cumsum(row_sums(n, offsets)))


def _vocabulary(path: str) -> WordBpe:
    return per_worker(("bpe", path), lambda: WordBpe(path))


def encode_bpe(
    df: DataFrame, text_col: str = "text", ids_col: str = "ids",
    name: str = "word_bpe_49k.json", folder: str | None = None, decoded_col: str | None = None,
) -> DataFrame:
    """``df`` with ``ids_col`` (binary: token ids, each as a little-endian unsigned 32-bit
    integer) and ``n_tokens`` (long) for the whole text, and in ``decoded_col``, if one is named,
    the text that the ids decode to, in the same step.

    Texts are cut at white space, which the vocabulary drops, and every distinct piece is
    merged once per slice of a few megabytes. No shuffle; a task holds one slice. Words
    of over 256 bytes take a heap in place of the repeated scans, with the same result.

    Null and empty text have no tokens. The strings of special tokens inside a text give
    the special ids. Repeated rows give equal results; an empty table gives an empty one.
    Columns with the new names are replaced.
    """
    path = vocabulary_path(name, folder)

    def make():
        vocabulary = _vocabulary(path)

        def compute(texts: pa.Array) -> list[pa.Array]:
            pieces = pieces_without_space(texts)
            each = vocabulary.pieces(pieces.distinct)
            sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
            flat = np.frombuffer(b"".join(each), "<u4")
            starts = np.cumsum(sizes) - sizes
            ids = gathered(flat, starts[pieces.codes], sizes[pieces.codes])
            counts = row_sums(sizes[pieces.codes], pieces.offsets)
            offsets = np.append(0, np.cumsum(counts))
            columns = [binary_column(ids, offsets), pa.array(counts)]
            if decoded_col is not None:
                columns.append(joined(pieces, sizes, vocabulary.decoded(flat, np.append(starts, len(flat)))))
            return columns

        def joined(pieces: Words, sizes: np.ndarray, spelled: tuple[np.ndarray, np.ndarray]) -> pa.Array:
            """A text's tokens with single spaces between are those of its pieces, likewise."""
            kept = sizes[pieces.codes] > 0
            bounds = np.append(0, np.cumsum(kept))[pieces.offsets]
            texts = binary_column(*spelled).cast(pa.string()).take(pa.array(pieces.codes[kept]))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts), " ")

        return compute

    fields = [T.StructField(ids_col, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded_col is not None:
        fields.append(T.StructField(decoded_col, T.StringType()))
    return with_arrow_columns(df, text_col, fields, make, SLICE)


def decode_bpe(
    df: DataFrame, ids_col: str = "ids", out_col: str = "decoded",
    name: str = "word_bpe_49k.json", folder: str | None = None,
) -> DataFrame:
    """``df`` with the text of ``ids_col`` as the library decodes it; null ids give null.

    Ids outside the vocabulary are passed over. Repeated rows give equal results; an empty
    table gives an empty one. A column named like the new one is replaced. A task holds
    about a megabyte of ids and their texts.
    """
    path = vocabulary_path(name, folder)
    passed = [c for c in df.columns if c != out_col]
    kept = df.select(*[f"`{c}`" for c in passed])
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            for part in byte_slices(batch, ids_col, SLICE // 4):
                ids = part.column(ids_col)
                sizes = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                flat = np.frombuffer(b"".join(x.as_buffer() for x in ids if x.is_valid), "<u4")
                texts = binary_column(*vocabulary.decoded(flat, np.append(0, np.cumsum(sizes)))).cast(pa.string())
                texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*passed, out_col])

    return kept.mapInArrow(run, schema)


def op4_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_bpe(docs, decoded_col="decoded").select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
