"""Token shards as wavelet matrices (operator 8): one compressed file holds a shard's tokens."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilsift.operators.ordering import with_offsets
from veilsift.session import scratch_root

from .arrowtext import byte_slices, gathered, plain_texts, row_sums
from .bytelevel import (
    KEPT_PIECE, RUN_WITH_SPACE, PieceCache, byte_alphabet, in_byte_batches, load_tokenizer, per_worker, vocabulary_path,
)

MAGIC = b"WMTX0001"
BLOCK = 512  # bits between two rank samples
SPAN = 1 << 15  # tokens that are moved at a time, few enough for a processor's cache
SHARD_TOKENS = 2 << 20
SHARD_BYTES = 24 << 20

_LETTER, _MARK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", ".,;:!?"
#: Pieces that the byte-level pattern cuts into words, marks and line ends, and these parts.
PLAIN_PIECE = re.compile(f"(?: ?[{_LETTER}]+[{_MARK}]*| ?[{_MARK}]+)?(?:\n[{_LETTER}]+[{_MARK}]*)*")
PLAIN_PART = re.compile(f" ?[{_LETTER}]+| ?[{_MARK}]+|\n")
#: All ASCII marks but the apostrophe, which the pattern joins with letters behind it.
END_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def spans(bit: np.ndarray, zeros: int) -> Iterator[tuple[slice, tuple[int, int], tuple[int, int]]]:
    """Stretches of a plane, and where their zeros and their ones stand in the next plane's order."""
    low, high = 0, zeros
    for at in range(0, len(bit), SPAN):
        size = min(SPAN, len(bit) - at)
        ones = int(np.count_nonzero(bit[at:at + size]))
        yield slice(at, at + size), (low, low + size - ones), (high, high + ones)
        low, high = low + size - ones, high + ones


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes, highest bit first.

    Plane ``k`` has bit ``bits - 1 - k`` of every value in that plane's order; the next
    plane's order puts the values with a 0 before those with a 1, both in their order.
    Rank samples every 512 bits make rank a look-up and at most eight word counts.
    """

    def __init__(self, length: int, planes: list[np.ndarray], zeros: list[int], samples: list[np.ndarray]):
        self.length, self.planes, self.zeros, self.samples = length, planes, zeros, samples
        self.bits = len(planes)

    @staticmethod
    def build(values: np.ndarray, bits: int) -> WaveletMatrix:
        order = values.astype(np.uint16 if bits <= 16 else np.uint32)
        other = np.empty_like(order)
        planes, zeros, samples = [], [], []
        for k in range(bits):
            bit = order & order.dtype.type(1 << (bits - 1 - k)) != 0
            packed = np.zeros((len(bit) + BLOCK) // BLOCK * (BLOCK // 8), np.uint8)
            tight = np.packbits(bit, bitorder="little")
            packed[:len(tight)] = tight
            plane = packed.view(np.uint64)
            ones = np.bitwise_count(plane).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            samples.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))
            planes.append(plane)
            zeros.append(len(bit) - int(ones.sum()))
            # by place, which is several times faster than by mask where bits are random
            for span, low, high in spans(bit, zeros[k]):
                part = order[span]
                other[low[0]:low[1]] = part.take(np.flatnonzero(~bit[span]))
                other[high[0]:high[1]] = part.take(np.flatnonzero(bit[span]))
            order, other = other, order
        return WaveletMatrix(len(values), planes, zeros, samples)

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Set bits of plane ``k`` before each position."""
        total = self.samples[k][at // BLOCK].astype(np.int64)
        word, first = at >> 6, at // BLOCK * (BLOCK // 64)
        for step in range(BLOCK // 64):
            inside = first + step < word
            total += np.where(inside, np.bitwise_count(self.planes[k][np.where(inside, first + step, 0)]), 0)
        part = (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << part) - np.uint64(1)
        return total + np.bitwise_count(self.planes[k][word] & mask)

    def access(self, at) -> np.ndarray:
        """The values at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            bit, ones = self._bit(k, at), self._ones(k, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _interval(self, value: int, low: int, high: int) -> tuple[int, int]:
        """Where the value's occurrences among positions ``low`` to ``high`` end up in the last order."""
        ends = np.array([low, high], np.int64)
        for k in range(self.bits):
            ones = self._ones(k, ends)
            ends = self.zeros[k] + ones if value >> (self.bits - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, value: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a value among the positions from ``low`` up to ``high``."""
        if not 0 <= value < 1 << self.bits:
            return 0
        first, last = self._interval(value, low, self.length if high is None else high)
        return last - first

    def _select_bit(self, k: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the ``nth`` (from 0) bits of one kind in plane ``k``, by bisection on rank."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.length, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            ones = self._ones(k, mid + 1)
            seen = ones if bit else mid + 1 - ones
            up = seen <= nth
            low, high = np.where((low < high) & up, mid + 1, low), np.where((low < high) & ~up, mid, high)
        return low

    def occurrences(self, value: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """All positions of a value, ascending: select from the last plane up to the first."""
        if not 0 <= value < 1 << self.bits:
            return np.empty(0, np.int64)
        first, last = self._interval(value, low, self.length if high is None else high)
        at = np.arange(first, last)
        for k in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return at

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the planes' orders from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out, other = np.zeros(self.length, kind), np.empty(self.length, kind)
        for k in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[k].view(np.uint8), count=self.length, bitorder="little").view(bool)
            out[self.zeros[k]:] |= kind(1 << (self.bits - 1 - k))
            for span, low, high in spans(bit, self.zeros[k]):
                part = other[span]
                part[np.flatnonzero(~bit[span])] = out[low[0]:low[1]]
                part[np.flatnonzero(bit[span])] = out[high[0]:high[1]]
            out, other = other, out
        return out


def shard_bytes(ids: list, sizes: np.ndarray, matrix: WaveletMatrix, place: tuple[int, int]) -> bytes:
    """A shard's file: magic, header length, header (JSON), then the compressed sections."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections = {"doc_ids": json.dumps(ids).encode(), "sizes": sizes.astype("<i8").tobytes()}
    for k in range(matrix.bits):
        sections[f"plane{k}"] = matrix.planes[k].astype("<u8").tobytes()
        sections[f"rank{k}"] = matrix.samples[k].astype("<u4").tobytes()
    body, table, at = [], {}, 0
    for name, raw in sections.items():
        packed = squeeze(raw)
        plain = len(packed) > 0.95 * len(raw)  # dense planes stay as they are
        body.append(raw if plain else packed)
        table[name] = [at, len(body[-1]), 0 if plain else len(raw)]
        at += len(body[-1])
    header = json.dumps({
        "length": matrix.length, "docs": len(ids), "bits": matrix.bits, "zeros": matrix.zeros,
        "part": place[0], "shard": place[1], "sections": table,
    }).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *body])


class TokenShard:
    """A shard file opened: its documents' ids and sizes, and the matrix of their tokens."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack("<I", data[8:12])
        self.header = json.loads(data[12:12 + size])
        self._data, self._body = memoryview(data), 12 + size
        self.doc_ids = json.loads(self._section("doc_ids"))
        self.sizes = np.frombuffer(self._section("sizes"), "<i8")

    def _section(self, name: str) -> bytes:
        at, size, full = self.header["sections"][name]
        raw = bytes(self._data[self._body + at:self._body + at + size])
        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=full) if full else raw

    @property
    def matrix(self) -> WaveletMatrix:
        bits = self.header["bits"]
        return WaveletMatrix(
            self.header["length"],
            [np.frombuffer(self._section(f"plane{k}"), "<u8") for k in range(bits)],
            self.header["zeros"],
            [np.frombuffer(self._section(f"rank{k}"), "<u4") for k in range(bits)],
        )


class KnownWords:
    """Ids of words, kept from task to task in a worker as Arrow and numpy columns, up to a number of
    words and bytes. A full store takes no more; results do not depend on it."""

    def __init__(self, compute: Callable[[list[str]], list[bytes]], kind: np.dtype, size: int = 600_000, limit: int = 24 << 20):
        self.compute, self.size, self.limit = compute, size, limit
        self.words, self.flat, self.n = pa.array([], pa.string()), np.empty(0, kind), np.empty(0, np.int64)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a number of words one after the other, their sizes, and the place of each word of ``words`` among them."""
        held = len(self.words)
        coded = pa.concat_arrays([self.words, words]).dictionary_encode()  # known words keep their places
        new = self.compute(coded.dictionary.slice(held).to_pylist())
        made = np.frombuffer(b"".join(new), self.flat.dtype)
        flat = np.concatenate([self.flat, made])
        n = np.concatenate([self.n, np.fromiter(map(len, new), np.int64, len(new)) // flat.itemsize])
        if held < self.size:
            ends = np.cumsum(pc.binary_length(coded.dictionary).to_numpy().astype(np.int64))
            kept = min(self.size, int(np.searchsorted(ends, self.limit, side="right")))
            self.words, self.n, self.flat = coded.dictionary.slice(0, kept), n[:kept], flat[:n[:kept].sum()]
        return flat, n, coded.indices.to_numpy()[held:]


class PieceEncoder:
    """Ids of text pieces by the tokenizers library, packed as bytes of ``kind``.

    Most pieces are plain: letters of Latin scripts and common marks, where the
    vocabulary's pattern can be read off. Their words go to the library's BPE model one by
    one, so a word with another mark behind it is not merged again. All other pieces go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.letters = byte_alphabet()
        self.packs = [self.packed([k]) for k in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.words = PieceCache(self.merged, 600_000)
        self.pieces = PieceCache(self.encode, 250_000, 64 << 20)
        self.known = KnownWords(self.merged, self.kind)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_marks = "" if any(re.fullmatch(f"[{_LETTER}]*[{re.escape(END_MARKS)}]*", t.strip(" ")) for t in added) else END_MARKS

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def merged(self, words: list[str]) -> list[bytes]:
        letters, tokenize, packs = self.letters, self.model.tokenize, self.packs
        space, line_end = letters[0x20], letters[0x0A]
        out = []
        for word in words:
            if word.isascii():  # of these, all but space and line end stand for themselves
                shown = word.replace(" ", space).replace("\n", line_end)
            else:
                shown = "".join([letters[b] for b in word.encode()])
            out.append(b"".join([packs[t.id] for t in tokenize(shown)]))
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        other, parts, plain, cuts = [], [], [], []
        for k, piece in enumerate(pieces):
            body = piece.rstrip(_MARK)
            if body.isascii() and (body[1:] if body[:1] == " " else body).isalpha():  # as below, without patterns
                parts.append(body)
                if len(body) < len(piece):
                    parts.append(piece[len(body):])
                    cuts.append(2)
                else:
                    cuts.append(1)
                plain.append(k)
            elif PLAIN_PIECE.fullmatch(piece):
                found = PLAIN_PART.findall(piece)
                cuts.append(len(found))
                plain.append(k)
                parts.extend(found)
            else:
                other.append(k)
        each, at = self.words(parts), 0
        for k, n in zip(plain, cuts):
            out[k] = each[at] if n == 1 else b"".join(each[at:at + n])
            at += n
        done = iter(other)
        for batch in in_byte_batches([pieces[k] for k in other], 256 << 10):
            for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                out[next(done)] = self.packed(e.ids)
        return out


    def spaced(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts between single spaces, each with the space before it: the ids of some words one
        after the other, their sizes, and for each part the places of the two that make its ids.

        Letters with marks behind them are cut in two by Arrow, so that a word is merged once
        whatever marks follow it; all other parts are pieces as they are.
        """
        bodies = pc.utf8_rtrim(parts, characters=self.end_marks) if self.end_marks else parts
        plain = pc.match_substring_regex(bodies, rf"\A[{_LETTER}]+\z")
        is_plain = plain.to_numpy(zero_copy_only=False)
        bodies, whole = bodies.filter(plain), parts.filter(plain)
        at = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:][:len(whole) + 1].astype(np.int64)
        size = pc.binary_length(bodies).to_numpy()
        rest = np.diff(at) - size
        marks = gathered(np.frombuffer(whole.buffers()[2] or b"", np.uint8), at[:-1] + size, rest)
        ends = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(rest), pa.py_buffer(ends), pa.py_buffer(marks))
        flat, n, place = self.known(pa.concat_arrays([pc.binary_join_element_wise(" ", bodies, ""), marks]))
        others = self.pieces([" " + p for p in parts.filter(pc.invert(plain)).to_pylist()])
        both = np.empty((len(parts), 2), np.int64)
        both[is_plain] = place.reshape(2, -1).T
        both[~is_plain, 0] = len(n) + np.arange(len(others))
        both[~is_plain, 1] = len(n) + len(others)
        more, sizes = self.joined([*others, b""])
        return np.concatenate([flat, more]), np.concatenate([n, sizes]), both

    def joined(self, each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(each), self.kind), np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts cut into pieces where ``pieces_with_space`` cuts them: the ids of the distinct
        pieces one after the other, the pieces' sizes, the texts' pieces by number, and where
        each text starts among these."""
        runs = pc.match_substring_regex(texts, RUN_WITH_SPACE)
        simple = pc.split_pattern(texts.filter(pc.invert(runs)), " ")
        coded = simple.flatten().dictionary_encode()
        starts = simple.offsets.to_numpy().astype(np.int64)
        codes = coded.indices.to_numpy().astype(np.int64)
        flat, n, both = self.spaced(coded.dictionary)
        at = np.cumsum(n) - n
        flat, n = gathered(flat, at[both.ravel()], n[both.ravel()]), n[both].sum(axis=1)
        # the first part of a text has no space before it
        opening, which = np.unique(codes[starts[:-1]], return_inverse=True)
        other = coded.dictionary.take(pa.array(opening)).to_pylist()
        codes[starts[:-1]] = len(n) + which
        counts, is_run = np.empty(len(texts), np.int64), runs.to_numpy(zero_copy_only=False)
        counts[~is_run] = np.diff(starts)
        if is_run.any():
            index = {p: k for k, p in enumerate(other)}
            found = [
                [index.setdefault(p, len(index)) for p in KEPT_PIECE.findall(t)] for t in texts.filter(runs).to_pylist()
            ]
            other, counts[is_run] = list(index), list(map(len, found))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            mixed, in_run = np.empty(offsets[-1], np.int64), np.repeat(is_run, counts)
            mixed[~in_run] = codes
            mixed[in_run] = len(n) + np.fromiter((k for ks in found for k in ks), np.int64)
            codes = mixed
        more, sizes = self.joined(self.pieces(other))
        return np.concatenate([flat, more]), np.concatenate([n, sizes]), codes, np.concatenate([[0], np.cumsum(counts)])


def _shards(path: str, end_id: int, bits: int, shard_tokens: int):
    """The function that turns a partition's sorted documents into shard files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_worker(("ids", path), lambda: PieceEncoder(path))
        part, number = TaskContext.get().partitionId(), 0
        ids, sizes, tokens, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, sizes, tokens, held, number
            matrix = WaveletMatrix.build(np.concatenate(tokens), bits)
            data = shard_bytes(ids, np.concatenate(sizes), matrix, (part, number))
            ids, sizes, tokens, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in batches:
            for rows in byte_slices(batch, "text", min(6 << 20, 8 * shard_tokens)):
                flat, n, codes, offsets = encoder.texts(plain_texts(rows, "text"))
                # the end id follows each document as one more piece
                flat = np.append(flat, np.array([end_id], encoder.kind))
                codes = np.insert(codes, offsets[1:], len(n))
                offsets = offsets + np.arange(len(offsets))
                n = np.concatenate([n, [1]])
                starts = np.cumsum(n) - n
                tokens.append(gathered(flat, starts[codes], n[codes]))
                sizes.append(row_sums(n[codes], offsets))
                ids.extend(rows.column("doc_id").to_pylist())
                held += len(tokens[-1])
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    return run


def write_token_shards(
    df: DataFrame, out_path: str, id_col: str = "doc_id", text_col: str = "text",
    name: str = "byte_bpe_50k.json", folder: str | None = None, end_id: int = 2,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode the whole texts in ascending order of ``id_col`` and write wavelet-matrix shards.

    Each document's ids end with ``end_id``. Rows are dealt by range of (id, text hash), so
    rows that share an id spread, too, and each range is cut into shards of about
    ``shard_tokens``; a document stays in one shard. Files are written by Spark's own
    committed writer to any store it can reach: a lost task writes its files anew, and
    each file tells its range and place, so that names do not matter.

    Null text is empty: the end id alone. Null ids come first. Repeated rows are kept.
    An empty table writes no shard. ``id_col`` is an integer or a string.
    """
    path = vocabulary_path(name, folder)
    with open(path, encoding="utf-8") as f:
        bits = max(1, max(len(json.load(f)["model"]["vocab"]) + 64, end_id).bit_length())
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(
        max(1, -(-size // SHARD_BYTES)), "doc_id", "_h"
    ).sortWithinPartitions("doc_id", "_h").drop("_h")
    shards = ordered.mapInArrow(_shards(path, end_id, bits, shard_tokens), "data binary")
    # Spark's text writer copies the bytes of a string as they are: one shard, one file.
    (shards.select(F.col("data").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("compression", "none").mode("overwrite").text(out_path))


def _shard_rows(spark: SparkSession, path: str, read, schema) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                yield from read(TokenShard(data.as_py()))

    # Spark plans file reads by size, a few files a task; contents reach Python file by file.
    files = spark.read.format("binaryFile").load(path).where("length > 8").select("content")
    return files.mapInArrow(run, schema)


def read_token_shards(spark: SparkSession, path: str, id_type: T.DataType = T.LongType(), ids: bool = False) -> DataFrame:
    """The documents in the shard files of a folder, one row each.

    Columns: ``doc_id``, ``part``, ``shard``, ``place`` (in its shard), ``offset`` (of its
    first token in the shard), ``n_tokens``, ``ids_crc32`` (unsigned, of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, ``ids`` (binary).
    """
    fields = [
        T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.BinaryType())] * ids

    def read(shard: TokenShard) -> Iterator[pa.RecordBatch]:
        values = memoryview(np.ascontiguousarray(shard.matrix.values().astype("<u4"))).cast("B")
        ends = np.cumsum(shard.sizes)
        starts = ends - shard.sizes
        runs = [values[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        n = len(runs)
        kind = pa.string() if isinstance(id_type, T.StringType) else pa.int64()
        columns = [
            pa.array(shard.doc_ids, kind),
            pa.array(np.full(n, shard.header["part"], np.int32)),
            pa.array(np.full(n, shard.header["shard"], np.int32)),
            pa.array(np.arange(n)), pa.array(starts), pa.array(shard.sizes),
            pa.array([zlib.crc32(r) for r in runs], pa.int64()),
        ] + [pa.array([bytes(r) for r in runs], pa.binary())] * ids
        yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return _shard_rows(spark, path, read, T.StructType(fields))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Where a token stands: ``part``, ``shard`` and ``at`` (in the shard), by select on the files."""

    def read(shard: TokenShard) -> Iterator[pa.RecordBatch]:
        at = shard.matrix.occurrences(token)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(at), shard.header["part"], np.int32)),
            pa.array(np.full(len(at), shard.header["shard"], np.int32)), pa.array(at),
        ], names=["part", "shard", "at"])

    return _shard_rows(spark, path, read, "part int, shard int, at long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """How often a token stands in each shard: ``part``, ``shard``, ``n``, by rank on the files."""

    def read(shard: TokenShard) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([
            pa.array([shard.header["part"]], pa.int32()), pa.array([shard.header["shard"]], pa.int32()),
            pa.array([shard.matrix.count(token)], pa.int64()),
        ], names=["part", "shard", "n"])

    return _shard_rows(spark, path, read, "part int, shard int, n long")


def with_starts(documents: DataFrame) -> DataFrame:
    """``start``: the tokens of all documents before, over all shards in order.

    ``documents`` is read twice: pass a written table. Shard totals are summed in blocks
    of parts, so no task sees all shards.
    """
    order = Window.partitionBy("part").orderBy("shard")
    shards = documents.groupBy("part", "shard").agg(F.sum("n_tokens").alias("_n"))
    inside = shards.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
    parts = with_offsets(documents.groupBy("part").agg(F.sum("n_tokens").alias("_n")), [], "part", "_n", "_part")
    offsets = inside.join(parts.select("part", "_part"), "part").select(
        "part", "shard", (F.col("_part") + F.col("_before")).alias("_base")
    )
    return documents.join(offsets, ["part", "shard"]).withColumn(
        "start", (F.col("_base") + F.col("offset")).cast("long")
    ).drop("_base")


def op8_wavelet_shards(spark, sf_dir):
    folder = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_token_shards(docs, f"{folder}/shards")
    kind = docs.schema["doc_id"].dataType
    read_token_shards(spark, f"{folder}/shards", kind).write.mode("overwrite").parquet(f"{folder}/documents")
    return with_starts(spark.read.parquet(f"{folder}/documents")).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )
