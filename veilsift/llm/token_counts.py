"""Token counts (operator 9): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import row_sums, with_arrow_columns
from .bytelevel import (
    PieceCache, in_byte_batches, load_tokenizer, per_worker, pieces_with_space, pieces_without_space,
    vocabulary_path,
)

BATCH_CHARS = 256 << 10
BOUNDARIES = {"dropped": pieces_without_space, "kept": pieces_with_space}


def white_space_of(path: str) -> str:
    """Whether a tokenizer file's tokens drop or keep white space, by its pre-tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f).get("pre_tokenizer") or {}
    steps = spec.get("pretokenizers", [spec])
    first = steps[0] if steps else {}
    if first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
        return "kept"
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return "dropped"  # what its pattern does not match goes
    raise ValueError(f"{path}: name in white_space how its tokens treat white space")


def piece_lengths(path: str) -> PieceCache:
    """Token counts of text pieces by the tokenizers library, in batches of like size."""
    tokenizer = load_tokenizer(path)

    def lengths(pieces: list[str]) -> list[int]:
        return [
            len(e) for batch in in_byte_batches(pieces, BATCH_CHARS)
            for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        ]

    return PieceCache(lengths)


def whole_lengths(path: str):
    """Token counts of whole texts by the sentencepiece library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(texts: list[str]) -> list[int]:
        return [
            len(ids) for batch in in_byte_batches(texts, BATCH_CHARS)
            for ids in model.encode(batch, num_threads=1)
        ]

    return lengths


def count_tokens(
    df: DataFrame,
    text_col: str = "text",
    name: str = "word_bpe_49k.json",
    folder: str | None = None,
    limit: int = 2048,
    white_space: str | None = None,
) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (boolean).

    Counts are those of the library for the file (tokenizers for ``.json``,
    sentencepiece for ``.model``) on the whole text, without added special tokens;
    special strings in texts count as the library takes them by default.

    Rows come in slices of a few megabytes, whatever their number. A tokenizer file whose
    pattern breaks at white space lets a text of any length be cut there, so only pieces
    the worker has not met yet are encoded, in batches of equal bytes; ``white_space``
    says if its tokens have it "dropped" or "kept", by default as its pre-tokenizer tells.
    A sentencepiece text is encoded whole. There is no shuffle, and no ids leave the worker.

    Null text counts as empty: 0 bytes, 0 tokens. Equal rows give equal counts. An empty
    table gives an empty one. Columns named like the new ones are replaced.
    """
    path = vocabulary_path(name, folder)
    if white_space is None and not path.endswith(".model"):
        white_space = white_space_of(path)
    fields = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]

    def make():
        whole = path.endswith(".model")
        counts = per_worker(("count", path), lambda: whole_lengths(path) if whole else piece_lengths(path))

        def compute(texts: pa.Array) -> list[pa.Array]:
            if whole:
                tokens = np.array(counts(texts.to_pylist()), np.int64)
            else:
                pieces = BOUNDARIES[white_space](texts)
                each = np.array(counts(pieces.distinct), np.int64)
                tokens = row_sums(each[pieces.codes], pieces.offsets)
            return [pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)]

        return compute

    return with_arrow_columns(df, text_col, fields, make)


def op9_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs.select(F.col("doc_id"), F.col("text"))).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )
