"""Language identification (operator 3): a conditional random field labels the words of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import row_sums, split_words, with_arrow_columns, word_hashes
from .crf import NOT_LETTERS, fit, label_chances, word_features

BITS = 17
FIT_ROWS = 120
FIT_CHARS = 6000
EPOCHS = 4
UNKNOWN = "und"
MIN_CLARITY = 0.5


@dataclass
class Model:
    """What a fit gives: labels, feature weights, transitions, and the lexicon's word hashes."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray
    bits: int


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words in lower case, letters only: offsets per text, codes, distinct forms.

    Words without a letter fall out.
    """
    words = split_words(texts)
    bare = [NOT_LETTERS.sub("", w) for w in words.distinct]
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) if w else -1 for w in bare), np.int64, len(bare))
    codes = code[words.codes]
    kept = codes >= 0
    return np.concatenate([[0], np.cumsum(kept)])[words.offsets], codes[kept], list(number)


def fit_sample(labelled: DataFrame, rows: int, chars: int) -> DataFrame:
    """Up to ``rows`` different texts of each language: ``lang``, ``text``, ``h``.

    Texts of up to ``chars`` characters come first and whole. Where a language has fewer than
    ``rows`` of them, longer texts fill the sample with their first ``chars`` characters, less
    a word that the end cuts. Texts are drawn by a hash of the text, at a rate that follows
    from a count of each language's different texts, so copies count once, no language is
    lost, and what reaches the driver is bounded whatever the input.
    """
    span = 1 << 30
    hashed = labelled.where(F.col("lang").isNotNull() & (F.col("text") != "")).select(
        "lang", "text", F.xxhash64("text").alias("h"), (F.length("text") > chars).alias("long")
    )
    counts = hashed.select("lang", "long", "h").distinct().groupBy("lang", "long").count().collect()
    if not counts:
        return hashed.select("lang", "text", "h")
    short = {r["lang"]: r["count"] for r in counts if not r["long"]}
    limits = F.create_map(*[
        x for r in counts if not r["long"] or short.get(r["lang"], 0) < rows for x in (
            F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["long"]).alias("long")),
            F.lit(min(span, 3 * rows * span // r["count"] + 1)),
        )
    ])
    first = F.regexp_replace(F.substring("text", 1, chars), r"(?<=\S)\s\S*$", "")
    drawn = hashed.where(
        F.pmod("h", F.lit(span)) < F.element_at(limits, F.struct("lang", "long"))
    ).select("lang", "h", "long", F.when(F.col("long"), first).otherwise(F.col("text")).alias("text")).groupBy(
        "lang", "long", "h"
    ).agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("long", F.pmod("h", F.lit(span)), "h")
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).select("lang", "text", "h")


def switched(pieces: list[tuple[np.ndarray, int]], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training sequences that switch language: stretches of 5 to 40 words of the sample's texts
    in turn. Every stretch is used once; transitions are learned from the changes."""
    random = np.random.default_rng(seed)
    stretches = []
    for codes, label in pieces:
        at = 0
        while at < len(codes):
            n = int(random.integers(5, 41))
            stretches.append((codes[at:at + n], label))
            at += n
    order = random.permutation(len(stretches))
    out = []
    for low in range(0, len(order), 4):
        group = [stretches[k] for k in order[low:low + 4]]
        out.append((
            np.concatenate([c for c, _ in group]),
            np.concatenate([np.full(len(c), label) for c, label in group]),
        ))
    return out


def fit_language_model(
    labelled: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS, bits: int = BITS, epochs: int = EPOCHS,
) -> Model | None:
    """A model from labelled texts (columns ``text``, ``lang``); None if there is none to learn from.

    It is fitted on the driver on a bounded sample (``fit_sample``); its size is ``bits``
    and the number of languages, whatever the input.
    """
    sample = sorted(fit_sample(labelled, rows, chars).collect(), key=lambda r: (r["lang"], r["h"], r["text"]))
    labels = sorted({r["lang"] for r in sample})
    offsets, codes, forms = letter_words(pa.array([r["text"] for r in sample], pa.string()))
    if not labels or not len(codes):
        return None
    counts = np.bincount(codes, minlength=len(forms))
    lexicon = np.sort(word_hashes([w for w, n in zip(forms, counts) if n > 1]))
    features = word_features(forms, bits, lexicon)
    pieces = [
        (codes[offsets[k]:offsets[k + 1]], labels.index(r["lang"])) for k, r in enumerate(sample)
        if offsets[k + 1] > offsets[k]
    ]
    weights, transitions = fit(switched(pieces), features, len(labels), bits, epochs)
    return Model(labels, weights, transitions, lexicon, bits)


def chances(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text of its words with letters, and their label chances."""
    offsets, codes, forms = letter_words(texts)
    if not len(codes):
        return offsets, np.zeros((0, len(model.labels)))
    scores = word_features(forms, model.bits, model.lexicon).scores(model.weights)
    return offsets, label_chances(scores[codes].astype(np.float64), offsets, model.transitions)


RUNS = T.ArrayType(T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()),
]))


def label_runs(model: Model, offsets: np.ndarray, each: np.ndarray) -> list[list[dict]]:
    """For each text its stretches of one language, in order."""
    best = each.argmax(axis=1) if len(each) else np.empty(0, np.int64)
    out = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts = np.flatnonzero(np.diff(best[low:high])) + 1
        ends = [*cuts.tolist(), high - low] if high > low else []
        out.append([
            {"lang": model.labels[best[low + a]], "words": b - a} for a, b in zip([0, *ends], ends)
        ])
    return out


def identify_languages(
    df: DataFrame, model: Model | None, text_col: str = "text", runs: bool = False,
    lang_col: str = "lang_pred", score_col: str = "score", clarity_col: str | None = None,
) -> DataFrame:
    """``df`` with ``lang_pred`` (string) and ``score`` (0 to 1), from the whole text.

    Forward-backward gives each word with a letter the chances of the labels; the text's
    language has the highest mean chance, which is the score. ``runs`` adds ``lang_runs``,
    the stretches of words of one language in code-switched text. ``clarity_col`` adds the mean
    over the words of each one's best chance: how clear they are, in however many languages.

    Null text, text without a letter, and every text where there was nothing to learn
    from: ``und``, score and clarity 0, no runs. Of equal languages the first by name wins.
    Repeated rows give equal results; an empty table gives an empty one. One narrow step, no
    shuffle; columns with the new names are replaced.
    """
    fields = [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    fields += [T.StructField("lang_runs", RUNS)] * runs
    clarity = clarity_col is not None
    if clarity:
        fields.append(T.StructField(clarity_col, T.DoubleType()))
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        model = held.value

        def compute(texts: pa.Array) -> list[pa.Array]:
            if model is None:
                empty = [pa.array([[]] * len(texts), to_arrow_type(RUNS))] * runs
                zeros = pa.array(np.zeros(len(texts)))
                return [pa.array([UNKNOWN] * len(texts)), zeros, *empty, *[zeros] * clarity]
            offsets, each = chances(model, texts)
            sums = np.stack([row_sums(each[:, j], offsets) for j in range(len(model.labels))], axis=1)
            n = np.diff(offsets)
            best = sums.argmax(axis=1)
            score = np.clip(sums[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
            names = [model.labels[b] if some else UNKNOWN for b, some in zip(best, n > 0)]
            more = [pa.array(label_runs(model, offsets, each), to_arrow_type(RUNS))] * runs if runs else []
            if clarity:
                most = each.max(axis=1) if len(each) else np.zeros(0)
                more.append(pa.array(np.clip(row_sums(most, offsets) / np.maximum(n, 1), 0, 1)))
            return [pa.array(names, pa.string()), pa.array(score), *more]

        return compute

    return with_arrow_columns(df, text_col, fields, make, 2 << 20)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out."""
    return fit_language_model(docs.where(~held_out()).select("text", "lang"))


def op3_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify_languages(rows, fit_on_documents(docs)).select("doc_id", "held_out", "lang_pred", "score")
