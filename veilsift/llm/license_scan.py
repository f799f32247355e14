"""License scans (operator 7): fingerprints pick candidates, banded alignment judges them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import inside_rows, window_hashes, with_arrow_columns
from .decontaminate import bare_words
from .license_texts import TEMPLATES

GRAM = 3
COVERAGE = 0.8
MISS, GAP = -1, -1

FOUND = T.ArrayType(T.StructType([
    T.StructField("template", T.StringType()), T.StructField("matched_words", T.IntegerType()),
    T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
]))


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: in every window the least hash, the last of equal ones."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    least = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(len(views)) + least)


def places_changed(words: int, coverage: float) -> int:
    """Words that may differ in a copy at the coverage."""
    return int(words * (1 - coverage) + 1e-9)


def least_run(words: int, coverage: float) -> int:
    """Words that stay together in every copy with changes at as many places as ``coverage`` allows."""
    changed = places_changed(words, coverage)
    return -(-(words - changed) // (changed + 1))


def least_prints(words: int, coverage: float, gram: int, window: int) -> int:
    """Fingerprints that every such copy keeps: a run of ``gram + window - 1`` words has one, and
    each further ``window`` words one more."""
    changed = places_changed(words, coverage)
    spare = words - changed - (changed + 1) * (gram + window - 2)
    return max(1, -(-spare // window))


class PrintIndex:
    """Winnowed fingerprints of templates, by gram size and hash.

    The window is the widest at which every copy at the coverage keeps a fingerprint. A
    template so short that a copy may keep no ``gram`` words together has shorter grams.
    """

    def __init__(self, templates: dict[str, str], gram: int = GRAM, coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.offsets, self.words, _ = bare_words(pa.array([templates[n] for n in self.names], pa.string()))
        self.least = [0] * len(self.names)
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for k in range(len(self.names)):
            words = self.template(k)
            if not len(words):
                continue
            run = max(1, least_run(len(words), coverage))
            size = min(gram, run)
            window = run - size + 1
            grams = window_hashes(words, size)
            at = winnowed(grams, window)
            found.setdefault(size, []).append((grams[at], np.full(len(at), k), at))
            self.least[k] = least_prints(len(words), coverage, size, window)
        self.levels = []
        for size, parts in sorted(found.items()):
            hashes, owners, places = map(np.concatenate, zip(*parts))
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << 16, bool)
            table[hashes >> np.uint64(48)] = True
            self.levels.append((size, hashes[order], owners[order], places[order], table))

    def template(self, k: int) -> np.ndarray:
        return self.words[self.offsets[k]:self.offsets[k + 1]]

    def hits(self, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Fingerprints in texts: row, template, place in the text, place in the template.

        Every gram of a text is looked up, so a fingerprint is found wherever it stands.
        """
        out = [(np.empty(0, np.int64),) * 4]
        for size, hashes, owners, places, table in self.levels:
            starts, rows = inside_rows(offsets, size)
            if not len(starts):
                continue
            grams = window_hashes(words, size)[starts]
            maybe = np.flatnonzero(table[grams >> np.uint64(48)])
            low = np.searchsorted(hashes, grams[maybe], "left")
            n = np.searchsorted(hashes, grams[maybe], "right") - low
            at = np.repeat(maybe, n)
            to = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((rows[at], owners[to], (starts - offsets[:-1][rows])[at], places[to]))
        return tuple(map(np.concatenate, zip(*out)))


def banded_alignment(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Best alignment of a whole template near a diagonal: matched words, first and last matched place in the text.

    Cell (i, d) has the template's first ``i`` words behind it and the text's first
    ``i + shift + d - band``; a match scores 1, a mismatch, a word left out on either side -1,
    text before and behind the template nothing. So no matched word is cut off for changed
    ones beside it. Of equal scores the one with more matches counts. No match: (0, -1, -1).
    """
    unit = len(template) + 1  # scores are kept times this, plus the matches
    match, miss, gap = unit + 1, MISS * unit, GAP * unit
    never = -(1 << 40)
    width = 2 * band + 1
    score = np.full((len(template) + 1, width + 1), never, np.int64)  # the last column is outside the band
    steps = np.arange(width)
    behind = shift + steps - band
    score[0, :width] = np.where((behind >= 0) & (behind <= len(text)), 0, never)
    for i in range(len(template)):
        at = i + behind
        inside = (at >= 0) & (at < len(text))
        equal = inside & (text[np.where(inside, at, 0)] == template[i]) if len(text) else inside
        row = np.where(inside, score[i, :width] + np.where(equal, match, miss), never)
        row = np.maximum(row, score[i, 1:width + 1] + gap)
        row = np.maximum.accumulate(row - gap * steps) + gap * steps
        score[i + 1, :width] = np.where((at >= -1) & (at < len(text)), row, never)
    i, d = len(template), int(np.argmax(score[-1, :width]))
    matched, first, last = 0, -1, -1
    while i > 0 and score[i, d] > never // 2:
        at = i - 1 + shift + d - band
        equal = 0 <= at < len(text) and text[at] == template[i - 1]
        if 0 <= at < len(text) and score[i, d] == score[i - 1, d] + (match if equal else miss):
            if equal:
                matched, first, last = matched + 1, at, max(last, at)
            i -= 1
        elif score[i, d] == score[i - 1, d + 1] + gap:
            i, d = i - 1, d + 1
        elif d and score[i, d] == score[i, d - 1] + gap:
            d -= 1
        else:
            break
    return matched, int(first), int(last)


def copies(
    template: np.ndarray, text: np.ndarray, at: np.ndarray, place: np.ndarray, least: int, coverage: float,
) -> list[tuple[int, int, int]]:
    """Copies of a template in a text, from its fingerprints' places there: matched words, first, last.

    Fingerprints are taken in the order of where the template would start. A copy whose words
    shift by up to ``band`` to either side lies in the band around the first one of them that
    is aligned. A copy's words are taken out before the next alignment, so copies back to
    back are found one by one; a band without a copy is left behind as a whole.
    """
    length = len(template)
    band = max(4, length // 5)
    begin = at - place
    order = np.lexsort((at, begin))
    begin, at, place = begin[order], at[order], place[order]
    gone = np.uint64(0)
    while (template == gone).any():
        gone += np.uint64(1)
    own, found, k = False, [], 0
    while k < len(begin):
        if text[at[k]] == gone:  # part of a copy by now
            k += 1
            continue
        low = int(begin[k])
        end = int(np.searchsorted(begin, low + 3 * band, "right"))
        here = slice(k, end)
        left = text[at[here]] != gone
        behind = int(np.searchsorted(begin, low + band, "right"))
        first_word, last_word = max(low - band, 0), max(low + 3 * band + length, 0)
        if (
            len(np.unique(place[here][left])) < least
            or np.isin(text[first_word:last_word], template).sum() < coverage * length
        ):
            k = behind
            continue
        usual = low + int(np.argmax(np.bincount(begin[here][left] - low)))
        if usual >= 0 and np.array_equal(text[usual:usual + length], template):
            matched, first, last = length, usual, usual + length - 1  # a whole copy aligns with itself
        else:
            matched, first, last = banded_alignment(template, text, low + band, 2 * band)
        if matched < coverage * length:
            k = behind
            continue
        found.append((matched, first, last))
        if not own:
            text, own = text.copy(), True
        text[first:last + 1] = gone
    return sorted(found, key=lambda f: f[1:])


def licenses_in(index: PrintIndex, texts: pa.Array, coverage: float) -> list[list[dict]]:
    """For each text the templates it holds, with their spans in code points."""
    offsets, words, place = bare_words(texts)
    rows, names, at, in_template = index.hits(offsets, words)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    order = np.lexsort((names, rows))
    rows, names, at, in_template = rows[order], names[order], at[order], in_template[order]
    cuts = np.flatnonzero((np.diff(rows) != 0) | (np.diff(names) != 0)) + 1
    spans: dict[int, list[tuple[int, int]]] = {}
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]) if len(rows) else ():
        row, k = int(rows[low]), int(names[low])
        if high - low < index.least[k]:
            continue
        template = index.template(k)
        text = words[offsets[row]:offsets[row + 1]]
        for matched, first, last in copies(
            template, text, at[low:high], in_template[low:high], index.least[k], coverage
        ):
            if row not in spans:
                spans[row] = [m.span() for m in re.finditer(r"\S+", texts[row].as_py())]
            real = place[offsets[row]:offsets[row + 1]]
            out[row].append({
                "template": index.names[k], "matched_words": matched, "coverage": matched / len(template),
                "start": spans[row][int(real[first])][0], "end": spans[row][int(real[last])][1],
            })
    return out


def scan_licenses(
    df: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text",
    coverage: float = COVERAGE, out_col: str = "licenses",
) -> DataFrame:
    """``df`` with ``licenses``: each template found in the text, and where.

    An entry has ``template``, ``matched_words``, ``coverage`` (of the template's words) and
    ``start``, ``end`` (code points of the text, from the first to past the last matched
    word). Words are compared in lower case without marks. The index of the templates'
    winnowed fingerprints goes to the workers; its size is that of the templates, a
    parameter of the operator. A place with as many of a template's fingerprints as every
    copy keeps that differs in no more words than ``coverage`` allows is aligned, so copies
    with changed, missing or added words are found. Every copy of a template is reported,
    also back to back, and so is a notice that is part of a longer one. An alignment's memory
    depends on the template alone.

    Null and empty texts hold none. Repeated rows give equal results; an empty table gives an
    empty one. A column named like the new one is replaced. Templates without words are not found.
    """
    index = PrintIndex(TEMPLATES if templates is None else templates, coverage=coverage)
    held = df.sparkSession.sparkContext.broadcast(index)

    def make():
        from pyspark.sql.pandas.types import to_arrow_type

        kind, index = to_arrow_type(FOUND), held.value
        return lambda texts: [pa.array(licenses_in(index, texts, coverage), kind)]

    return with_arrow_columns(df, text_col, [T.StructField(out_col, FOUND)], make)


def op7_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs).select("doc_id", F.explode("licenses").alias("f")).select("doc_id", "f.*")
    return found.withColumn("coverage", F.round("coverage", 6))
