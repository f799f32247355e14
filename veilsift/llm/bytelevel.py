"""What the vocabulary files of byte-level tokenizers share: paths, alphabet, text pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

from .arrowtext import Words, distinct_parts

#: White space as the tokenizers' patterns read it (the Unicode property White_Space). Fixed values.
SPACE = "".join(map(chr, [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
KEPT_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_CLASS = r"[\s\v\x{85}\p{Z}]"
#: A space inside or at the end of a longer run of white space.
RUN_WITH_SPACE = rf"{_CLASS} ({_CLASS}|\z)"


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """The place of a public vocabulary file, in ``folder`` if one is given."""
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [shown[b] for b in range(256)]


def load_tokenizer(path: str):
    """The tokenizers library's tokenizer, on one thread: Spark spreads the work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces_without_space(texts: pa.Array) -> Words:
    """Parts between ASCII white space, for tokenizers that drop white space.

    No token, special string or normal form of theirs spans white space, so each part
    can be encoded alone.
    """
    return distinct_parts(pc.ascii_split_whitespace(texts))


def pieces_with_space(texts: pa.Array) -> Words:
    """Parts that start with their white space, for tokenizers that keep it.

    Their patterns always break where a run of white space starts, so each part can be
    encoded alone. Most texts have single spaces only and are cut at these by Arrow;
    in the others, a run of white space stays whole.
    """
    runs = pc.match_substring_regex(texts, RUN_WITH_SPACE).to_numpy(zero_copy_only=False)
    simple = np.flatnonzero(~runs)
    cut = distinct_parts(pc.split_pattern(texts.take(pa.array(simple)), " "), keep_empty=True)
    distinct, counts = [" " + p for p in cut.distinct], np.zeros(len(texts), np.int64)
    counts[simple] = np.diff(cut.offsets)
    codes = cut.codes.copy()
    index: dict[str, int] = {p: k for k, p in enumerate(distinct)}

    def code(piece: str) -> int:
        k = index.setdefault(piece, len(distinct))
        if k == len(distinct):
            distinct.append(piece)
        return k

    for start in cut.offsets[:-1]:  # the first part of a text has no space before it
        codes[start] = code(distinct[codes[start]][1:])
    if runs.any():
        whole = {int(r): [code(p) for p in KEPT_PIECE.findall(texts[int(r)].as_py())] for r in np.flatnonzero(runs)}
        parts, at = [], dict(zip(simple.tolist(), range(len(simple))))
        for r in range(len(texts)):
            if r in whole:
                counts[r] = len(whole[r])
                parts.append(np.array(whole[r], np.int64))
            else:
                k = at[r]
                parts.append(codes[cut.offsets[k]:cut.offsets[k + 1]])
        codes = np.concatenate(parts) if parts else codes
    return Words(np.concatenate([[0], np.cumsum(counts)]), codes, distinct)


class PieceCache:
    """Results for text pieces, kept from task to task in a worker, up to a number of entries and bytes
    and the last call's new ones.

    A full cache takes no more, so memory stays bounded; the pieces met first are mostly
    the frequent ones. Results do not depend on it.
    """

    ENTRY = 200  # bytes that an entry takes besides its piece and result, about

    def __init__(self, compute: Callable[[list[str]], list], size: int = 400_000, limit: int = 96 << 20):
        self.compute, self.size, self.limit, self.known, self.used = compute, size, limit, {}, 0

    def __call__(self, pieces: Sequence[str]) -> list:
        found = list(map(self.known.get, pieces))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            new = list(dict.fromkeys([pieces[k] for k in missing]))
            made = dict(zip(new, self.compute(new)))
            for k in missing:
                found[k] = made[pieces[k]]
            if len(self.known) < self.size and self.used < self.limit:
                for piece, x in made.items():
                    if len(piece) <= 64:
                        self.known[piece] = x
                        self.used += self.ENTRY + len(piece) + (len(x) if isinstance(x, bytes) else 0)
        return found


def in_byte_batches(pieces: list[str], limit: int) -> list[list[str]]:
    """Consecutive pieces in batches of about ``limit`` characters."""
    batches, size = [[]], 0
    for p in pieces:
        if size and size + len(p) > limit:
            batches.append([])
            size = 0
        batches[-1].append(p)
        size += len(p) + 8
    return batches


_WORKER: dict = {}


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """A value made once in each Python worker; workers outlive an operator, so another one's is let go."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]
