"""A linear-chain conditional random field over words: hashed features, forward-backward, fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex

from .arrowtext import gathered, mixed, word_hashes

NOT_LETTERS = regex.compile(r"\P{L}+")
GRAMS = (2, 3, 4, 5)
CHAIN_BLOCK = 32


@dataclass
class Features:
    """Feature numbers of distinct words: word ``i`` has ``ids[offsets[i]:offsets[i + 1]]``."""

    ids: np.ndarray
    offsets: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros((len(self.offsets) - 1, weights.shape[1]))
        return np.add.reduceat(weights[self.ids], self.offsets[:-1], axis=0)


def word_features(forms: list[str], bits: int, lexicon: np.ndarray | None) -> Features:
    """Hashed features of words, which are not empty.

    A word is read with a mark before and after it. Its letter n-grams are features;
    those that touch a mark are its prefixes and suffixes. The whole word is one more if
    the lexicon (sorted hashes; None for all words) has it.
    """
    text = "".join(f"\x02{w}\x03" for w in forms)
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, forms), np.int64, len(forms)) + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place  # letters from here to the word's end
    word = np.repeat(np.arange(len(forms)), sizes)
    found, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        value = np.full(len(at), n, np.uint64)
        for j in range(n):
            value = mixed(value) + letters[at + j]
        found.append(mixed(value))
        owners.append(word[at])
    whole = word_hashes(forms)
    known = np.ones(len(forms), bool) if lexicon is None else np.isin(whole, lexicon)
    found.append(mixed(whole[known] + np.uint64(1)))
    owners.append(np.flatnonzero(known))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(found)[order] >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.bincount(owner, minlength=len(forms))
    return Features(ids, np.concatenate([[0], np.cumsum(counts)]))


def _by_block(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut into blocks: first word, size, sequence and number in it of each block."""
    blocks = -(-np.diff(offsets) // CHAIN_BLOCK)
    sequence = np.repeat(np.arange(len(blocks)), blocks)
    number = np.arange(len(sequence)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][sequence] + number * CHAIN_BLOCK
    return start, np.minimum(offsets[1:][sequence] - start, CHAIN_BLOCK), sequence, number


def forward_backward(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray):
    """Forward and backward vectors (scaled) of every word, and its potentials.

    ``scores`` are the words' log potentials, ``transitions[i, j]`` that of label j after
    i. Every sequence is cut into short blocks. A block's effect is a matrix, the product
    of its steps; these are chained over a sequence's blocks, and then all blocks of all
    sequences run side by side from their right start and end vectors. The result is
    exact, and a very long text costs no more Python steps than many short ones.
    """
    n, labels = scores.shape
    potential = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max())
    start, size, sequence, number = _by_block(offsets)
    first = number == 0
    blocks = len(start)
    product = np.tile(np.eye(labels), (blocks, 1, 1))
    for t in range(CHAIN_BLOCK):
        live = np.flatnonzero(size > t)
        if not len(live):
            break
        moved = product[live]
        stepped = (moved.reshape(-1, labels) @ step).reshape(-1, labels, labels)
        if t == 0:  # nothing comes before the first word of a sequence
            stepped[first[live]] = moved[first[live]]
        stepped *= potential[start[live] + t][:, None, :]
        stepped /= stepped.sum(axis=(1, 2), keepdims=True)
        product[live] = stepped
    into = np.ones((blocks, labels)) / labels
    out_of = np.ones((blocks, labels)) / labels
    by_number = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[by_number], np.arange(number.max() + 2)) if blocks else np.zeros(1, np.int64)
    for k in range(1, len(cuts) - 1):
        at = by_number[cuts[k]:cuts[k + 1]]
        v = np.einsum("bi,bij->bj", into[at - 1], product[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(len(cuts) - 3, -1, -1):
        after = by_number[cuts[k + 1]:cuts[k + 2]]
        v = np.einsum("bij,bj->bi", product[after], out_of[after])
        out_of[after - 1] = v / v.sum(axis=1, keepdims=True)
    forward, backward = np.empty((n, labels)), np.empty((n, labels))
    carry = into
    for t in range(CHAIN_BLOCK):
        live = np.flatnonzero(size > t)
        if not len(live):
            break
        v = carry[live] @ step
        if t == 0:
            v[first[live]] = 1.0 / labels
        v *= potential[start[live] + t]
        v /= v.sum(axis=1, keepdims=True)
        carry[live] = forward[start[live] + t] = v
    carry = out_of.copy()
    for t in reversed(range(CHAIN_BLOCK)):
        live = np.flatnonzero(size > t)
        if not len(live):
            continue
        at = start[live] + t
        backward[at] = carry[live]
        v = (carry[live] * potential[at]) @ step.T
        carry[live] = v / v.sum(axis=1, keepdims=True)
    return forward, backward, potential, step


def label_chances(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The posterior chance of each label for each word."""
    if not len(scores):
        return np.empty_like(scores)
    forward, backward, _, _ = forward_backward(scores, offsets, transitions)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def fit(
    sequences: list[tuple[np.ndarray, np.ndarray]], features: Features, labels: int, bits: int,
    epochs: int, batch_words: int = 6000, rate: float = 0.3, decay: float = 1e-6, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that make the labels of the sequences likely.

    A sequence is (codes of its words, labels of its words). Gradient steps of the
    conditional log likelihood, with step sizes that shrink per weight (Adagrad); the
    expected counts come from forward-backward. Same input, same model.
    """
    weights, move = np.zeros((1 << bits, labels)), np.zeros((labels, labels))
    seen, seen_move = np.full((1 << bits, labels), 1e-8), np.full((labels, labels), 1e-8)
    random = np.random.default_rng(seed)
    sizes = np.diff(features.offsets)
    for _ in range(epochs):
        order = random.permutation(len(sequences))
        total = np.cumsum([len(sequences[k][0]) for k in order])
        for group in np.split(order, np.searchsorted(total, np.arange(batch_words, total[-1], batch_words))):
            if not len(group):
                continue
            codes = np.concatenate([sequences[k][0] for k in group])
            gold = np.concatenate([sequences[k][1] for k in group])
            offsets = np.concatenate([[0], np.cumsum([len(sequences[k][0]) for k in group])])
            used, inverse = np.unique(codes, return_inverse=True)
            ids = gathered(features.ids, features.offsets[used], sizes[used])
            part = Features(ids, np.concatenate([[0], np.cumsum(sizes[used])]))
            forward, backward, potential, step = forward_backward(part.scores(weights)[inverse], offsets, move)
            both = forward * backward
            wrong = -both / both.sum(axis=1, keepdims=True)
            wrong[np.arange(len(gold)), gold] += 1
            by_word = np.stack([np.bincount(inverse, wrong[:, j], len(used)) for j in range(labels)], axis=1)
            touched, place = np.unique(ids, return_inverse=True)
            spread = np.repeat(by_word, sizes[used], axis=0)
            slope = np.stack(
                [np.bincount(place, spread[:, j], len(touched)) for j in range(labels)], axis=1
            ) / len(gold) - decay * weights[touched]
            seen[touched] += slope ** 2
            weights[touched] += rate * slope / np.sqrt(seen[touched])
            later = np.setdiff1d(np.arange(len(gold)), offsets[:-1])
            right = potential[later] * backward[later]
            mass = ((forward[later - 1] @ step) * right).sum(axis=1, keepdims=True)
            expected = step * (forward[later - 1].T @ (right / mass))
            real = np.zeros_like(move)
            np.add.at(real, (gold[later - 1], gold[later]), 1)
            slope_move = (real - expected) / len(gold)
            seen_move += slope_move ** 2
            move += rate * slope_move / np.sqrt(seen_move)
    return weights.astype(np.float32), move
