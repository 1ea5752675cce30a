"""A linear-chain conditional random field in numpy: fitting by gradient, Viterbi in batches."""

from __future__ import annotations

import numpy as np

OUT = -1e9


class Chain:
    """Weights of labels given the words around a place, and of label pairs.

    The score of label l at place t is the sum over offsets o of the weights of
    the features of the word at t + o.  ``start`` and ``stop`` are fixed to the
    label 0, so a stretch is decoded as if label 0 stood on either side.
    """

    def __init__(self, labels: list[str], offsets: tuple[int, ...] = (-2, -1, 0, 1, 2)):
        self.labels, self.offsets = labels, offsets
        self.feature_of: dict[str, int] = {}
        self.weights = np.zeros((len(offsets), 0, len(labels)))
        self.pairs = np.zeros((len(labels), len(labels)))

    def fit(self, features: list[list[list[str]]], gold: list[list[int]], allowed: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 0.0002) -> Chain:
        """Maximise the regularised likelihood with Adam over the whole table.

        ``gold`` has the labels of each stretch; ``features`` those of its words
        with two words of context on either side; ``allowed`` the label pairs
        that can follow one another.
        """
        for row in features:
            for word in row:
                for f in word:
                    self.feature_of.setdefault(f, len(self.feature_of))
        size = len(self.labels)
        words: dict[tuple[str, ...], int] = {}
        buckets = []
        lengths = np.array([len(g) for g in gold])
        for low, high in ((0, 3), (3, 6), (6, 10), (10, 16), (16, 1 << 30)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(rows):
                buckets.append(self._padded([features[i] for i in rows], [gold[i] for i in rows], words))
        hot = np.zeros((len(words) + 1, len(self.feature_of)), np.float32)
        for w, k in words.items():
            hot[k, [self.feature_of[f] for f in w]] = 1
        self.weights = np.zeros((len(self.offsets), len(self.feature_of), size), np.float32)
        self.pairs = np.zeros((size, size), np.float32)
        closed = np.where(allowed, 0.0, OUT).astype(np.float32)
        state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (self.weights, self.pairs)]
        for step in range(1, rounds + 1):
            tables = [hot @ w for w in self.weights]
            trans = self.pairs + closed
            per_word = np.zeros((len(self.offsets), len(words) + 1, size))
            pair_miss = np.zeros((size, size))
            for b in buckets:
                self._gradient(b, tables, trans, per_word, pair_miss)
            grads = (np.array([hot.T @ p.astype(np.float32) for p in per_word]) / len(gold), pair_miss / len(gold))
            for (x, m1, m2), g in zip(state, grads, strict=True):
                g = (g - decay * x).astype(np.float32)
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.99
                m2 += 0.01 * g * g
                x += rate * min(1.0, 1.5 * (1 - (step - 1) / rounds)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        self.pairs = self.pairs + closed
        return self

    def _padded(self, features, gold, words):
        """Word numbers with two places of context on either side, labels and mask of some stretches."""
        n, longest = len(gold), max(map(len, gold))
        word = np.zeros((n, longest + 4), np.int64)
        y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (row, g) in enumerate(zip(features, gold, strict=True)):
            word[i, : len(row)] = [words.setdefault(tuple(w), len(words) + 1) for w in row]
            y[i, : len(g)], mask[i, : len(g)] = g, True
        groups = []
        for o in self.offsets:
            flat = word[:, 2 + o : 2 + o + longest].ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
            groups.append((order, first, flat[order][first]))
        return word, y, mask, groups

    def _gradient(self, bucket, tables, trans, per_word, pair_miss) -> None:
        word, y, mask, groups = bucket
        n, longest = y.shape
        size = len(self.labels)
        last = mask.sum(1) - 1
        emit = sum(t[word[:, 2 + o : 2 + o + longest]] for o, t in zip(self.offsets, tables, strict=True))
        alpha, beta = np.zeros((n, longest, size), np.float32), np.zeros((n, longest, size), np.float32)
        alpha[:, 0] = emit[:, 0] + trans[0]
        for t in range(1, longest):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + trans[None], 1) + emit[:, t]
        rows = np.arange(n)
        total = _logsum(alpha[rows, last] + trans[:, 0], 1)
        beta[:, longest - 1] = trans[:, 0]
        for t in range(longest - 2, -1, -1):
            b = _logsum(trans[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t >= last)[:, None], trans[None, :, 0], b)
        p = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * mask[..., None]
        miss = np.eye(size)[y] * mask[..., None] - p
        for k, (order, first, which) in enumerate(groups):
            per_word[k][which] += np.add.reduceat(miss.reshape(-1, size)[order], first)
        before = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], 1)
        np.add.at(pair_miss, (before[mask], y[mask]), 1)
        np.add.at(pair_miss, (y[rows, last], np.zeros(n, np.int64)), 1)
        np.subtract.at(pair_miss, (slice(None), 0), np.exp(np.minimum(alpha[rows, last] + trans[:, 0] - total[:, None], 0)).sum(0))
        pair_miss[0] -= p[:, 0].sum(0)
        for t in range(1, longest):
            q = np.exp(np.minimum(alpha[:, t - 1, :, None] + trans[None] + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None], 0))
            pair_miss -= (q * mask[:, t, None, None]).sum(0)

    def rows(self, features: list[str]) -> np.ndarray:
        """Scores that a word with these features adds at each offset: (offsets, labels)."""
        known = [self.feature_of[f] for f in features if f in self.feature_of]
        return self.weights[:, known].sum(1)

    def viterbi(self, emit: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels of the stretches ``start``, ``length`` of ``emit``; all stretches advance together."""
        best = np.zeros(len(emit), np.int8)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        trans = self.pairs.astype(np.float32)
        for first in range(0, len(start), 20_000):
            s, n = start[first : first + 20_000], length[first : first + 20_000]
            score = emit[s] + trans[0]
            back = np.zeros((n[0], len(s), len(self.labels)), np.int8)
            live = len(s)
            for t in range(1, n[0]):
                live = int(np.searchsorted(-n, -t, "left"))  # stretches longer than t come first
                step = score[:live, :, None] + trans[None]
                back[t, :live] = step.argmax(1)
                score[:live] = step.max(1) + emit[s[:live] + t]
            label = (score + trans[:, 0]).argmax(1)
            for t in range(n[0] - 1, -1, -1):
                live = int(np.searchsorted(-n, -t, "left"))
                best[s[:live] + t] = label[:live]
                if t:
                    label[:live] = back[t, np.arange(live), label[:live]]
        return best


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)
