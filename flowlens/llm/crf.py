"""A linear-chain conditional random field in numpy: training, Viterbi and forward-backward over batches of windows.

Tokens of a batch are one flat array; ``windows`` cuts each sequence into windows of ``core`` tokens with ``context`` more on either
side, of which only the core's tags or marginals count. All windows of a batch advance together, one position at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def windows(lengths: np.ndarray, core: int = 64, context: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token indices (windows, width), which of them exist, and which are the window's own (each token is one window's own)."""
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    per = -(-lengths // core)
    seq = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    width = core + 2 * context
    inside = nth[:, None] * core - context + np.arange(width)
    exists = (inside >= 0) & (inside < lengths[seq][:, None])
    own = exists & (np.arange(width) >= context) & (np.arange(width) < context + core)
    return np.where(exists, inside + at[seq][:, None], 0), exists, own


@dataclass
class Crf:
    """weights: (feature buckets, labels), one row per feature value; step: (labels, labels) from previous to next; start: (labels,)."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = self.weights[features[0]]
        for f in features[1:]:
            out += self.weights[f]
        return out

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best label of each token."""
        index, exists, own = windows(lengths)
        best = np.zeros(len(emissions), np.int8)
        labels = self.step.shape[0]
        for rows in _parts(len(index)):
            i, there = index[rows].T, exists[rows].T
            back = np.zeros((*i.shape, labels), np.int8)
            score = None
            for t in range(len(i)):
                e = emissions[i[t]]
                if score is None:
                    score = np.where(there[t][:, None], self.start + e, 0)
                    continue
                top, arg = score[:, :1] + self.step[0], np.zeros(score.shape, np.int8)
                for k in range(1, labels):
                    other = score[:, k : k + 1] + self.step[k]
                    better = other > top
                    top[better] = other[better]
                    arg[better] = k
                new = ~there[t - 1][:, None]  # the window begins here
                score, back[t] = np.where(there[t][:, None], np.where(new, self.start + e, top + e), score), np.where(there[t][:, None] & ~new, arg, np.arange(labels, dtype=np.int8))
            label, lane = score.argmax(1).astype(np.int8), np.arange(i.shape[1])
            mine = own[rows].T
            for t in range(len(i) - 1, -1, -1):
                best[i[t][mine[t]]] = label[mine[t]]
                label = back[t][lane, label]
        return best

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of each label at each token, by forward-backward with scaling."""
        index, exists, own = windows(lengths)
        out = np.zeros(emissions.shape)
        step, start = np.exp(self.step), np.exp(self.start)
        for rows in _parts(len(index)):
            i, there, mine = index[rows].T, exists[rows].T[:, :, None], own[rows].T
            forward = np.ones((*i.shape, len(start)))
            factor = np.exp(emissions[i] - emissions[i].max(axis=2, keepdims=True))
            state = np.broadcast_to(start, forward.shape[1:])
            for t in range(len(i)):
                arrived = state @ step if t else state
                if t:
                    arrived = np.where(there[t - 1], arrived, start)
                now = arrived * factor[t]
                state = np.where(there[t], now / now.sum(1, keepdims=True), state)
                forward[t] = state
            beta = np.ones(forward.shape[1:])
            for t in range(len(i) - 1, -1, -1):
                p = forward[t] * beta
                p /= p.sum(1, keepdims=True)
                out[i[t][mine[t]]] = p[mine[t]]
                passed = (factor[t] * beta) @ step.T
                beta = np.where(there[t], passed / passed.sum(1, keepdims=True), beta)
        return out


def _parts(n: int, size: int = 4096) -> list[slice]:
    return [slice(a, a + size) for a in range(0, n, size)]


def train(features: list[np.ndarray], labels: np.ndarray, lengths: np.ndarray, buckets: int, kinds: int, epochs: int = 60, rate: float = 0.5, penalty: float = 1e-4) -> Crf:
    """Maximum likelihood by Adagrad on the full (small) table: features, one array per feature, and labels of flat sequences.

    Sequences must fit into one window. The gradient is observed minus expected counts, the latter from forward-backward.
    """
    used, compact = np.unique(np.concatenate(features), return_inverse=True)
    features = np.split(compact, len(features))
    w, step, start = np.zeros((len(used), kinds)), np.zeros((kinds, kinds)), np.zeros(kinds)
    sums = [np.full_like(x, 1e-8) for x in (w, step, start)]
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    width = int(lengths.max())
    index = np.minimum(at[:, None] + np.arange(width), len(labels) - 1).T
    there = (np.arange(width)[:, None] < lengths)[:, :, None]
    observed = np.eye(kinds)[labels]
    inner = np.ones(len(labels), bool)
    inner[at] = False
    seen_step = np.zeros_like(step)
    np.add.at(seen_step, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    for _ in range(epochs):
        e = w[features[0]].copy()
        for f in features[1:]:
            e += w[f]
        factor = np.exp(e - e.max(1, keepdims=True))[index]
        move, begin = np.exp(step), np.exp(start)
        forward, state = np.zeros((width, len(lengths), kinds)), np.broadcast_to(begin, (len(lengths), kinds))
        for t in range(width):
            now = (state @ move if t else state) * factor[t]
            state = np.where(there[t], now / now.sum(1, keepdims=True), state)
            forward[t] = state
        expected, expected_step, beta = np.zeros_like(e), np.zeros_like(step), np.ones((len(lengths), kinds))
        for t in range(width - 1, -1, -1):
            p = forward[t] * beta
            p /= p.sum(1, keepdims=True)
            live = there[t][:, 0]
            expected[index[t][live]] = p[live]
            if t:
                pair = forward[t - 1][:, :, None] * move * (factor[t] * beta)[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                expected_step += pair[live].sum(0)
                passed = (factor[t] * beta) @ move.T
                beta = np.where(there[t], passed / passed.sum(1, keepdims=True), beta)
        scale = 1 / len(lengths)
        gap = (observed - expected) * scale
        gw = np.zeros_like(w)
        for f in features:
            for k in range(kinds):
                gw[:, k] += np.bincount(f, gap[:, k], len(used))
        for x, g, s in zip((w, step, start), (gw - penalty * w, (seen_step - expected_step) * scale - penalty * step, gap[at].sum(0) - penalty * start), sums):
            s += g * g
            x += rate * g / np.sqrt(s)
    weights = np.zeros((buckets, kinds), np.float32)
    weights[used] = w
    return Crf(weights, step.astype(np.float32), start.astype(np.float32))
