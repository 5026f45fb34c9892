"""A linear-chain conditional random field over clauses with binary features."""

from __future__ import annotations

import numpy as np


class Chain:
    """Emission weights (features x labels), transitions, starts."""

    def __init__(self, features: int, labels: int) -> None:
        self.w = np.zeros((features, labels))
        self.t = np.zeros((labels, labels))
        self.s = np.zeros(labels)

    def fit(self, kinds: np.ndarray, which: np.ndarray, y: np.ndarray, lengths: np.ndarray, often: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> "Chain":
        """Maximum likelihood by Adam.

        kinds: the distinct feature rows; which: of each step of the sequences,
        one after another, its row there; y: its label; often: how often each
        sequence counts.
        """
        order = np.argsort(-lengths, kind="stable")
        first, sizes, often = np.r_[0, np.cumsum(lengths)[:-1]][order], lengths[order], often[order]
        k, total, n = len(self.s), often.sum(), len(which)
        alive = [int(np.searchsorted(-sizes, -i, side="left")) for i in range(int(sizes[0]))]  # sequences longer than i
        at = [first[:m] + i for i, m in enumerate(alive)]
        weight = np.zeros(n)
        for i, m in enumerate(alive):
            weight[at[i]] = often[:m]
        gold = np.eye(k)[y] * weight[:, None]
        pairs = np.zeros((k, k))
        for i in range(1, len(alive)):
            np.add.at(pairs, (y[at[i] - 1], y[at[i]]), often[: alive[i]])
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w, self.t, self.s)]
        for r in range(1, rounds + 1):
            e = (kinds @ self.w)[which]
            alpha, beta, z = np.empty((n, k)), np.zeros((n, k)), np.empty(len(sizes))
            alpha[at[0]] = e[at[0]] + self.s
            for i in range(1, len(alive)):
                alpha[at[i]] = _lse(alpha[at[i] - 1][:, :, None] + self.t, 1) + e[at[i]]
            z = _lse(alpha[first + sizes - 1], 1)
            both = np.zeros((k, k))
            for i in range(len(alive) - 1, 0, -1):
                ahead = self.t + (e[at[i]] + beta[at[i]])[:, None, :]
                beta[at[i] - 1] = _lse(ahead, 2)
                both += (np.exp(alpha[at[i] - 1][:, :, None] + ahead - z[: alive[i], None, None]) * often[: alive[i], None, None]).sum(0)
            norm = np.empty(n)
            for i, m in enumerate(alive):
                norm[at[i]] = z[:m]
            p = np.exp(alpha + beta - norm[:, None]) * weight[:, None]
            missed = np.stack([np.bincount(which, x, len(kinds)) for x in (gold - p).T], 1)
            grads = (kinds.T @ missed / total - decay * self.w, (pairs - both) / total - decay * self.t, (gold[at[0]] - p[at[0]]).sum(0) / total - decay * self.s)
            for value, g, (m, v) in zip((self.w, self.t, self.s), grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        return self

    def decode(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of each step; ``emissions`` holds the sequences one after another, side by side they are walked step by step."""
        out = np.zeros(len(emissions), dtype=np.int8)
        if not len(lengths):
            return out
        first = np.r_[0, np.cumsum(lengths)[:-1]]
        order = np.argsort(-lengths, kind="stable")
        first, sizes = first[order], lengths[order]
        steps = int(sizes[0])
        alive = [int(np.searchsorted(-sizes, -i, side="left")) for i in range(steps)]  # sequences longer than i
        score = emissions[first[: alive[0]]] + self.s
        back: list[np.ndarray] = []
        ends = np.empty(len(sizes), dtype=np.int8)
        for i in range(1, steps + 1):
            now = alive[i] if i < steps else 0
            ends[now : len(score)] = score[now:].argmax(1)
            if i == steps:
                break
            reach = score[:now, :, None] + self.t
            back.append(reach.argmax(1).astype(np.int8))
            score = reach.max(1) + emissions[first[:now] + i]
        state = np.empty(0, dtype=np.int8)
        for i in range(steps - 1, -1, -1):
            if i < steps - 1:
                state = back[i][np.arange(len(state)), state]
            state = np.r_[state, ends[len(state) : alive[i]]]
            out[first[: alive[i]] + i] = state
        return out


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis))
