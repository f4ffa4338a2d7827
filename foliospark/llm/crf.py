"""A linear-chain conditional random field over sparse discrete features, trained by full-batch gradient ascent with
Adam steps and an L2 penalty, and decoded by Viterbi. Deterministic: the same pages give the same weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainCRF:
    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.features: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.labels)))
        self.move = np.zeros((len(self.labels), len(self.labels)))
        self.start = np.zeros(len(self.labels))

    def fit(self, chains: Sequence[Sequence[tuple[Sequence[str], str]]], steps: int = 60, rate: float = 0.15, penalty: float = 1e-3) -> "ChainCRF":
        """``chains`` are labelled pages: for each leaf its features and its label."""
        index, size = self.features, len(self.labels)
        known = {label: k for k, label in enumerate(self.labels)}
        chains = [c for c in chains if c]
        longest = max(map(len, chains))
        rows, cols, gold = [], [], np.full((len(chains), longest), -1)
        for i, chain in enumerate(chains):
            for j, (names, label) in enumerate(chain):
                gold[i, j] = known[label]
                for name in names:
                    rows.append(i * longest + j)
                    cols.append(index.setdefault(name, len(index)))
        rows, cols = np.array(rows), np.array(cols)
        real = gold >= 0
        lengths = real.sum(1)
        weights = [np.zeros((len(index), size)), np.zeros((size, size)), np.zeros(size)]
        seen = [np.zeros_like(w) for w in weights]
        np.add.at(seen[0], cols, np.eye(size)[np.maximum(gold.ravel(), 0)][rows])
        both = real[:, 1:]
        np.add.at(seen[1], (gold[:, :-1][both], gold[:, 1:][both]), 1)
        np.add.at(seen[2], gold[:, 0], 1)
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            emit, move, start = weights
            score = np.zeros((len(chains) * longest, size))
            np.add.at(score, rows, emit[cols])
            score = score.reshape(len(chains), longest, size)
            forward, backward = np.zeros_like(score), np.zeros_like(score)
            forward[:, 0] = start + score[:, 0]
            for j in range(1, longest):
                reached = score[:, j] + _logsum(forward[:, j - 1, :, None] + move, 1)
                forward[:, j] = np.where(real[:, j, None], reached, forward[:, j - 1])
            for j in range(longest - 2, -1, -1):
                reached = _logsum(move + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
                backward[:, j] = np.where(real[:, j + 1, None], reached, 0)
            total = _logsum(forward[np.arange(len(chains)), lengths - 1], 1)
            alone = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
            expected = [np.zeros_like(w) for w in weights]
            np.add.at(expected[0], cols, alone.reshape(-1, size)[rows])
            for j in range(1, longest):
                pair = forward[:, j - 1, :, None] + move + (score[:, j] + backward[:, j])[:, None, :] - total[:, None, None]
                expected[1] += (np.exp(pair) * real[:, j, None, None]).sum(0)
            expected[2] = alone[:, 0].sum(0)
            for k in range(3):
                slope = (seen[k] - expected[k]) / len(chains) - penalty * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.99 * second[k] + 0.01 * slope**2
                weights[k] = weights[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        self.emit, self.move, self.start = weights
        return self

    def evidence(self, names: Sequence[str]) -> list[float]:
        """The emission scores of a leaf with these features."""
        score = np.zeros(len(self.labels))
        for name in names:
            if (k := self.features.get(name)) is not None:
                score = score + self.emit[k]
        return score.tolist()

    def viterbi(self, evidence: Sequence[Sequence[float]]) -> list[int]:
        if not evidence:
            return []
        columns = getattr(self, "_columns", None)
        if columns is None:
            columns = self._columns = self.move.T.tolist()
        best = [s + e for s, e in zip(self.start.tolist(), evidence[0])]
        back = []
        for own in evidence[1:]:
            marks, scores = [], []
            for column, e in zip(columns, own):
                reached = [b + m for b, m in zip(best, column)]
                top = max(reached)
                marks.append(reached.index(top))
                scores.append(top + e)
            back.append(marks)
            best = scores
        at = best.index(max(best))
        path = [at]
        for marks in reversed(back):
            at = marks[at]
            path.append(at)
        path.reverse()
        return path
