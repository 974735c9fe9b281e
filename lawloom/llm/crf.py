"""A linear-chain conditional random field over sparse features, trained by gradient ascent on flat arrays of positions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Sequences are trained in runs of at most this many positions, so one very long sequence costs no more than its size.
RUN = 50


@dataclass(frozen=True)
class Positions:
    """Sparse features of positions: those of position p are ids[starts[p]:starts[p + 1]] with their values; none is without one."""

    ids: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, features: Sequence[tuple[Sequence[int], Sequence[float]]]) -> Positions:
        sizes = np.fromiter((len(i) for i, _ in features), np.int64, len(features))
        ids = np.fromiter((x for i, _ in features for x in i), np.int64, int(sizes.sum()))
        values = np.fromiter((x for _, v in features for x in v), np.float32, len(ids))
        return cls(ids, values, np.concatenate([[0], np.cumsum(sizes)]))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """positions x tags."""
        if len(self.starts) == 1:
            return np.zeros((0, weights.shape[1]))
        return np.add.reduceat(weights[self.ids] * self.values[:, None], self.starts[:-1], axis=0)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Field:
    """weights: features x tags; moves: tag x next tag; starts, ends: by tag."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def decode(self, scores: np.ndarray) -> list[int]:
        """The most likely tags of one sequence, from the scores of its positions."""
        if len(scores) == 1:
            return [int((self.starts + scores[0] + self.ends).argmax())]
        best, back = self.starts + scores[0], []
        for row in scores[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        tags = [int((best + self.ends).argmax())]
        for place in reversed(back):
            tags.append(int(place[tags[-1]]))
        return tags[::-1]


def train(x: Positions, tags: np.ndarray, sizes: Sequence[int], kinds: int, width: int, rounds: int = 80, rate: float = 0.15, ridge: float = 3e-4, begin: Field | None = None, weight: np.ndarray | None = None) -> Field:
    """The field that makes the tags likeliest, with a ridge; sizes are the lengths of the sequences, weight what each counts.

    Full-batch Adam from zero (or from a field), so the same data give the same field. Memory is that of the features
    and a few numbers for each position.
    """
    runs, counts = [], []
    for k, n in enumerate(sizes):
        for part in range(0, n, RUN):
            runs.append(min(RUN, n - part))
            counts.append(1.0 if weight is None else float(weight[k]))
    length, count = np.array(runs, np.int64), np.array(counts)
    offset = np.concatenate([[0], np.cumsum(length)[:-1]])
    order = np.argsort(-length, kind="stable")
    length, offset, count = length[order], offset[order], count[order]
    at = [offset[: int((length > t).sum())] + t for t in range(int(length.max()))]  # the positions of step t, longest runs first
    last, total = offset + length - 1, count.sum()
    own = np.empty(len(tags))
    for o, n, c in zip(offset, length, count, strict=True):
        own[o : o + n] = c
    row = np.repeat(np.arange(len(tags)), np.diff(x.starts))
    gold = np.eye(kinds)[tags]
    parameters = [np.zeros((width, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds), np.zeros(kinds)]
    if begin is not None:
        parameters = [begin.weights.copy(), begin.moves.copy(), begin.starts.copy(), begin.ends.copy()]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    seen = np.zeros((kinds, kinds))
    for here, there in zip(at, at[1:], strict=False):
        np.add.at(seen, (tags[here[: len(there)]], tags[there]), own[there])
    for step in range(1, rounds + 1):
        weights, moves, starts, ends = parameters
        scores = x.scores(weights)
        forward, backward = np.empty_like(scores), np.empty_like(scores)
        forward[at[0]] = starts + scores[at[0]]
        for here, there in zip(at, at[1:], strict=False):
            forward[there] = _logsumexp(forward[here[: len(there)], :, None] + moves, 1) + scores[there]
        whole = _logsumexp(forward[last] + ends, 1)
        backward[last] = ends
        pairs = np.zeros((kinds, kinds))
        for here, there in zip(reversed(at[:-1]), reversed(at[1:]), strict=True):
            here = here[: len(there)]
            inner = scores[there] + backward[there]
            backward[here] = _logsumexp(moves[None] + inner[:, None, :], 2)
            joint = np.exp(forward[here][:, :, None] + moves + inner[:, None, :] - whole[: len(there), None, None])
            pairs += (joint * count[: len(there), None, None]).sum(axis=0)
        norm = np.empty(len(tags))
        for t, here in enumerate(at):
            norm[here] = whole[: len(here)]
        error = (gold - np.exp(forward + backward - norm[:, None])) * own[:, None]
        spread = np.stack([np.bincount(x.ids, weights=x.values * error[row, k], minlength=width) for k in range(kinds)], axis=1)
        gradient = [spread / total - ridge * weights, (seen - pairs) / total - ridge * moves, error[offset].sum(axis=0) / total, error[last].sum(axis=0) / total]
        for k, g in enumerate(gradient):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            parameters[k] = parameters[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*parameters)
