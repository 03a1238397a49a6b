"""Recursions of a state sequence over many chunks at once.

Chunks differ in length. They are sorted, longest first, so that at step t the chunks that still
have a row are the first ``active[t]`` ones, and one step of all of them is one array operation on
(states, chunks). A slab holds a bounded number of cells; what a batch of chunks costs in Python is
the number of slabs times the longest chunk, not the number of rows.

Inside, rows lie by step and then by chunk, so the rows of a step, and those they come from, are slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS = 1 << 17  # rows with padding in a slab
TINY = 1e-300


def slabs(sizes: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Positions of chunks, longest first, cut so that count times longest stays below ``cells`` (or is one chunk)."""
    order = np.argsort(-sizes, kind="stable")
    while len(order):
        part, order = np.split(order, [max(1, cells // max(int(sizes[order[0]]), 1))])
        yield part


def by_step(sizes: np.ndarray) -> np.ndarray:
    """Rows of chunks (longest first) that lie one after the other, in the order of steps."""
    active = _active(sizes)
    step = np.repeat(np.arange(len(active)), active)
    chunk = np.arange(len(step)) - np.repeat(np.cumsum(active) - active, active)
    return (np.cumsum(sizes) - sizes)[chunk] + step


def _active(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(-sizes, -np.arange(int(sizes.max())), side="left")


class Lockstep:
    """Emissions of a slab of chunks; ``first`` says which chunks begin a sequence.

    ``rows`` are the chunks, or with ``sizes`` one matrix in the order of ``by_step``.
    """

    def __init__(self, model, rows: np.ndarray | list[np.ndarray], first: np.ndarray, sizes: np.ndarray | None = None):
        if sizes is None:
            sizes = np.array([len(c) for c in rows])
            rows = np.concatenate(rows)[by_step(sizes)]
        self.model, self.rows, self.sizes, self.first = model, rows, sizes, np.asarray(first, bool)
        self.active = _active(sizes)
        ends = np.cumsum(self.active)
        self.begins = ends - self.active
        self.step = np.repeat(np.arange(len(self.active)), self.active)
        self.chunk = np.arange(len(self.step)) - np.repeat(self.begins, self.active)
        self.log_b = model.log_emission(self.rows).T
        self.top = self.log_b.max(axis=0)
        self.b = np.exp(self.log_b - self.top)

    def _at(self, t: int, n: int) -> slice:
        """The first ``n`` rows of a step."""
        return slice(self.begins[t], self.begins[t] + n)

    def products(self) -> np.ndarray:
        """Product of each chunk's step matrices, up to a factor: (chunks, states, states)."""
        k = self.model.n_states
        out = np.tile(np.eye(k), (len(self.sizes), 1, 1))
        for t, n in enumerate(self.active):
            moved = out[:n] @ self.model.transition
            if t == 0:
                moved[self.first[:n]] = np.eye(k)
            moved *= self.b[:, self._at(t, n)].T[:, None, :]
            out[:n] = moved / moved.sum(axis=(1, 2), keepdims=True)
        return out

    def best(self) -> np.ndarray:
        """Log score of the best path through each chunk between any two states."""
        k = self.model.n_states
        log_a = np.log(self.model.transition + TINY)
        out = np.tile(np.where(np.eye(k) > 0, 0.0, -np.inf), (len(self.sizes), 1, 1))
        for t, n in enumerate(self.active):
            moved = (out[:n, :, :, None] + log_a).max(axis=2)
            if t == 0:
                moved[self.first[:n]] = out[:n][self.first[:n]]
            out[:n] = moved + self.log_b[:, self._at(t, n)].T[:, None, :]
        return out

    def _messages(self, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors, the messages ahead of the rows, what comes back to them, and the sizes of the messages: (states, rows)."""
        a = self.model.transition
        left, alpha, beta = np.empty_like(self.b), np.empty_like(self.b), np.empty_like(self.b)
        sizes = np.empty(self.b.shape[1])
        for t, n in enumerate(self.active):
            here = self._at(t, n)
            left[:, here] = alpha[:, self._at(t - 1, n)] if t else entry.T
            message = a.T @ left[:, here]
            if t == 0:
                message[:, self.first] = entry.T[:, self.first]
            message *= self.b[:, here]
            sizes[here] = message.sum(axis=0)
            alpha[:, here] = message / sizes[here]
        for t in range(len(self.active) - 1, -1, -1):
            n, more = self.active[t], self.active[t + 1] if t + 1 < len(self.active) else 0
            beta[:, self.begins[t] + more : self.begins[t] + n] = end[more:n].T
            if more:
                after = self._at(t + 1, more)
                back = a @ (self.b[:, after] * beta[:, after])
                beta[:, self._at(t, more)] = back / back.sum(axis=0)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=0)
        return gamma, left, self.b * beta, sizes

    def summed(self, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posteriors by step (states, rows), summed pairs of states, and log-likelihoods of the chunks, between known messages."""
        a = self.model.transition
        gamma, left, right, sizes = self._messages(entry, end)
        # rows that begin a sequence have no pair; those of the first step lie first
        inner = np.flatnonzero(~self.first)
        if len(inner):
            inner = np.concatenate([inner, np.arange(self.active[0], len(self.step))])
            left, right = left[:, inner], right[:, inner]
        else:
            left, right = left[:, self.active[0] :], right[:, self.active[0] :]
        pairs = a * ((left / ((a.T @ left) * right).sum(axis=0)) @ right.T)
        return gamma, pairs, np.bincount(self.chunk, np.log(sizes) + self.top, len(self.sizes))

    def smoothed(self, entry: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``summed`` with the posteriors chunk after chunk: (rows, states)."""
        by_steps, pairs, loglik = self.summed(entry, end)
        gamma = np.empty(by_steps.shape[::-1])
        gamma[by_step(self.sizes)] = by_steps.T
        return gamma, pairs, loglik

    def paths(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Most likely state of each row; ``before`` is the state ahead of a chunk that does not begin a sequence, ``last`` its last state or -1."""
        k = self.model.n_states
        log_a = np.log(self.model.transition + TINY)
        came = np.zeros((len(self.step), k), np.int8 if k < 128 else np.int32)
        score = np.where(self.first[:, None], np.log(self.model.start + TINY), log_a[np.maximum(before, 0)]) + self.log_b[:, self._at(0, len(self.sizes))].T
        for t, n in enumerate(self.active[1:], 1):
            options = score[:n, :, None] + log_a
            came[self._at(t, n)] = options.argmax(axis=1)
            score[:n] = options.max(axis=1) + self.log_b[:, self._at(t, n)].T
        out = np.zeros(len(self.step), np.int64)
        state = np.where(last >= 0, last, score.argmax(axis=1))
        for t in range(len(self.active) - 1, -1, -1):
            here = self._at(t, self.active[t])
            out[here] = state[: self.active[t]]
            state[: self.active[t]] = came[here][np.arange(self.active[t]), state[: self.active[t]]]
        path = np.empty_like(out)
        path[by_step(self.sizes)] = out
        return path
