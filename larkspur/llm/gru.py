"""A gated recurrent unit with a class-factored softmax, in numpy."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Hidden units; words in a class and classes, so SIDE * SIDE words in all.
HIDDEN, SIDE = 16, 32
SHAPES = {"table": (SIDE * SIDE, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, SIDE), "bc": (SIDE,), "ww": (SIDE, HIDDEN, SIDE), "bw": (SIDE, SIDE)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

Weights = dict[str, np.ndarray]


def unflatten(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(share: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights (flat float32) that begin as the words' own shares: share is that of each of the SIDE * SIDE words."""
    rng = np.random.default_rng(seed)
    flat = rng.normal(0, 0.1, SIZE).astype(np.float32)
    w = unflatten(flat)
    p = (share + 1e-9).reshape(SIDE, SIDE)
    w["bc"][:] = np.log(p.sum(axis=1) / p.sum())
    w["bw"][:] = np.log(p / p.sum(axis=1, keepdims=True))
    w["wc"][:] *= 0.3
    w["ww"][:] *= 0.3
    return flat


@dataclass
class Lanes:
    """Documents laid end to end in lanes of about equal length, the longest lane first; x is time by lane."""

    x: np.ndarray  # the word before
    y: np.ndarray  # the word, -1 beyond a lane's end
    first: np.ndarray  # whether a document begins here
    doc: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, at: np.ndarray, end: int, most: int) -> Lanes:
        """codes: words of all documents, document k in at[k] to at[k + 1]; an end is added to each."""
        size = np.diff(at) + 1
        order = np.argsort(-size, kind="stable")
        n = max(1, min(most, len(size)))
        heap = [(0, k) for k in range(n)]
        start, lane = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for d in order.tolist():
            used, k = heapq.heappop(heap)
            start[d], lane[d] = used, k
            heapq.heappush(heap, (used + int(size[d]), k))
        length = np.zeros(n, np.int64)
        for used, k in heap:
            length[k] = used
        rank = np.empty(n, np.int64)
        rank[np.argsort(-length, kind="stable")] = np.arange(n)
        steps = int(length.max(initial=0))
        x, y = np.full((steps, n), end, np.int16), np.full((steps, n), -1, np.int16)
        first, doc = np.zeros((steps, n), bool), np.zeros((steps, n), np.int32)
        d = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(d)) - np.repeat(np.cumsum(size) - size, size)
        t, k = start[d] + place, rank[lane[d]]
        word = np.full(len(d), end, np.int16)
        word[place < size[d] - 1] = codes
        y[t, k] = word
        doc[t, k] = d
        begins = place == 0
        first[t[begins], k[begins]] = True
        x[t[~begins], k[~begins]] = word[np.flatnonzero(~begins) - 1]
        return cls(x, y, first, doc)

    def windows(self, steps: int):
        """(x, y, first, doc) of so many steps, only of lanes that still go on."""
        for t in range(0, len(self.x), steps):
            b = int((self.y[t] >= 0).sum())
            yield tuple(a[t : t + steps, :b] for a in (self.x, self.y, self.first, self.doc))


def forward(w: Weights, x: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each step of a window, from the states before it; a document's first step starts from zero."""
    inputs = w["table"][x]
    states = np.empty((*x.shape, HIDDEN), np.float32)
    tape = []
    starts = first.any(axis=1)
    for t in range(len(x)):
        if starts[t]:
            h = np.where(first[t][:, None], np.float32(0), h)
        a = h @ w["u"]
        g = inputs[t]
        zr = np.tanh((g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        if keep:
            tape.append((h, z, r, n, a[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        states[t] = h
    return states, tape


ONES = np.ones(SIDE, np.float32)


def _picked(z: np.ndarray, pick: np.ndarray, softmax: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The log softmax of one entry of each row of z, and, with softmax, the loss's gradient for all of them (in z)."""
    np.clip(z, -60, 60, out=z)  # so that no sum overflows
    at = np.arange(len(z))
    own = z[at, pick]
    e = np.exp(z, out=z) if softmax else np.exp(z)
    total = e @ ONES
    if softmax:
        e /= total[:, None]
        e[at, pick] -= 1
    return own - np.log(total), e if softmax else None


def log_likelihood(w: Weights, states: np.ndarray, y: np.ndarray, grad: Weights | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of the probability of each word after its state; with grad, adds the loss's and returns the states'."""
    c = y // SIDE
    order = np.argsort(c, kind="stable")
    states, c, o = states[order], c[order], (y % SIDE)[order]
    cuts = np.searchsorted(c, np.arange(SIDE + 1)).tolist()
    lp, d = _picked(states @ w["wc"] + w["bc"], c, grad is not None)
    back = None
    if grad is not None:
        grad["wc"] += states.T @ d
        grad["bc"] += d.sum(axis=0)
        back = d @ w["wc"].T
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            continue
        s = states[a:b]
        lw, d = _picked(s @ w["ww"][k] + w["bw"][k], o[a:b], grad is not None)
        lp[a:b] += lw
        if grad is not None:
            grad["ww"][k] += s.T @ d
            grad["bw"][k] += d.sum(axis=0)
            back[a:b] += d @ w["ww"][k].T
    out = np.empty_like(lp)
    out[order] = lp
    if back is not None:
        own = np.empty_like(back)
        own[order] = back
        back = own
    return out, back


def backward(w: Weights, x: np.ndarray, first: np.ndarray, tape: list, d_states: np.ndarray, grad: Weights) -> None:
    """Adds the gradients of a window's steps; nothing goes back beyond the window or a document's first word."""
    d_in = np.empty((*x.shape, 3 * HIDDEN), np.float32)
    dh = np.zeros_like(d_states[0])
    da, back, starts = np.empty_like(d_in[0]), np.ascontiguousarray(w["u"].T), first.any(axis=1)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, a = tape[t]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        d = d_in[t]
        d[:, :HIDDEN], d[:, HIDDEN : 2 * HIDDEN], d[:, 2 * HIDDEN :] = dz, dr, dn
        da[:, : 2 * HIDDEN] = d[:, : 2 * HIDDEN]
        np.multiply(dn, r, out=da[:, 2 * HIDDEN :])
        grad["u"] += h.T @ da
        dh = dh * z + da @ back
        if starts[t]:
            dh = np.where(first[t][:, None], np.float32(0), dh)
    flat, words = d_in.reshape(-1, 3 * HIDDEN), x.ravel()
    order = np.argsort(words, kind="stable")
    names, starts = np.unique(words[order], return_index=True)
    grad["table"][names] += np.add.reduceat(flat[order], starts, axis=0)


@dataclass
class Adam:
    flat: np.ndarray
    rate: float = 0.01

    def __post_init__(self):
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def step(self, g: np.ndarray) -> None:
        norm = float(np.sqrt((g * g).sum()))
        if norm > 1:
            g = g / np.float32(norm)
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        self.flat -= np.float32(self.rate) * (self.m / np.float32(1 - 0.9**self.t)) / (np.sqrt(self.v / np.float32(1 - 0.99**self.t)) + np.float32(1e-6))


def train(flat: np.ndarray, adam: Adam, lanes: Lanes, steps: int = 32) -> int:
    """One pass by truncated backpropagation, an update a window; the states go on from window to window. Words seen."""
    w, seen = unflatten(flat), 0
    h = np.zeros((lanes.x.shape[1] if lanes.x.size else 0, HIDDEN), np.float32)
    for x, y, first, _ in lanes.windows(steps):
        g = np.zeros(SIZE, np.float32)
        grad = unflatten(g)
        states, tape = forward(w, x, first, h[: x.shape[1]], keep=True)
        valid = y >= 0
        n = int(valid.sum())
        if n == y.size:
            d = log_likelihood(w, states.reshape(n, HIDDEN), y.ravel(), grad)[1].reshape(states.shape)
        else:
            d = np.zeros_like(states)
            _, d[valid] = log_likelihood(w, states[valid], y[valid], grad)
        backward(w, x, first, tape, d, grad)
        adam.step(g / np.float32(n))
        h = states[-1]
        seen += n
    return seen


def score(w: Weights, lanes: Lanes, n_docs: int, steps: int = 64) -> np.ndarray:
    """Natural log of the probability of each whole document, its end included."""
    out = np.zeros(n_docs)
    h = np.zeros((lanes.x.shape[1] if lanes.x.size else 0, HIDDEN), np.float32)
    for x, y, first, doc in lanes.windows(steps):
        states, _ = forward(w, x, first, h[: x.shape[1]], keep=False)
        valid = y >= 0
        if valid.all():
            lp, _ = log_likelihood(w, states.reshape(-1, HIDDEN), y.ravel())
            out += np.bincount(doc.ravel(), lp, n_docs)
        else:
            lp, _ = log_likelihood(w, states[valid], y[valid])
            out += np.bincount(doc[valid], lp, n_docs)
        h = states[-1]
    return out
