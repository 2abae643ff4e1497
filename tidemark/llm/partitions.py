"""Learned partitions: a neighbour graph cut into balanced parts, and a small classifier that routes vectors to parts. Numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 30


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each unit vector, by cosine."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _second(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """About the second eigenvector of the normalised adjacency of the edges a-b, by power iteration."""
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
    scale, first = 1 / np.sqrt(degree), np.sqrt(degree / degree.sum())
    x = rng.standard_normal(n)
    for _ in range(60):
        x -= first * (first @ x)
        y = x * scale
        x = x + scale * (np.bincount(a, y[b], n) + np.bincount(b, y[a], n) + y)  # shifted, so that the largest comes first
        x /= np.linalg.norm(x)
    return x * scale


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A part of each node; sizes differ by one at most. Recursive spectral bisection at the median, then exchanges that cut fewer edges."""
    n, rng = len(graph), np.random.default_rng(seed)
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, k = todo.pop()
        if k == 1:
            part[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[src] >= 0) & (place[dst] >= 0)
        value = _second(place[src[inside]], place[dst[inside]], len(nodes), rng)
        order = nodes[np.argsort(value, kind="stable")]
        half = len(nodes) * (k // 2) // k
        todo += [(order[:half], first, k // 2), (order[half:], first + k // 2, k - k // 2)]
    return _exchange(src, dst, part, parts)


def _exchange(src: np.ndarray, dst: np.ndarray, part: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Exchanges nodes between pairs of parts, most gain first, while both sides gain."""
    n = len(part)
    for _ in range(rounds):
        links = np.zeros((n, parts))
        np.add.at(links, (src, part[dst]), 1)
        np.add.at(links, (dst, part[src]), 1)
        gain = links - links[np.arange(n), part][:, None]
        gain[np.arange(n), part] = -np.inf
        wish, best = gain.argmax(axis=1), gain.max(axis=1)
        moved = 0
        for p in range(parts):
            for q in range(p + 1, parts):
                there = np.flatnonzero((part == p) & (wish == q) & (best > 0))
                back = np.flatnonzero((part == q) & (wish == p) & (best > 0))
                k = min(len(there), len(back))
                there, back = there[np.argsort(-best[there], kind="stable")[:k]], back[np.argsort(-best[back], kind="stable")[:k]]
                part[there], part[back] = q, p
                wish[there] = wish[back] = -1
                moved += k
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer; probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, seed: int = 5) -> Router:
        """target: the share of each part among a row and its neighbours. Adam on small batches."""
        rng = np.random.default_rng(seed)
        p = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, target.shape[1])) * np.sqrt(1 / HIDDEN), np.zeros(target.shape[1])]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at : at + 128]
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                d = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                dh = (d @ p[2].T) * (h > 0)
                step += 1
                for w, g, a, b in zip(p, (x[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)), m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= 3e-3 * (1 - epoch / EPOCHS) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return cls(*p)


def learn(x: np.ndarray, parts: int) -> Router:
    """From a sample of unit vectors: neighbour graph, balanced parts, router."""
    parts = max(1, min(parts, len(x) // 4))
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = nearest(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.reshape(-1)]), 1)
    return Router.fit(x, target / target.sum(axis=1, keepdims=True))
