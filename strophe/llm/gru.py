"""A gated recurrent language model in numpy.

Tokens are numbered by frequency rank.  The output is factored: a softmax over
classes of neighbouring ranks, then one over the words of the class.  Training
is backpropagation through time, truncated to windows, with the state carried
from window to window and reset where a text begins; scoring carries the state
through whole texts.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) with the sums of its rows, and what was taken from each row; in
    place."""
    top = np.zeros(1, z.dtype)
    if z.size and z.max() > 50:
        top = z.max(axis=1)
        z -= top[:, None]
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype), top


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of each row of z, at one place of it; z is lost."""
    picked = z[np.arange(len(z)), at]
    total, top = _exp(z)
    return picked - top - np.log(total)


def _softmax_error(z: np.ndarray, at: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Softmax of each row of z less one at one place of it, times ``scale``;
    in place."""
    total, _ = _exp(z)
    z *= (scale / total)[:, None]
    z[np.arange(len(z)), at] -= scale
    return z


def _with_ones(s: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.empty((len(s), s.shape[1] + 1), s.dtype) if out is None else out
    out[:, :-1] = s
    out[:, -1] = 1
    return out


def _kept(room: dict, name: str, *shape: int) -> np.ndarray:
    """An array of ``room`` with any values.  Memory that is new for each window
    would have to be cleared by the machine each time."""
    if name not in room or room[name].shape != shape:
        room[name] = np.empty(shape, np.float32)
    return room[name]


#: Products of more steps are left to several threads by the usual libraries.
SMALL = 1 << 18
#: Rows of outputs that are made at once, so that they stay in a core's cache.
ROWS = 1 << 10


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in blocks of rows.  A task has one core, so threads would only
    take time from other tasks."""
    n, k = a.shape
    rows = max(1, SMALL // (k * b.shape[1]))
    if n <= rows:
        return a @ b
    out = np.empty((n, b.shape[1]), a.dtype)
    full = n // rows * rows
    np.matmul(a[:full].reshape(-1, rows, k), b, out=out[:full].reshape(-1, rows, b.shape[1]))
    out[full:] = a[full:] @ b
    return out


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, likewise."""
    rows = max(1, SMALL // (a.shape[1] * b.shape[1]))
    full = len(a) // rows * rows
    out = a[full:].T @ b[full:]
    if full:
        out += np.matmul(a[:full].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:full].reshape(-1, rows, b.shape[1])).sum(axis=0)
    return out


class Gru:
    """Gates come first in all arrays of theirs (update, reset, new), so that
    each gate's values lie together; the output layers' products are with rows
    that end in a one, for the biases."""

    def __init__(self, classes: int = 32, per_class: int = 64, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes, self.per_class, self.hidden = classes, per_class, hidden
        v, f = classes * per_class, np.float32

        def gates(x: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray(x.reshape(-1, 3, hidden).swapaxes(0, 1), f)

        self.x = gates(rng.normal(0, 0.1, (v + 1, 3 * hidden)))  # the last row begins a text
        self.u = gates(rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)))
        self.b = np.zeros((3, 1, hidden), f)
        self.wc, self.bc = rng.normal(0, 0.1, (hidden, classes)).astype(f), np.zeros(classes, f)
        self.ww, self.bw = rng.normal(0, 0.1, (classes, hidden, per_class)).astype(f), np.zeros((classes, per_class), f)

    @property
    def begin(self) -> int:
        return self.classes * self.per_class

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.wc, self.bc, self.ww, self.bw]

    def begin_as(self, weight: np.ndarray) -> None:
        """Set the output biases to the shares of ``weight`` (of the first
        tokens; the others get next to nothing)."""
        full = np.full(self.begin, 1e-3)
        full[: len(weight)] = np.maximum(weight, 1e-3)
        full = (full / full.sum()).reshape(self.classes, self.per_class)
        self.bc[...] = np.log(full.sum(axis=1))
        self.bw[...] = np.log(full / full.sum(axis=1, keepdims=True))

    def step(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        gates = self.x.take(ids, axis=1) + self.b
        after, new = self._step(h, gates)
        return after, (gates, new)

    def _step(self, h: np.ndarray, gates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after h, and what the reset gate was applied to; ``gates``
        are what inputs give to gates, and become the gates."""
        hu = h @ self.u
        zr, n = gates[:2], gates[2]
        zr += hu[:2]
        _sigmoid(zr)
        n += zr[1] * hu[2]
        np.tanh(n, out=n)
        after = h - n
        after *= zr[0]
        after += n
        return after, hu[2]

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of words, with biases as the last row."""
        return np.concatenate([self.wc, self.bc[None]]), np.concatenate([self.ww, self.bw[:, None]], axis=1)

    def log_prob(self, s: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of targets after states s."""
        wc, ww = self._outputs()
        c, w = target // self.per_class, target % self.per_class
        s = _with_ones(s)
        out = np.empty(len(s), s.dtype)
        for a in range(0, len(s), ROWS):
            out[a : a + ROWS] = _log_softmax_at(_times(s[a : a + ROWS], wc), c[a : a + ROWS])
        order, parts = self._by_class(c)
        s, w, inner = s.take(order, axis=0), w[order], np.empty(len(s), s.dtype)
        for k, a, b in parts:
            inner[a:b] = _log_softmax_at(_times(s[a:b], ww[k]), w[a:b])
        out[order] += inner
        return out

    def _by_class(self, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order by class, and the classes that occur with their ranges, in
        parts of at most ``ROWS``."""
        order = np.argsort(c.astype(np.uint16), kind="stable")
        stop = np.cumsum(np.bincount(c, minlength=self.classes)).tolist()
        return order, [(k, i, min(i + ROWS, b)) for k, (a, b) in enumerate(zip([0, *stop], stop)) for i in range(a, b, ROWS)]

    def score(self, texts: list[np.ndarray], window: int = 64, group: int = 1024) -> np.ndarray:
        """Natural log probability of whole texts (token numbers)."""
        total = np.zeros(len(texts))
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        x = self.x + self.b
        for g in range(0, len(order), group):
            own = order[g : g + group]
            length = size[own]
            flat = np.concatenate([texts[i] for i in own])
            first = np.cumsum(length) - length
            h = np.zeros((len(own), self.hidden), np.float32)
            last = np.full(len(own), self.begin, flat.dtype)
            for t in range(0, int(length[0]), window):
                steps = np.arange(t, min(t + window, int(length[0])))
                now = np.searchsorted(-length, -steps, side="left")  # texts longer than each step
                ends = np.cumsum(now)
                rows = np.arange(ends[-1]) - np.repeat(ends - now, now)
                targets = flat[first[rows] + np.repeat(steps, now)]
                # inputs are the targets of the step before
                inputs = np.concatenate([last[: now[0]], targets[rows[now[0] :] + np.repeat((ends - now)[:-1], now[1:])]])
                gates, states = x.take(inputs, axis=1), np.empty((len(rows), self.hidden), np.float32)
                for a, b in zip((ends - now).tolist(), ends.tolist(), strict=True):
                    h, _ = self._step(h[: b - a], gates[:, a:b])
                    states[a:b] = h
                last = targets[len(targets) - len(h) :]
                total[own[: now[0]]] += np.bincount(rows, self.log_prob(states, targets), now[0])
        return total

    def fit(self, texts: list[np.ndarray], streams: int = 32, window: int = 32, epochs: int = 2, rate: float = 0.01, adam: dict | None = None) -> None:
        """Adam over windows of ``streams`` parallel runs of texts; ``adam``
        keeps its moments from one call to the next."""
        if not texts:
            return
        flat = np.concatenate(texts)
        opens = np.zeros(len(flat), bool)
        opens[np.cumsum([0, *(len(t) for t in texts[:-1])])] = True
        streams = max(1, min(streams, len(flat) // window))
        # the last run is filled up with unlearned places
        n = -(-len(flat) // streams)
        real = np.arange(n * streams).reshape(streams, n) < len(flat)
        flat, opens = np.resize(flat, n * streams).reshape(streams, n), np.resize(opens, n * streams).reshape(streams, n)
        adam, room = {} if adam is None else adam, {}
        if not adam:
            adam.update(first=[np.zeros_like(p) for p in self.params()], second=[np.zeros_like(p) for p in self.params()], count=0)
        for _ in range(epochs):
            h = np.zeros((streams, self.hidden), np.float32)
            for t in range(0, n, window):
                width = min(window, n - t)
                grads, h = self._window(h, flat[:, max(0, t - 1) : t + width], opens[:, t : t + width], t > 0, real[:, t : t + width], room)
                adam["count"] += 1
                count = adam["count"]
                norm = float(np.sqrt(sum(np.vdot(g, g) for g in grads)))
                for p, m, v, g in zip(self.params(), adam["first"], adam["second"], grads, strict=True):
                    g *= 0.1 * min(1.0, 5 / (norm + 1e-9))
                    m *= 0.9
                    m += g
                    g *= g
                    v *= 0.99
                    v += g
                    np.divide(v, 1 - 0.99**count, out=g)
                    np.sqrt(g, out=g)
                    g += 1e-8
                    np.divide(m, g, out=g)
                    g *= rate / (1 - 0.9**count)
                    p -= g

    def _window(self, h, ids, opens, carried, real=None, room=None):
        k, room = self.hidden, {} if room is None else room
        width, streams = opens.shape[1], len(h)
        target = ids[:, 1:] if carried else ids
        source = ids[:, :-1] if carried else np.concatenate([np.full((streams, 1), self.begin), ids[:, :-1]], axis=1)
        inputs = np.where(opens, self.begin, source).T
        fresh = opens.any(axis=0)
        seen, steps = inputs.ravel(), (width, streams, k)
        gates = np.take(self.x + self.b, seen, axis=1, out=_kept(room, "gates", 3, len(seen), k), mode="clip").reshape(3, *steps)
        before, new, states = (_kept(room, name, *steps) for name in ("before", "new", "states"))
        for j in range(width):
            if fresh[j]:
                h = np.where(opens[:, j : j + 1], np.float32(0), h)
            before[j] = h
            h, new[j] = self._step(h, gates[:, j])
            states[j] = h
        y = target.T.ravel()
        learned = np.ones(len(y), bool) if real is None else real.T.ravel()
        scale = (learned / np.float32(max(1, learned.sum()))).astype(np.float32)
        c, w = y // self.per_class, y % self.per_class
        s = _with_ones(states.reshape(-1, k), _kept(room, "ones", len(y), k + 1))
        wc, ww = self._outputs()
        order, parts = self._by_class(c)
        place = np.empty(len(y), np.int64)
        place[order] = np.arange(len(y))
        own, w, by = np.take(s, order, axis=0, out=_kept(room, "sorted", *s.shape), mode="clip"), w[order], scale[order]
        inner, gwc, gww = _kept(room, "inner", len(y), k), np.zeros_like(wc), np.zeros_like(ww)
        for q, a, b in parts:
            p = _softmax_error(_times(own[a:b], ww[q]), w[a:b], by[a:b])
            inner[a:b] = _times(p, self.ww[q].T)
            gww[q] += _inner(own[a:b], p)
        gs = np.take(inner, place, axis=0, out=_kept(room, "gs", len(y), k), mode="clip")
        for a in range(0, len(s), ROWS):
            at = slice(a, a + ROWS)
            p = _softmax_error(_times(s[at], wc), c[at], scale[at])
            gs[at] += _times(p, self.wc.T)
            gwc += _inner(s[at], p)
        gs, back, u = gs.reshape(steps), np.zeros((streams, k), np.float32), self.u.swapaxes(1, 2)
        gin, to_reset = _kept(room, "gin", 3, *steps), _kept(room, "reset", *steps)
        for j in range(width - 1, -1, -1):
            z, r, n = gates[:, j]
            g = gs[j]
            g += back
            gz, gr, gn = gin[:, j]
            back = g * z
            rest = g - back  # g * (1 - z)
            np.multiply(before[j] - n, rest, out=gz)
            gz *= z
            np.multiply(n, n, out=gn)
            np.subtract(1, gn, out=gn)
            gn *= rest
            np.multiply(gn, r, out=to_reset[j])
            np.multiply(new[j], to_reset[j], out=gr)
            gr *= 1 - r
            back += gz @ u[0]
            back += gr @ u[1]
            back += to_reset[j] @ u[2]
            if fresh[j]:
                back = np.where(opens[:, j : j + 1], np.float32(0), back)
        before, gin, to_reset = before.reshape(-1, k), gin.reshape(3, -1, k), to_reset.reshape(-1, k)
        gu = np.stack([_inner(before, g) for g in (gin[0], gin[1], to_reset)])
        order = np.argsort(seen.astype(np.uint16 if self.x.shape[1] <= 65536 else np.int64), kind="stable")
        seen = seen[order]
        first = np.flatnonzero(np.diff(seen, prepend=-1))
        gx = np.zeros_like(self.x)
        for g, own in zip(gx, gin, strict=True):
            g[seen[first]] = np.add.reduceat(np.take(own, order, axis=0, out=inner, mode="clip"), first, axis=0)
        return [gx, gu, gx.sum(axis=1, keepdims=True), gwc[:-1], gwc[-1], gww[:, :-1], gww[:, -1]], h
