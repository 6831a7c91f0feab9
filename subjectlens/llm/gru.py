"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried over windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Units; steps of a training window; lanes trained, and scored, at once.
HIDDEN, STEPS, LANES, SCORE_LANES, SCORE_STEPS = 24, 16, 512, 512, 16
RATE = 0.01


class Layout:
    """Symbols: words 0 .. words-1 by falling frequency in classes of equal size, then the end symbol, then groups of rarer
    words. Each of these further symbols is a class of its own."""

    def __init__(self, words: int, groups: int, per_class: int = 32):
        self.words, self.groups, self.per_class = words, groups, per_class
        self.end = words
        self.word_classes = -(-words // per_class)
        self.symbols = words + 1 + groups
        self.classes = self.word_classes + 1 + groups
        self.class_of = np.r_[np.arange(words) // per_class, self.word_classes + np.arange(1 + groups)].astype(np.int64)


def shapes(layout: Layout) -> dict[str, tuple[int, ...]]:
    h, rows = HIDDEN, layout.word_classes * layout.per_class
    return {"P": (layout.symbols, 3 * h), "U": (h, 3 * h), "bn": (h,), "Wc": (h, layout.classes), "bc": (layout.classes,), "Ww": (rows, h), "bw": (rows,)}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()]).astype(np.float32)


def unpack(flat: np.ndarray, layout: Layout) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(layout).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def initial(layout: Layout, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Small random weights; biases make the untrained model the unigram model of the counts by symbol."""
    rng, p = np.random.default_rng(seed), {}
    for name, shape in shapes(layout).items():
        p[name] = (rng.standard_normal(shape) * 0.1).astype(np.float32)
    c = np.log(counts + 0.5)
    p["bc"][:] = np.log(np.bincount(layout.class_of, counts, layout.classes) + 0.5)
    p["bc"] -= p["bc"].max()
    p["bn"][:] = 0
    p["bw"][:] = -1e4
    p["bw"][: layout.words] = c[: layout.words]
    by_class = p["bw"].reshape(-1, layout.per_class) if layout.words else p["bw"]
    if layout.words:
        by_class -= by_class.max(1, keepdims=True)
    p["Wc"] *= 0.1
    p["Ww"] *= 0.1
    return pack(p)


def step(p: dict, h: np.ndarray, x: np.ndarray, fresh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Next state from state h and projected input x, zero where fresh; what backpropagation needs is added to keep."""
    n = HIDDEN
    u = h @ p["U"]
    g = x[:, : 2 * n] + u[:, : 2 * n]  # the sigmoid of g is (1 + tanh(g / 2)) / 2
    g *= 0.5
    np.tanh(g, out=g)
    g += 1
    g *= 0.5
    z, r = g[:, :n], g[:, n:]
    un = u[:, 2 * n :]
    un += p["bn"]
    c = r * un
    c += x[:, 2 * n :]
    np.tanh(c, out=c)
    out = h - c
    out *= z
    out += c
    out[fresh] = 0
    if keep is not None:
        keep.append((h, z, r, un, c))
    return out


def _softmax(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log-probability of each row's own column; x becomes the probabilities.

    One shift for all rows is enough unless a row lies far below the others; then each row has its own.
    """
    x -= x.max()
    mine, ones = x[np.arange(len(x)), own], np.ones(x.shape[1], np.float32)
    e = np.exp(x)
    total = e @ ones
    if total.min() < 1e-20:
        x -= x.max(1, keepdims=True)
        mine = x[np.arange(len(x)), own]
        e = np.exp(x)
        total = e @ ones
    np.divide(e, total[:, None], out=x)
    return mine - np.log(total)


def output(p: dict, layout: Layout, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """log P(y | h) for each row; with grads, adds the loss's gradients and returns dh too."""
    cls, k, dh = layout.class_of[y], layout.per_class, None
    x = h @ p["Wc"]
    x += p["bc"]
    out = _softmax(x, cls)
    if grads is not None:
        x[np.arange(len(y)), cls] -= 1
        grads["Wc"] += h.T @ x
        grads["bc"] += np.ones(len(x), np.float32) @ x
        dh = x @ p["Wc"].T
    frequent = np.flatnonzero(y < layout.words)
    order = frequent[np.argsort(cls[frequent].astype(np.int16), kind="stable")]
    cuts = np.searchsorted(cls[order], np.arange(layout.word_classes + 1))
    hs, inside, found = h[order], y[order] % k, np.empty(len(order), np.float32)
    back = np.empty_like(hs) if grads is not None else None
    for c in range(layout.word_classes):
        a, b, rows = cuts[c], cuts[c + 1], slice(c * k, (c + 1) * k)
        if a == b:
            continue
        x = hs[a:b] @ p["Ww"][rows].T
        x += p["bw"][rows]
        found[a:b] = _softmax(x, inside[a:b])
        if grads is not None:
            x[np.arange(b - a), inside[a:b]] -= 1
            grads["Ww"][rows] += x.T @ hs[a:b]
            grads["bw"][rows] += np.ones(b - a, np.float32) @ x
            np.matmul(x, p["Ww"][rows], out=back[a:b])
    out[order] += found
    if grads is not None:
        dh[order] += back
    return out, dh


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, p: dict, g: dict, share: float = 1.0) -> None:
        """One step; share: how much of a full step it is, for windows of few symbols."""
        self.t += 1
        norm = float(np.sqrt(sum((x**2).sum() for x in g.values())))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        fix = share * self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            x *= scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def train(flat: np.ndarray, layout: Layout, docs: Iterator[np.ndarray], rate: float = RATE) -> tuple[np.ndarray, int]:
    """Trains on all symbols of the documents, each of which ends with the end symbol.

    Every lane takes one document after the other; the state goes on from window to window and begins anew with each
    document. Returns weights and symbols seen.
    """
    p, seen = unpack(flat, layout), 0
    best, docs = Adam(p, rate), iter(docs)
    h, left = np.zeros((LANES, HIDDEN), np.float32), [np.empty(0, np.int32)] * LANES
    x = np.full((STEPS + 1, LANES), -1, np.int32)
    while True:
        x[0], x[1:] = x[-1], -2
        for k in range(len(left)):
            at = 1
            while at <= STEPS:
                if not len(left[k]):
                    if (doc := next(docs, None)) is None:
                        break
                    left[k] = doc
                part, left[k] = left[k][: STEPS + 1 - at], left[k][STEPS + 1 - at :]
                x[at : at + len(part), k] = part
                at += len(part)
        active = (x[1:] >= 0).any(0)  # no document is left for the other lanes
        if not active.all():
            x, h, left = x[:, active], h[active], [part for part, on in zip(left, active, strict=True) if on]
        n, h = _train_window(p, layout, x, h, best) if len(left) else (0, h)
        if not n:
            return pack(p), seen
        seen += n


def _train_window(p: dict, layout: Layout, x: np.ndarray, h: np.ndarray, best: Adam) -> tuple[int, np.ndarray]:
    """x: symbols by step and lane, the one before first; -2 where a lane has no more. h: the lanes' states. Returns symbols seen and states."""
    n, lanes, hidden = len(x) - 1, x.shape[1], HIDDEN
    states, kept = np.empty((n, lanes, hidden), np.float32), []
    before = x[:-1]
    fresh = (before < 0) | (before == layout.end)
    given = np.where(before < 0, 0, before)
    for t in range(n):
        states[t] = h = step(p, h, p["P"][given[t]], fresh[t], kept)
    y = x[1:].ravel()
    real = y >= 0
    m = int(real.sum())
    if not m:
        return 0, h
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dh_all = np.zeros((n * lanes, hidden), np.float32)
    if m == len(y):
        _, dh_all = output(p, layout, states.reshape(-1, hidden), y, g)
    else:
        _, dh_all[real] = output(p, layout, states.reshape(-1, hidden)[real], y[real], g)
    dh_all = dh_all.reshape(n, lanes, hidden)
    carry = np.zeros((lanes, hidden), np.float32)
    du, dc_all = np.empty((n, lanes, 3 * hidden), np.float32), np.empty((n, lanes, hidden), np.float32)
    for t in range(n - 1, -1, -1):
        before_h, z, r, un, c = kept[t]
        dh = dh_all[t] + carry
        dh[fresh[t]] = 0
        less = 1 - z
        part = dh * z
        d, dc = du[t], dc_all[t]
        np.multiply(part * less, before_h - c, out=d[:, :hidden])
        np.multiply(dh * less, 1 - c * c, out=dc)
        rest = dc * r
        d[:, 2 * hidden :] = rest
        np.multiply(rest * un, 1 - r, out=d[:, hidden : 2 * hidden])
        carry = d @ p["U"].T
        carry += part
    flat = du.reshape(-1, 3 * hidden)
    g["U"] += np.concatenate([k[0] for k in kept]).T @ flat
    g["bn"] += flat[:, 2 * hidden :].sum(0)
    du[:, :, 2 * hidden :] = dc_all
    who = np.where(before < 0, -1, before).ravel().astype(np.int16)
    order = np.argsort(who, kind="stable")
    order = order[np.searchsorted(who[order], 0) :]
    if len(order):
        who = who[order]
        heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        g["P"][who[heads]] = np.add.reduceat(flat[order], heads)
    for v in g.values():
        v /= m
    best.update(p, g, min(1.0, 8 * m / (LANES * STEPS)))
    return m, h


def score(p: dict, layout: Layout, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document's symbols (the end symbol last), the state carried from start to end.

    Documents are laid end to end on lanes of about equal length; each begins with the zero state.
    """
    out = np.zeros(len(docs))
    if not docs:
        return out
    size = np.array([len(d) for d in docs])
    lanes = max(1, min(SCORE_LANES, len(docs)))
    order = np.argsort(-size, kind="stable")
    load, queue = [0] * lanes, [[] for _ in range(lanes)]
    import heapq

    heap = [(0, k) for k in range(lanes)]
    for i in order.tolist():
        n, k = heapq.heappop(heap)
        queue[k].append(i)
        load[k] = n + int(size[i])
        heapq.heappush(heap, (load[k], k))
    by = np.argsort(-np.array(load), kind="stable")
    queue, length = [queue[k] for k in by], np.array([load[k] for k in by])
    x = np.full((int(length.max()), lanes), -1, np.int32)
    owner = np.zeros((int(length.max()), lanes), np.int32)
    for k, q in enumerate(queue):
        if q:
            x[: length[k], k] = np.concatenate([docs[i] for i in q])
            owner[: length[k], k] = np.repeat(q, size[q])
    h, before = np.zeros((lanes, HIDDEN), np.float32), np.full(lanes, layout.end, np.int32)
    for s in range(0, len(x), SCORE_STEPS):
        e = min(s + SCORE_STEPS, len(x))
        lanes = int(np.searchsorted(-length, -s, side="left"))
        h, before = h[:lanes], before[:lanes]
        states = np.empty((e - s, lanes, HIDDEN), np.float32)
        for t in range(s, e):
            states[t - s] = h = step(p, h, p["P"][before], before == layout.end)
            before = np.maximum(x[t, :lanes], 0)
        y, who = x[s:e, :lanes].ravel(), owner[s:e, :lanes].ravel()
        real = y >= 0
        states = states.reshape(-1, HIDDEN)
        if not real.all():
            states, y, who = states[real], y[real], who[real]
        lp, _ = output(p, layout, states, y)
        out += np.bincount(who, lp.astype(np.float64), len(docs))
    return out
