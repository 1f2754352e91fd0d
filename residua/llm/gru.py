"""A small gated recurrent language model in numpy.

Symbols are the frequent words, one symbol per spelling class of all other
words, and the end mark.  The output is class-factored: first one of
``CLASSES`` classes, then one of the ``MEMBERS`` symbols of that class.
Training uses truncated backpropagation: windows of ``WINDOW`` steps, with
the state carried from window to window.
"""

from __future__ import annotations

import numpy as np

HIDDEN, CLASSES, MEMBERS, WINDOW, STREAMS = 16, 32, 32, 16, 128
SYMBOLS = CLASSES * MEMBERS
SHAPES = {"inp": (SYMBOLS, 3 * HIDDEN), "rec": (HIDDEN, 3 * HIDDEN), "cls": (HIDDEN, CLASSES), "cls_b": (CLASSES,),
          "mem": (CLASSES, HIDDEN, MEMBERS), "mem_b": (CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one parameter vector."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s)
        at += n
    return out


def initial(symbol_counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """Start at the smoothed frequencies of the symbols, with small random weights."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(SIZE) * 0.1).astype(np.float32)
    p = unpack(flat)
    n = symbol_counts.reshape(CLASSES, MEMBERS) + 0.5
    p["cls_b"][:] = np.log(n.sum(axis=1) / n.sum())
    p["mem_b"][:] = np.log(n / n.sum(axis=1, keepdims=True))
    p["cls"][:] *= 0.1
    p["mem"][:] *= 0.1
    return flat


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(x):
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


def _errors(x, y):
    """Log-probability of each row's target, and the softmax less the target; ``x`` is overwritten."""
    at = np.arange(len(y))
    x -= x.max(axis=1, keepdims=True)
    out = x[at, y]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x /= total[:, None]
    x[at, y] -= 1
    return out - np.log(total), x


def _by_class(y: np.ndarray):
    """Rows grouped by the class of their target."""
    c = y // MEMBERS
    o = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[o], np.arange(CLASSES + 1))
    return c, [(k, o[edge[k]:edge[k + 1]]) for k in range(CLASSES) if edge[k] < edge[k + 1]]


def log_probs(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target symbol given the states ``x``."""
    c, groups = _by_class(y)
    out = _log_softmax(x @ p["cls"] + p["cls_b"])[np.arange(len(y)), c]
    for k, rows in groups:
        out[rows] += _log_softmax(x[rows] @ p["mem"][k] + p["mem_b"][k])[np.arange(len(rows)), y[rows] - k * MEMBERS]
    return out


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, keep: np.ndarray, valid: np.ndarray,
             h: np.ndarray):
    """Loss and gradient of one window (time, stream), and the state after it.

    ``keep`` is 0 where a document begins, ``valid`` 0 on padding.
    """
    steps, width = x.shape
    a = p["inp"][x]
    h_in, z, r, q, n, states = np.empty((6, steps, width, HIDDEN), a.dtype)
    for t in range(steps):
        np.multiply(h, keep[t][:, None], out=h_in[t])
        g = h_in[t] @ p["rec"]
        zr = _sigmoid(a[t, :, :2 * HIDDEN] + g[:, :2 * HIDDEN])
        z[t], r[t], q[t] = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN:]
        np.tanh(a[t, :, 2 * HIDDEN:] + r[t] * q[t], out=n[t])
        h = states[t]
        np.subtract(h_in[t], n[t], out=h)
        h *= z[t]
        h += n[t]
    flat, target, weight = states.reshape(-1, HIDDEN), y.reshape(-1), valid.reshape(-1)
    total = max(float(weight.sum()), 1.0)
    c, groups = _by_class(target)
    loss, d = _errors(flat @ p["cls"] + p["cls_b"], c)
    d *= weight[:, None] / total
    grad = np.zeros(SIZE, np.float32)
    gp = unpack(grad)
    gp["cls"][:], gp["cls_b"][:] = flat.T @ d, d.sum(axis=0)
    dx = d @ p["cls"].T
    o = np.concatenate([rows for _, rows in groups])         # by class
    edge = np.cumsum([0, *(len(rows) for _, rows in groups)])
    cuts = [(k, slice(b, e)) for (k, _), b, e in zip(groups, edge[:-1], edge[1:], strict=True)]
    mine, m, logs = flat[o], target[o] - c[o] * MEMBERS, p["mem_b"][c[o]]
    for k, rows in cuts:
        logs[rows] += mine[rows] @ p["mem"][k]
    more, d = _errors(logs, m)
    loss[o] += more
    d *= weight[o][:, None] / total
    back = np.empty_like(mine)
    for k, rows in cuts:
        gp["mem"][k], gp["mem_b"][k] = mine[rows].T @ d[rows], d[rows].sum(axis=0)
        back[rows] = d[rows] @ p["mem"][k].T
    dx[o] += back
    dx = dx.reshape(steps, width, HIDDEN)
    da, dgs = np.empty_like(a), np.empty_like(a)
    dh = np.zeros_like(h)
    by_z, by_n, by_r = (h_in - n) * z * (1 - z), (1 - z) * (1 - n * n), q * r * (1 - r)
    back, z_keep = p["rec"].T, z * keep[:, :, None]
    for t in range(steps - 1, -1, -1):
        dh += dx[t]
        dn = dh * by_n[t]
        dg = dgs[t]
        np.multiply(dh, by_z[t], out=dg[:, :HIDDEN])
        np.multiply(dn, by_r[t], out=dg[:, HIDDEN:2 * HIDDEN])
        np.multiply(dn, r[t], out=dg[:, 2 * HIDDEN:])
        da[t, :, 2 * HIDDEN:] = dn
        if t:
            dh *= z_keep[t]
            dh += (dg @ back) * keep[t][:, None]
    da[:, :, :2 * HIDDEN] = dgs[:, :, :2 * HIDDEN]
    gp["rec"][:] = h_in.reshape(-1, HIDDEN).T @ dgs.reshape(-1, 3 * HIDDEN)
    o = np.argsort(x.reshape(-1), kind="stable")
    symbol = x.reshape(-1)[o]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    gp["inp"][symbol[first]] = np.add.reduceat(da.reshape(-1, 3 * HIDDEN)[o], first, axis=0)
    return -float((loss * weight).sum()) / total, grad, h.copy()


def streams(docs: list[np.ndarray], end: int, width: int = STREAMS):
    """Lay documents in ``width`` streams: inputs, targets, keep, valid of shape (time, stream).

    Streams are even: a document that has no room left in its stream goes on
    in another one.  That costs it its state, at most once a stream; within
    a stream the state is carried over all windows of a document.
    """
    pieces = [(np.concatenate([[end], d]), np.concatenate([d, [end]])) for d in docs]
    room = -(-sum(len(x) for x, _ in pieces) // (width * WINDOW)) * WINDOW
    lanes: list[list] = [[] for _ in range(width)]
    fill = np.zeros(width, np.int64)
    for px, py in sorted(pieces, key=lambda p: -len(p[0])):
        at = 0
        while at < len(px):
            k = int(fill.argmin())
            to = min(len(px), at + room - int(fill[k]))
            lanes[k].append((px[at:to], py[at:to]))
            fill[k] += to - at
            at = to
    steps = -(-int(fill.max()) // WINDOW) * WINDOW
    x, y = np.full((steps, width), end, np.int64), np.full((steps, width), end, np.int64)
    keep, valid = np.zeros((steps, width), np.float32), np.zeros((steps, width), np.float32)
    for k, lane in enumerate(lanes):
        at = 0
        for px, py in lane:
            z = at + len(px)
            x[at:z, k], y[at:z, k], valid[at:z, k], keep[at + 1:z, k] = px, py, 1, 1
            at = z
    return x, y, keep, valid


def train(flat: np.ndarray, docs: list[np.ndarray], end: int, rate: float = 0.03, passes: int = 1,
          moments: list | None = None, width: int = STREAMS) -> tuple[np.ndarray, float]:
    """Adam over the windows of ``docs`` (symbol arrays); the new parameters and the mean loss.

    ``moments``, an empty list at first, carries Adam's moments from call to call.
    """
    flat = flat.astype(np.float32).copy()
    p = unpack(flat)
    x, y, keep, valid = streams(docs, end, width)
    m, v, step = moments or (np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0)
    losses, part = [], np.empty(SIZE, np.float32)
    for _ in range(passes):
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        for a in range(0, len(x), WINDOW):
            w = slice(a, a + WINDOW)
            loss, g, h = gradient(p, x[w], y[w], keep[w], valid[w], h)
            g *= min(1.0, 1.0 / max(float(np.sqrt((g * g).sum())), 1e-9))
            step += 1
            m *= 0.9
            m += np.multiply(g, 0.1, out=part)
            g *= g
            v *= 0.99
            v += np.multiply(g, 0.01, out=part)
            np.multiply(v, 1 / (1 - 0.99 ** step), out=part)
            np.sqrt(part, out=part)
            part += 1e-6
            np.divide(m, part, out=part)
            part *= rate / (1 - 0.9 ** step)
            flat -= part
            losses.append(loss)
    if moments is not None:
        moments[:] = m, v, step
    return flat, float(np.mean(losses)) if losses else 0.0


def score(flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Natural log-probability of each whole document and its end mark.

    ``codes`` holds the symbols of all documents in a row.  Documents are
    walked side by side, longest first; the state is carried over all
    windows, and a window is wider where few documents are left.
    """
    p = unpack(flat)
    n = len(lengths)
    out = np.zeros(n)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order] + 1                                # with the end mark
    h = np.zeros((n, HIDDEN), np.float32)
    cut, t = 2 * HIDDEN, 0
    while n and t < size[0]:
        active = int(np.searchsorted(-size, -t, "left"))     # documents with a step t
        steps = int(min(max(16, 32768 // active), size[0] - t))
        ts = np.arange(t, t + steps)
        alive = np.searchsorted(-size, -ts, "left")
        total = int(alive.sum())
        states = np.empty((total, HIDDEN), np.float32)
        doc = np.arange(total) - np.repeat(np.cumsum(alive) - alive, alive)
        when = np.repeat(ts, alive)
        inner = when < size[doc] - 1
        y = np.full(total, end, np.int64)
        y[inner] = codes[first[doc[inner]] + when[inner]]
        x = np.full(total, end, np.int64)
        later = when > 0
        x[later] = codes[first[doc[later]] + when[later] - 1]
        at = 0
        for k in alive:
            k = int(k)
            a, hk = p["inp"][x[at:at + k]], h[:k]
            g = hk @ p["rec"]
            zr = _sigmoid(a[:, :cut] + g[:, :cut])
            nn = g[:, cut:]
            nn *= zr[:, HIDDEN:]
            nn += a[:, cut:]
            np.tanh(nn, out=nn)
            hk -= nn
            hk *= zr[:, :HIDDEN]
            hk += nn
            states[at:at + k] = hk
            at += k
        np.add.at(out, doc, log_probs(p, states, y)) if total < 1000 else \
            np.add(out, np.bincount(doc, log_probs(p, states, y), minlength=n), out=out)
        t += steps
    result = np.empty(n)
    result[order] = out
    return result
