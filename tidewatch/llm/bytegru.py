"""A bidirectional gated recurrent network over bytes, in numpy.

Windows of bytes are rows, sorted by length in descending order, so that the windows that
reach a position are the first ones. The input weights are one row per byte value. These
helpers run inside tasks; Spark deals out the training shards and the documents.
"""

from __future__ import annotations

import numpy as np

PARTS = ("in_f", "re_f", "bias_f", "in_b", "re_b", "bias_b", "out", "out_bias")


def initial(hidden: int, labels: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"in_{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        p[f"re_{d}"] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden))
        p[f"bias_{d}"] = np.zeros(3 * hidden)
    p["out"] = rng.normal(0, hidden ** -0.5, (2 * hidden, labels))
    p["out_bias"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in p.items()}


def windows_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, length, text number) of the windows of whole texts, longest first."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    counts = -(-lengths // size)
    doc = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(size, lengths[doc] - nth * size)
    start = (np.cumsum(lengths) - lengths)[doc] + nth * size
    order = np.argsort(-length, kind="stable")
    raw = np.frombuffer(b"".join(texts) + b"\0" * size, np.uint8)
    return raw[start[order, None] + np.arange(size)], length[order], doc[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _active(length: np.ndarray, size: int) -> np.ndarray:
    """Windows that reach each position."""
    return np.searchsorted(-length, -np.arange(size), side="left")


def run_direction(p: dict, d: str, data: np.ndarray, active: np.ndarray, keep: list | None = None):
    """Hidden states of one direction, [position, window, unit]; `keep` gets what learning needs."""
    size, n, h = data.shape[1], len(data), p[f"re_{d}"].shape[0]
    table, re = p[f"in_{d}"] + p[f"bias_{d}"], p[f"re_{d}"]
    states = np.zeros((size, n, h), np.float32)
    state = np.zeros((n, h), np.float32)
    for t in (range(size) if d == "f" else range(size - 1, -1, -1)):
        m = active[t]
        if not m:
            continue
        old = state[:m]
        x = table.take(data[:m, t], axis=0)
        g = old @ re
        gates = _sigmoid(x[:, :2 * h] + g[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = r * g[:, 2 * h:]
        new += x[:, 2 * h:]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((t, m, old.copy(), z, r, new, g[:, 2 * h:]))
        step = old - new
        step *= z
        np.add(new, step, out=states[t, :m])
        state[:m] = states[t, :m]
    return states


def position_logits(p: dict, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    h = forward.shape[2]
    return forward @ p["out"][:h] + backward @ p["out"][h:] + p["out_bias"]


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, which is short: it is moved to the front for whole-array steps."""
    x = np.ascontiguousarray(np.moveaxis(x, -1, 0))
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return np.moveaxis(x, 0, -1)


def label_positions(p: dict, data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Probabilities of the labels at every position of every window, [position, window, label]."""
    active = _active(length, data.shape[1])
    return softmax(position_logits(p, run_direction(p, "f", data, active),
                                   run_direction(p, "b", data, active)))


def gradient(p: dict, data: np.ndarray, length: np.ndarray, label: np.ndarray):
    """(mean loss over positions, gradient) by backpropagation through time."""
    size, n = data.shape[1], len(data)
    active = _active(length, size)
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: run_direction(p, d, data, active, kept[d]) for d in "fb"}
    prob = softmax(position_logits(p, states["f"], states["b"]))
    inside = (np.arange(size)[:, None] < length).astype(np.float32)
    total = float(inside.sum())
    own = np.take_along_axis(prob, np.broadcast_to(label[None, :, None], (size, n, 1)), 2)[..., 0]
    loss = float(-(np.log(own + 1e-12) * inside).sum() / total)
    err = np.ascontiguousarray(prob)
    np.put_along_axis(err, np.broadcast_to(label[None, :, None], (size, n, 1)),
                      (own - 1)[..., None], 2)
    err *= inside[..., None] / total
    h = states["f"].shape[2]
    flat = err.reshape(size * n, -1)
    out = np.concatenate([states[d].reshape(size * n, h).T @ flat for d in "fb"])
    grad = {"out": out, "out_bias": flat.sum(axis=0)}
    for d, rows in (("f", slice(0, h)), ("b", slice(h, None))):
        from_out = err @ p["out"][rows].T
        re = p[f"re_{d}"]
        g_in, g_re = np.zeros_like(p[f"in_{d}"]), np.zeros_like(re)
        carry = np.zeros((n, h), np.float32)
        for t, m, old, z, r, new, inner in reversed(kept[d]):
            dh = carry[:m] + from_out[t, :m]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (old - new) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            gx = np.concatenate([dz, dr, dn], axis=1)
            gh = np.concatenate([dz, dr, dn * r], axis=1)
            g_re += old.T @ gh
            order = np.argsort(data[:m, t], kind="stable")
            byte = data[:m, t][order]
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            g_in[byte[first]] += np.add.reduceat(gx[order], first, axis=0)
            carry[:m] = dh * z + gh @ re.T
        grad |= {f"in_{d}": g_in, f"re_{d}": g_re, f"bias_{d}": g_in.sum(axis=0)}
    return loss, grad


def adam(p: dict, data: np.ndarray, length: np.ndarray, label: np.ndarray, batch: int,
         rate: float, seed: int, clip: float = 1.0) -> float:
    """One pass over the windows in random batches, changing p in place; the mean loss."""
    order = np.random.default_rng(seed).permutation(len(data))
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    losses = []
    for step, at in enumerate(range(0, len(order), batch), 1):
        rows = order[at:at + batch]
        rows = rows[np.argsort(-length[rows], kind="stable")]
        loss, grad = gradient(p, data[rows], length[rows], label[rows])
        losses.append(loss)
        scale = min(1.0, clip / (sum(float((g * g).sum()) for g in grad.values()) ** 0.5 + 1e-12))
        for k, g in grad.items():
            g = g * scale
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= (rate * first[k] / (1 - 0.9 ** step)
                     / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return float(np.mean(losses)) if losses else 0.0
