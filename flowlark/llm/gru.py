"""A bidirectional gated recurrent network over words, with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH, HIDDEN = 16, 8
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 13
TABLES = ("word", "char")

Parameters = dict[str, np.ndarray]


def fresh(seed: int = 11) -> Parameters:
    draw = np.random.default_rng(seed).standard_normal
    p = {"word": 0.1 * draw((WORD_ROWS, WIDTH)), "char": 0.1 * draw((CHAR_ROWS, WIDTH)), "v": 0.1 * draw(2 * HIDDEN), "w": draw(2 * HIDDEN) / 4, "c": np.zeros(1)}
    for side in "fb":
        p |= {f"X{side}": draw((WIDTH, 3 * HIDDEN)) / 4, f"H{side}": draw((HIDDEN, 3 * HIDDEN)) / 3, f"B{side}": np.zeros(3 * HIDDEN)}
    return {k: x.astype(np.float32) for k, x in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def swept(x: np.ndarray, h_weights: np.ndarray, there: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """States after each word, in the order of the words; x: what each word gives to the gates."""
    windows, length = there.shape
    h, states, kept = np.zeros((windows, HIDDEN), np.float32), np.zeros((windows, length, HIDDEN), np.float32), []
    for t in range(length - 1, -1, -1) if back else range(length):
        u = h @ h_weights
        gates = sigmoid(x[:, t, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, t, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        kept.append((t, h, r, z, n, u[:, 2 * HIDDEN :]))
        h = np.where(there[:, t, None], n + z * (h - n), h)
        states[:, t] = h
    return states, kept


def pooled(p: Parameters, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logit of each window, its attention weights and pooled state; a window without words pools to 0."""
    e = np.where(there, states @ p["v"], np.float32(-1e9))
    a = np.exp(e - e.max(axis=1, keepdims=True)) * there
    a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
    pool = (a[:, None, :] @ states)[:, 0]
    return pool @ p["w"] + p["c"][0], a, pool


def logits(p: Parameters, gates: np.ndarray, words: np.ndarray, there: np.ndarray) -> np.ndarray:
    """gates: for each different word what it gives to the gates of both sides; words: rows of it."""
    x = gates[words]
    f, _ = swept(x[:, :, : 3 * HIDDEN], p["Hf"], there, False)
    b, _ = swept(x[:, :, 3 * HIDDEN :], p["Hb"], there, True)
    return pooled(p, np.concatenate([f, b], axis=2), there)[0]


def word_gates(p: Parameters, vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors @ p["Xf"] + p["Bf"], vectors @ p["Xb"] + p["Bb"]], axis=1)


def gradients(p: Parameters, vectors: np.ndarray, words: np.ndarray, there: np.ndarray, label: np.ndarray) -> tuple[float, Parameters, np.ndarray]:
    """Mean loss of the windows, gradients of all but the tables, and those of the word vectors."""
    count, length = words.shape
    v = vectors[words]
    gates, swept_, g = word_gates(p, vectors), {}, {}
    for side, part, back in (("f", slice(0, 3 * HIDDEN), False), ("b", slice(3 * HIDDEN, None), True)):
        swept_[side] = swept(gates[words][:, :, part], p[f"H{side}"], there, back)
    states = np.concatenate([swept_["f"][0], swept_["b"][0]], axis=2)
    logit, a, pool = pooled(p, states, there)
    share = sigmoid(logit)
    loss = -float(np.mean(label * np.log(share + 1e-12) + (1 - label) * np.log(1 - share + 1e-12)))
    d = ((share - label) / count).astype(np.float32)
    g["c"], g["w"] = np.array([d.sum()], np.float32), d @ pool
    dpool = d[:, None] * p["w"]
    da = (states @ dpool[:, :, None])[:, :, 0]
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("bt,bth->h", de, states)
    dstates = a[:, :, None] * dpool[:, None, :] + de[:, :, None] * p["v"]
    dv = np.zeros_like(v)
    for side, at in (("f", 0), ("b", HIDDEN)):
        h_weights, x_weights = p[f"H{side}"], p[f"X{side}"]
        dh, gh, gx, gb = np.zeros((count, HIDDEN), np.float32), np.zeros_like(h_weights), np.zeros_like(x_weights), np.zeros(3 * HIDDEN, np.float32)
        for t, h, r, z, n, un in reversed(swept_[side][1]):
            total = dh + dstates[:, t, at : at + HIDDEN]
            on = there[:, t, None]
            now = np.where(on, total, 0)
            dn = now * (1 - z) * (1 - n * n)
            dz = now * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dr, dz, dn * r], axis=1)
            dx = np.concatenate([dr, dz, dn], axis=1)
            gh += h.T @ du
            gx += v[:, t].T @ dx
            gb += dx.sum(axis=0)
            dv[:, t] += dx @ x_weights.T
            dh = np.where(on, now * z + du @ h_weights.T, total)
        g |= {f"H{side}": gh, f"X{side}": gx, f"B{side}": gb}
    dvectors = np.zeros_like(vectors)
    np.add.at(dvectors, words[there], dv[there])
    return loss, g, dvectors
