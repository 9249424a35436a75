"""Recurrent layers in numpy, trained by backpropagation through time. Arrays are (batch, time, units).

Their nonlinearity is x / (1 + |x|), from -1 to 1, and for gates half of it and a half: an absolute value and a division
cost a fraction of what tanh does, and the layers have to read every character of a corpus.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, for outputs."""
    return 0.5 * (1 + np.tanh(0.5 * x))


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * squash(x)


def _squash_slope(y: np.ndarray) -> np.ndarray:
    """The slope of ``squash`` where its value is ``y``."""
    return (1 - np.abs(y)) ** 2


def _gate_slope(y: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * y - 1)) ** 2


class Adam:
    """Adam steps over a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def lstm_params(rng: np.random.Generator, name: str, inputs: int, units: int) -> dict[str, np.ndarray]:
    bias = np.zeros(4 * units, np.float32)
    bias[units : 2 * units] = 3  # remember at first
    return {
        f"{name}.w": (rng.standard_normal((inputs, 4 * units)) / np.sqrt(inputs)).astype(np.float32),
        f"{name}.u": (rng.standard_normal((units, 4 * units)) / np.sqrt(units)).astype(np.float32),
        f"{name}.b": bias,
    }


def lstm(p: dict, name: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: dict | None = None) -> np.ndarray:
    """Outputs of an LSTM; where ``mask`` is 0 the state passes on unchanged. ``keep`` collects what training needs.

    ``state`` holds the state to begin with, if any, and then the one at the end.
    """
    u, n = p[f"{name}.u"], p[f"{name}.u"].shape[0]
    pre = x @ p[f"{name}.w"] + p[f"{name}.b"]
    h, c = state["h"] if state else np.zeros((len(x), n), np.float32), state["c"] if state else np.zeros((len(x), n), np.float32)
    out = np.empty((*x.shape[:2], n), np.float32)
    for t in range(x.shape[1]):
        z = pre[:, t] + h @ u
        s = gate(z[:, : 3 * n])
        i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], squash(z[:, 3 * n :])
        m = mask[:, t, None]
        nc = f * c + i * g
        tc = squash(nc)
        nh = o * tc
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc, m))
        h, c = m * nh + (1 - m) * h, m * nc + (1 - m) * c
        out[:, t] = h
    if state is not None:
        state.update(h=h, c=c)
    return out


def lstm_back(p: dict, name: str, x: np.ndarray, keep: list, dout: np.ndarray, grads: dict) -> np.ndarray:
    """Adds the layer's gradients to ``grads`` and returns the gradient of ``x``."""
    w, u = p[f"{name}.w"], p[f"{name}.u"]
    n = u.shape[0]
    dz = np.empty((*x.shape[:2], 4 * n), np.float32)
    du, dh, dc = np.zeros_like(u), np.zeros((len(x), n), np.float32), np.zeros((len(x), n), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        h, c, i, f, o, g, tc, m = keep[t]
        dh = dh + dout[:, t]
        dnh, dnc = dh * m, dc * m
        dnc = dnc + dnh * o * _squash_slope(tc)
        d = dz[:, t]
        d[:, :n] = dnc * g * _gate_slope(i)
        d[:, n : 2 * n] = dnc * c * _gate_slope(f)
        d[:, 2 * n : 3 * n] = dnh * tc * _gate_slope(o)
        d[:, 3 * n :] = dnc * i * _squash_slope(g)
        du += h.T @ d
        dh = d @ u.T + dh * (1 - m)
        dc = dnc * f + dc * (1 - m)
    flat = dz.reshape(-1, 4 * n)
    grads[f"{name}.w"] = x.reshape(-1, x.shape[2]).T @ flat
    grads[f"{name}.u"] = du
    grads[f"{name}.b"] = flat.sum(0)
    return dz @ w.T


def gru_params(rng: np.random.Generator, name: str, inputs: int, units: int) -> dict[str, np.ndarray]:
    return {
        f"{name}.w": (rng.standard_normal((inputs, 3 * units)) / np.sqrt(inputs)).astype(np.float32),
        f"{name}.u": (rng.standard_normal((units, 3 * units)) / np.sqrt(units)).astype(np.float32),
        f"{name}.b": np.zeros(3 * units, np.float32),
    }


def gru(p: dict, name: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Outputs of a gated recurrent unit; where ``mask`` is 0 the state passes on unchanged."""
    u, n = p[f"{name}.u"], p[f"{name}.u"].shape[0]
    pre = x @ p[f"{name}.w"] + p[f"{name}.b"]
    h = np.zeros((len(x), n), np.float32)
    out = np.empty((*x.shape[:2], n), np.float32)
    for t in range(x.shape[1]):
        r_z = gate(pre[:, t, : 2 * n] + h @ u[:, : 2 * n])
        r, z = r_z[:, :n], r_z[:, n:]
        rh = h @ u[:, 2 * n :]
        g = squash(pre[:, t, 2 * n :] + r * rh)
        m = mask[:, t, None]
        if keep is not None:
            keep.append((h, r, z, g, rh, m))
        h = h + m * (1 - z) * (g - h)
        out[:, t] = h
    return out


def gru_back(p: dict, name: str, x: np.ndarray, keep: list, dout: np.ndarray, grads: dict) -> np.ndarray:
    """Adds the layer's gradients to ``grads`` and returns the gradient of ``x``."""
    w, u = p[f"{name}.w"], p[f"{name}.u"]
    n = u.shape[0]
    dz_all, du, dh = np.empty((*x.shape[:2], 3 * n), np.float32), np.zeros_like(u), np.zeros((len(x), n), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        h, r, z, g, rh, m = keep[t]
        dh = dh + dout[:, t]
        dg = dh * m * (1 - z) * _squash_slope(g)
        dz = -dh * m * (g - h) * _gate_slope(z)
        dr = dg * rh * _gate_slope(r)
        d = dz_all[:, t]
        d[:, :n], d[:, n : 2 * n], d[:, 2 * n :] = dr, dz, dg
        gates, cand = d[:, : 2 * n], dg * r
        du[:, : 2 * n] += h.T @ gates
        du[:, 2 * n :] += h.T @ cand
        dh = dh * (1 - m * (1 - z)) + gates @ u[:, : 2 * n].T + cand @ u[:, 2 * n :].T
    flat = dz_all.reshape(-1, 3 * n)
    grads[f"{name}.w"] = x.reshape(-1, x.shape[2]).T @ flat
    grads[f"{name}.u"] = du
    grads[f"{name}.b"] = flat.sum(0)
    return dz_all @ w.T


def both_ways(layer, p: dict, name: str, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
    """A layer read forwards and one read backwards, side by side. Padding (mask 0) may only stand at the end."""
    a, b = keep if keep is not None else (None, None)
    fore = layer(p, f"{name}.f", x, mask, a)
    back = layer(p, f"{name}.r", x[:, ::-1], mask[:, ::-1], b)[:, ::-1]
    return np.concatenate([fore, back], 2)


def both_ways_back(layer_back, p: dict, name: str, x: np.ndarray, keep: tuple[list, list], dout: np.ndarray, grads: dict) -> np.ndarray:
    n = dout.shape[2] // 2
    dx = layer_back(p, f"{name}.f", x, keep[0], dout[:, :, :n], grads)
    return dx + layer_back(p, f"{name}.r", x[:, ::-1], keep[1], dout[:, ::-1, n:], grads)[:, ::-1]


# --- reading ------------------------------------------------------------------------------------------------------------
# The same layers without what training needs, for sequences of codes that begin at the first step. Arrays are (time,
# units, batch), so that each operation runs over long rows; what a code adds to a gate is looked up in a table.


def lstm_read(p: dict, name: str, embed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Outputs of the layer for ``codes`` (time, batch)."""
    u = p[f"{name}.u"]
    n, (steps, batch) = u.shape[0], codes.shape
    table, back = np.ascontiguousarray((embed @ p[f"{name}.w"] + p[f"{name}.b"]).T), np.ascontiguousarray(u.T)
    out, z, y = np.empty((steps, n, batch), np.float32), np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32)
    c, h = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
    for t in range(steps):
        np.take(table, codes[t], axis=1, out=z, mode="clip")
        np.matmul(back, h, out=y)
        z += y
        np.abs(z, out=y)
        y += 1
        z /= y
        z[: 3 * n] += 1  # gates are half of this
        c *= z[n : 2 * n]
        np.multiply(z[:n], z[3 * n :], out=y[:n])
        c += y[:n]
        c *= 0.5
        h = out[t]
        np.abs(c, out=y[:n])
        y[:n] += 1
        np.divide(c, y[:n], out=h)
        h *= z[2 * n : 3 * n]
        h *= 0.5
    return out


def gru_read(p: dict, name: str, embed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Outputs of the layer for ``codes`` (time, batch)."""
    u = p[f"{name}.u"]
    n, (steps, batch) = u.shape[0], codes.shape
    table, back = np.ascontiguousarray((embed @ p[f"{name}.w"] + p[f"{name}.b"]).T), np.ascontiguousarray(u.T)
    out, z, y = np.empty((steps, n, batch), np.float32), np.empty((3 * n, batch), np.float32), np.empty((3 * n, batch), np.float32)
    a, h = np.empty((2 * n, batch), np.float32), np.zeros((n, batch), np.float32)
    for t in range(steps):
        np.take(table, codes[t], axis=1, out=z, mode="clip")
        np.matmul(back, h, out=y)
        g, rest = z[: 2 * n], z[2 * n :]
        g += y[: 2 * n]
        np.abs(g, out=a)
        a += 1
        g /= a
        g += 1
        g *= 0.5
        y[2 * n :] *= g[:n]
        rest += y[2 * n :]
        np.abs(rest, out=a[:n])
        a[:n] += 1
        rest /= a[:n]
        np.subtract(h, rest, out=a[:n])
        a[:n] *= g[n:]
        h = out[t]
        np.add(rest, a[:n], out=h)
    return out


def read_both_ways(layer_read, p: dict, name: str, embed: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs forwards and backwards; sequence ``b`` has ``sizes[b]`` steps, what stands after them is no matter."""
    fore = layer_read(p, f"{name}.f", embed, codes)
    if (sizes == len(codes)).all():
        return fore, layer_read(p, f"{name}.r", embed, codes[::-1])[::-1]
    turned = np.maximum(sizes[None] - 1 - np.arange(len(codes))[:, None], 0)
    back = layer_read(p, f"{name}.r", embed, np.take_along_axis(codes, turned, 0))
    return fore, np.take_along_axis(back, turned[:, None], 0)


def windows(sizes: np.ndarray, window: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, begin, end)`` of windows that cover texts of these sizes, in order; no window leaves its text.

    Neighbours overlap by ``overlap`` or more, and a window answers for its text's places ``begin`` to ``end``, which it has
    in its middle, so that each place is one window's.
    """
    step = window - overlap
    n = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - window) // step)), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(k * step, np.maximum(0, sizes[text] - window))
    first, last = k == 0, k == n[text] - 1
    begin = np.where(first, 0, 0)
    inner = np.flatnonzero(~first)
    begin[inner] = (start[inner] + np.minimum(start[inner - 1] + window, sizes[text[inner]])) // 2
    end = np.empty_like(begin)
    end[:-1] = begin[1:]
    end[last] = sizes[text[last]]
    return text, start, begin, end
