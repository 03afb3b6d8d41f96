"""A small network with two heads on image batches: digit logits and a direction (sine, cosine).

Each block is twice a 3 x 3 convolution, batch normalisation and rectification, then the maximum of 2 x 2 pixels; the mean over the
pixels goes to both heads. Convolutions are matrix products of all 3 x 3 neighbourhoods. Images are (n, size, size, channels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SIZE, CHANNELS, CLASSES = 64, (32, 64, 128), 9
EPS, MOMENTUM = 1e-5, 0.1
Weights = dict[str, np.ndarray]


def initial(seed: int, channels: tuple[int, ...] = CHANNELS, classes: int = CLASSES) -> Weights:
    """Weights drawn by their fan-in; mean and var are the running statistics, no parameters."""
    rng, before, w = np.random.default_rng(seed), 3, {}
    for b, c in enumerate(channels):
        for k in range(2):
            name = f"{b}{k}"
            w[f"conv{name}"] = (rng.normal(size=(9 * before, c)) * np.sqrt(2 / (9 * before))).astype(np.float32)
            w |= {f"gain{name}": np.ones(c, np.float32), f"shift{name}": np.zeros(c, np.float32), f"mean{name}": np.zeros(c, np.float32), f"var{name}": np.ones(c, np.float32)}
            before = c
    for head, n in (("digit", classes), ("turn", 2)):
        w[head] = (rng.normal(size=(before, n)) / np.sqrt(before)).astype(np.float32)
        w[f"{head}_shift"] = np.zeros(n, np.float32)
    return w


def learnt(w: Weights) -> list[str]:
    return [n for n in w if not n.startswith(("mean", "var"))]


def blocks(w: Weights) -> int:
    return sum(n.startswith("conv") for n in w) // 2


def neighbourhoods(x: np.ndarray) -> np.ndarray:
    """(n * h * w, 9 * c): the 3 x 3 pixels around each, zeros outside."""
    n, h, w, c = x.shape
    p = np.zeros((n, h + 2, w + 2, c), x.dtype)
    p[:, 1:-1, 1:-1] = x
    return np.concatenate([p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=3).reshape(-1, 9 * c)


def spread(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Adds the gradients of neighbourhoods up to those of the pixels."""
    n, h, w, c = shape
    g, p = g.reshape(n, h, w, 9, c), np.zeros((n, h + 2, w + 2, c), g.dtype)
    for k in range(9):
        p[:, k // 3 : k // 3 + h, k % 3 : k % 3 + w] += g[..., k, :]
    return p[:, 1:-1, 1:-1]


def forward(w: Weights, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Logits, unit directions, and what backward() needs. In training, batches are normalised by their own statistics."""
    kept = []
    for b in range(blocks(w)):
        for k in range(2):
            name, shape = f"{b}{k}", x.shape
            cols = neighbourhoods(x)
            z = cols @ w[f"conv{name}"]
            mean, var = (z.mean(0), z.var(0)) if train else (w[f"mean{name}"], w[f"var{name}"])
            root = np.sqrt(var + EPS)
            z -= mean
            z /= root
            y = z * w[f"gain{name}"] + w[f"shift{name}"]
            on = y > 0
            x = (y * on).reshape(*shape[:3], -1)
            if train:
                kept.append((name, shape, cols, z, root, on, mean, var))
        n, h, v, c = x.shape
        cells = x.reshape(n, h // 2, 2, v // 2, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, h // 2, v // 2, c, 4)
        top = cells.argmax(-1)
        x = np.take_along_axis(cells, top[..., None], -1)[..., 0]
        if train:
            kept.append((top, (n, h, v, c)))
    feat = x.mean((1, 2))
    logits, turn = feat @ w["digit"] + w["digit_shift"], feat @ w["turn"] + w["turn_shift"]
    norm = np.maximum(np.sqrt((turn * turn).sum(1, keepdims=True)), 1e-8)
    if train:
        kept.append((feat, x.shape, norm))
    return logits, turn / norm, kept


def backward(w: Weights, turn: np.ndarray, kept: list, g_logits: np.ndarray, g_turn: np.ndarray) -> Weights:
    """Gradients of what is learnt, and the batch's statistics under mean and var."""
    feat, shape, norm = kept[-1]
    g_raw = (g_turn - turn * (g_turn * turn).sum(1, keepdims=True)) / norm
    out = {"digit": feat.T @ g_logits, "digit_shift": g_logits.sum(0), "turn": feat.T @ g_raw, "turn_shift": g_raw.sum(0)}
    g = g_logits @ w["digit"].T + g_raw @ w["turn"].T
    g = np.broadcast_to((g / (shape[1] * shape[2]))[:, None, None], shape)
    for entry in kept[-2::-1]:
        if len(entry) == 2:
            top, (n, h, v, c) = entry
            cells = np.zeros((*top.shape, 4), g.dtype)
            np.put_along_axis(cells, top[..., None], g[..., None], -1)
            g = cells.reshape(n, h // 2, v // 2, c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, h, v, c)
            continue
        name, shape, cols, z, root, on, mean, var = entry
        g = g.reshape(z.shape) * on
        out[f"gain{name}"], out[f"shift{name}"] = (g * z).sum(0), g.sum(0)
        g = g * w[f"gain{name}"]
        g = (g - g.mean(0) - z * (g * z).mean(0)) / root
        out |= {f"conv{name}": cols.T @ g, f"mean{name}": mean, f"var{name}": var}
        g = spread(g @ w[f"conv{name}"].T, shape) if name != "00" else g
    return out


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Batch:
    """Images of bytes with their digits, directions (sine, cosine) and whether these count."""

    x: np.ndarray
    digit: np.ndarray
    turn: np.ndarray
    valid: np.ndarray

    def take(self, on) -> Batch:
        return Batch(self.x[on], self.digit[on], self.turn[on], self.valid[on])


def step(w: Weights, b: Batch, class_weight: np.ndarray, tone: np.ndarray | None = None, turn_weight: float = 1.0) -> tuple[Weights, float, float]:
    """Gradients of a batch, its loss of digits (cross entropy by class weight) and of directions (mean square where they count)."""
    x = b.x.astype(np.float32) / 255
    if tone is not None:
        x = np.clip(x * tone[:, None, None, None], 0, 1)
    logits, turn, kept = forward(w, x, True)
    p, own = probabilities(logits), class_weight[b.digit]
    own = own / own.sum()
    digit_loss = float(-(own * np.log(np.maximum(p[np.arange(len(p)), b.digit], 1e-30))).sum())
    g = p * own[:, None]
    g[np.arange(len(p)), b.digit] -= own
    many = max(1, int(b.valid.sum()))
    off = (turn - b.turn) * b.valid[:, None]
    turn_loss = float((off * off).sum() / many)
    return backward(w, turn, kept, g.astype(np.float32), (2 * turn_weight / many * off).astype(np.float32)), digit_loss, turn_loss


def classify(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digit, its probability and the angle in degrees (0 to 360) of images of bytes."""
    logits, turn, _ = forward(w, x.astype(np.float32) / 255)
    p = probabilities(logits)
    digit = p.argmax(1)
    return digit, p[np.arange(len(p)), digit], np.degrees(np.arctan2(turn[:, 0], turn[:, 1])) % 360
