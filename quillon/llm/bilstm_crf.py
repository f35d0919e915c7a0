"""A small character tagger in numpy: embeddings, a bidirectional LSTM and a CRF over its emissions."""

from __future__ import annotations

import numpy as np

#: Codes of characters: 0 pads; printable ASCII; then white space, other letters, the rest.
N_CODES = 99
HIDDEN, EMBED = 16, 12


def encode(text: str) -> np.ndarray:
    """uint8 codes of a text's code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(points), 98, dtype=np.uint8)
    ascii_ = (points >= 32) & (points < 127)
    out[ascii_] = points[ascii_] - 31
    out[(points >= 9) & (points <= 13)] = 96
    out[(points >= 0xC0) & (points < 0x2000)] = 97
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    def __init__(self, labels: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        k = len(labels)
        self.labels = labels
        draw = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p: dict[str, np.ndarray] = {"embed": draw(N_CODES, EMBED), "out": draw(2 * HIDDEN, k), "out_b": np.zeros(k, np.float32), "step": np.zeros((k, k), np.float32), "first": np.zeros(k, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": draw(EMBED, 4 * HIDDEN), f"h{way}": draw(HIDDEN, 4 * HIDDEN), f"b{way}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1
        # A label that continues a span follows only the same span's labels.
        kind = [x[2:] for x in labels]
        self.allowed = np.array([[not b.startswith("I") or kind[i] == kind[j] for j, b in enumerate(labels)] for i in range(k)])
        self.start_allowed = np.array([not x.startswith("I") for x in labels])

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.allowed, self.p["step"], np.float32(-1e4)), np.where(self.start_allowed, self.p["first"], np.float32(-1e4))

    def _run(self, x: np.ndarray, real: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; x is (time, batch, embed), already in that direction's order. Where ``real`` is 0 lies
        padding, which leaves the state empty: what a window gives does not depend on those beside it."""
        t, b, _ = x.shape
        pre = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        w = self.p[f"h{way}"]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        hs, kept = np.empty((t, b, HIDDEN), np.float32), []
        for i in range(t):
            z = pre[i] + h @ w
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            n, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before_c, before_h = c, h
            c = f * c + n * g
            c = c * real[i]
            tc = np.tanh(c)
            h = o * tc * real[i]
            hs[i] = h
            if keep:
                kept.append((n, f, o, g, tc, before_c, before_h))
        return hs, kept

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(batch, time, labels) scores of windows of codes (batch, time), code 0 padding their ends."""
        return self._forward(codes, False)[0]

    def _forward(self, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        x, real = self.p["embed"][codes.T], (codes.T != 0)[:, :, None].astype(np.float32)
        hf, kf = self._run(x, real, "f", keep)
        hb, kb = self._run(x[::-1], real[::-1], "b", keep)
        both = np.concatenate([hf, hb[::-1]], axis=2)
        return (both @ self.p["out"] + self.p["out_b"]).transpose(1, 0, 2), (x, both, kf, kb, real)

    def gradient(self, codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tag sequences and its gradient."""
        e, (x, both, kf, kb, real) = self._forward(codes, True)
        b, t, k = e.shape
        step, first = self.transitions()
        mask = np.arange(t)[None, :] < lengths[:, None]
        alpha, beta = np.empty((t, b, k), np.float32), np.zeros((t, b, k), np.float32)
        alpha[0] = first + e[:, 0]
        for i in range(1, t):
            a = _log_sum(alpha[i - 1][:, :, None] + step, 1) + e[:, i]
            alpha[i] = np.where(mask[:, i, None], a, alpha[i - 1])
        total = _log_sum(alpha[-1], 1)
        d_step = np.zeros((k, k), np.float32)
        for i in range(t - 2, -1, -1):
            ahead = step + (e[:, i + 1] + beta[i + 1])[:, None, :]
            beta[i] = np.where(mask[:, i + 1, None], _log_sum(ahead, 2), beta[i + 1])
            pair = np.exp(np.minimum(alpha[i][:, :, None] + ahead - total[:, None, None], 0)) * mask[:, i + 1, None, None]
            d_step += pair.sum(axis=0)
        d_e = (np.exp(np.minimum(alpha + beta - total[:, None], 0)) * mask.T[:, :, None]).transpose(1, 0, 2)
        d_first = d_e[:, 0].sum(axis=0)
        rows, cols = np.nonzero(mask)
        d_e[rows, cols, tags[rows, cols]] -= 1
        score = (e[rows, cols, tags[rows, cols]]).sum() + first[tags[:, 0]].sum()
        follow = mask[:, 1:]
        r, c = np.nonzero(follow)
        np.subtract.at(d_step, (tags[r, c], tags[r, c + 1]), 1)
        np.subtract.at(d_first, tags[:, 0], 1)
        score += step[tags[r, c], tags[r, c + 1]].sum()
        grad = {"step": np.where(self.allowed, d_step, 0) / b, "first": np.where(self.start_allowed, d_first, 0) / b}
        d_out = (d_e.transpose(1, 0, 2) / b).astype(np.float32)
        grad["out"] = both.reshape(-1, 2 * HIDDEN).T @ d_out.reshape(-1, k)
        grad["out_b"] = d_out.sum(axis=(0, 1))
        d_both = d_out @ self.p["out"].T
        d_x = self._back(d_both[:, :, :HIDDEN], kf, x, real, "f", grad) + self._back(d_both[::-1, :, HIDDEN:], kb, x[::-1], real[::-1], "b", grad)[::-1]
        grad["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grad["embed"], codes.T.ravel(), d_x.reshape(-1, EMBED))
        return float((total.sum() - score) / b), grad

    def _back(self, d_h: np.ndarray, kept: list, x: np.ndarray, real: np.ndarray, way: str, grad: dict[str, np.ndarray]) -> np.ndarray:
        t, b, _ = d_h.shape
        w = self.p[f"h{way}"]
        d_z = np.empty((t, b, 4 * HIDDEN), np.float32)
        dh_next, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        d_w = np.zeros_like(w)
        for i in range(t - 1, -1, -1):
            n, f, o, g, tc, before_c, before_h = kept[i]
            dh = (d_h[i] + dh_next) * real[i]
            dc = (dc + dh * o * (1 - tc * tc)) * real[i]
            d_z[i, :, :HIDDEN] = dc * g * n * (1 - n)
            d_z[i, :, HIDDEN : 2 * HIDDEN] = dc * before_c * f * (1 - f)
            d_z[i, :, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
            d_z[i, :, 3 * HIDDEN :] = dc * n * (1 - g * g)
            d_w += before_h.T @ d_z[i]
            dh_next = d_z[i] @ w.T
            dc = dc * f
        grad[f"h{way}"] = d_w
        grad[f"x{way}"] = x.reshape(-1, EMBED).T @ d_z.reshape(-1, 4 * HIDDEN)
        grad[f"b{way}"] = d_z.sum(axis=(0, 1))
        return d_z @ self.p[f"x{way}"].T

    def fit(self, codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {x: np.zeros_like(v) for x, v in self.p.items()}
        v2 = {x: np.zeros_like(v) for x, v in self.p.items()}
        losses, t = [], 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(codes)), 0.0
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                loss, grad = self.gradient(codes[rows], tags[rows], lengths[rows])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                scale, t = min(1.0, 5 / max(norm, 1e-9)), t + 1
                now = rate * (0.3 if epoch >= epochs - 2 else 1)
                for x, g in grad.items():
                    g = g * scale
                    m[x] = 0.9 * m[x] + 0.1 * g
                    v2[x] = 0.999 * v2[x] + 0.001 * g * g
                    self.p[x] = (self.p[x] - now * (m[x] / (1 - 0.9**t)) / (np.sqrt(v2[x] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                total += loss * len(rows)
            losses.append(total / len(order))
        return losses

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Best tags of sequences of emissions (batch, time, labels), by Viterbi over each whole sequence."""
        b, t, k = e.shape
        step, first = self.transitions()
        best, back = first + e[:, 0], np.zeros((t, b, k), np.uint8)
        for i in range(1, t):
            paths = best[:, :, None] + step
            back[i] = paths.argmax(axis=1)
            best = np.where((i < lengths)[:, None], paths.max(axis=1) + e[:, i], best)
        out = []
        for r, n in enumerate(lengths.tolist()):
            tags = np.empty(n, np.uint8)
            tags[-1] = best[r].argmax()
            for i in range(n - 1, 0, -1):
                tags[i - 1] = back[i, r, tags[i]]
            out.append(tags)
        return out
