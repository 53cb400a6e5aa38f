"""A character-level bidirectional LSTM with CRF transitions in numpy: training by backpropagation, decoding by Viterbi.

Batches are [time, batch, ...] arrays with a mask; a masked step carries the state on unchanged. Every character is an
index into the embedding and into a fixed table of features, so a reader projects both to the gates once for each index
and not for each character.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Params = dict[str, np.ndarray]
#: A gate whose exponent is above this is shut: exp(40) is 2e17, and products of two are still finite.
STEEP = 40.0
#: Positions in doubt whose paths are sought together.
DOUBTS = 1 << 19


def init(vocab: int, features: int, tags: int, embed: int = 24, hidden: int = 48, seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)

    def mat(a: int, b: int) -> np.ndarray:
        return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

    p = {"emb": (rng.standard_normal((vocab, embed)) * 0.1).astype(np.float32)}
    for d in "fb":
        p |= {f"wx{d}": mat(embed + features, 4 * hidden), f"wh{d}": mat(hidden, 4 * hidden), f"bias{d}": np.zeros(4 * hidden, np.float32)}
        p[f"bias{d}"][hidden : 2 * hidden] = 1  # forget gates start open
    return p | {"out": mat(2 * hidden, tags), "bout": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, bias: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    t, b, _ = x.shape
    n = wh.shape[0]
    pre = x.reshape(t * b, -1) @ wx + bias
    pre = pre.reshape(t, b, 4 * n)
    h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    out, cache = np.empty((t, b, n), np.float32), []
    for s in range(t):
        z = pre[s] + h @ wh
        gates = _sigmoid(z[:, : 3 * n])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        g = np.tanh(z[:, 3 * n :])
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        m = mask[s][:, None]
        if keep:
            cache.append((h, c, i, f, o, g, tc, m))
        c, h = np.where(m, c2, c), np.where(m, h2, h)
        out[s] = h
    return out, cache


def _lstm_back(dout: np.ndarray, x: np.ndarray, cache: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t, b, n = dout.shape
    dz = np.empty((t, b, 4 * n), np.float32)
    dh, dc, dwh = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32), np.zeros_like(wh)
    for s in range(t - 1, -1, -1):
        h, c, i, f, o, g, tc, m = cache[s]
        dh = dh + dout[s]
        a, k = dh * m, dc * m
        k = k + a * o * (1 - tc * tc)
        z = np.concatenate([k * g * i * (1 - i), k * c * f * (1 - f), a * tc * o * (1 - o), k * i * (1 - g * g)], axis=1)
        dz[s] = z
        dwh += h.T @ z
        dh, dc = np.where(m, z @ wh.T, dh), np.where(m, k * f, dc)
    flat = dz.reshape(t * b, -1)
    return (flat @ wx.T).reshape(x.shape), x.reshape(t * b, -1).T @ flat, dwh, flat.sum(0)


def emissions(p: Params, chars: np.ndarray, feats: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """[time, batch, tags] scores; chars [time, batch], feats [time, batch, features]."""
    x = np.concatenate([p["emb"][chars], feats.astype(np.float32)], axis=2)
    hf, cf = _lstm(x, mask, p["wxf"], p["whf"], p["biasf"], keep)
    hb, cb = _lstm(x[::-1], mask[::-1], p["wxb"], p["whb"], p["biasb"], keep)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ p["out"] + p["bout"], (x, cf, cb, h)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def loss_and_grad(p: Params, static: np.ndarray, chars: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood of the tag sequences under the CRF, and its gradient."""
    e, (x, cf, cb, h) = emissions(p, chars, static[chars], mask, keep=True)
    t, b, k = e.shape
    tr, m = p["trans"], mask[:, :, None]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = p["start"] + e[0]
    for s in range(1, t):
        alpha[s] = np.where(m[s], _lse(alpha[s - 1][:, :, None] + tr, 1) + e[s], alpha[s - 1])
    for s in range(t - 2, -1, -1):
        beta[s] = np.where(m[s + 1], _lse(tr + (e[s + 1] + beta[s + 1])[:, None, :], 2), beta[s + 1])
    z = _lse(alpha[-1], 1)
    rows, times = np.arange(b), np.arange(t)[:, None]
    gold = p["start"][tags[0]] + (e[times, rows, tags] * mask).sum(0) + (tr[tags[:-1], tags[1:]] * mask[1:]).sum(0)
    de = np.exp(alpha + beta - z[:, None]) * m
    de[times, rows, tags] -= mask
    g = {n: np.zeros_like(v) for n, v in p.items()}
    g["start"] = de[0].sum(0)
    for s in range(1, t):
        pair = np.exp(alpha[s - 1][:, :, None] + tr + (e[s] + beta[s])[:, None, :] - z[:, None, None]) * m[s][:, :, None]
        g["trans"] += pair.sum(0)
        np.add.at(g["trans"], (tags[s - 1], tags[s]), -mask[s].astype(np.float32))
    de = (de / b).astype(np.float32)
    g["start"], g["trans"] = g["start"] / b, g["trans"] / b
    flat = de.reshape(t * b, k)
    g["out"], g["bout"] = h.reshape(t * b, -1).T @ flat, flat.sum(0)
    dh = (flat @ p["out"].T).reshape(h.shape)
    n = p["whf"].shape[0]
    dx, g["wxf"], g["whf"], g["biasf"] = _lstm_back(dh[:, :, :n], x, cf, p["wxf"], p["whf"])
    dxb, g["wxb"], g["whb"], g["biasb"] = _lstm_back(dh[::-1, :, n:], x[::-1], cb, p["wxb"], p["whb"])
    dx = dx + dxb[::-1]
    np.add.at(g["emb"], chars, dx[:, :, : p["emb"].shape[1]])
    return float((z - gold).mean()), g


def batches(lengths: np.ndarray, size: int, rng: np.random.Generator | None = None) -> list[np.ndarray]:
    """Index groups of similar length."""
    order = np.argsort(lengths, kind="stable")
    out = [order[i : i + size] for i in range(0, len(order), size)]
    if rng is not None:
        rng.shuffle(out)
    return out


def padded(seqs: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((max(map(len, seqs)), len(seqs), *seqs[0].shape[1:]), seqs[0].dtype)
    for i, s in enumerate(seqs):
        out[: len(s), i] = s
    return out


def train(
    p: Params, static: np.ndarray, chars: list[np.ndarray], tags: list[np.ndarray], epochs: int = 6, size: int = 48, rate: float = 4e-3, seed: int = 5,
    vary: Callable[[np.ndarray, np.ndarray, np.random.Generator], np.ndarray] | None = None, log: Callable[[int, float], None] | None = None,
) -> list[float]:
    """Adam on shuffled batches; p changes in place. vary(chars, tags, rng) may change a batch's characters. Returns the mean loss of each epoch."""
    rng = np.random.default_rng(seed)
    m1, m2, step, losses = {n: np.zeros_like(v) for n, v in p.items()}, {n: np.zeros_like(v) for n, v in p.items()}, 0, []
    lengths = np.array([len(c) for c in chars])
    for epoch in range(epochs):
        total = 0.0
        for own in batches(lengths, size, rng):
            mask = np.arange(lengths[own].max())[:, None] < lengths[own][None, :]
            x, y = padded([chars[i] for i in own]), padded([tags[i] for i in own])
            loss, g = loss_and_grad(p, static, vary(x, y, rng) if vary else x, mask, y)
            total += loss * len(own)
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * 0.5 ** (4 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n in p:
                d = g[n] * min(1, 5 / max(norm, 1e-9))
                m1[n] = 0.9 * m1[n] + 0.1 * d
                m2[n] = 0.999 * m2[n] + 0.001 * d * d
                p[n] -= (lr * m1[n] / (np.sqrt(m2[n]) + 1e-8)).astype(p[n].dtype)
            np.clip(p["trans"], -4, 4, out=p["trans"])  # so that few positions are in doubt, see Reader
        losses.append(total / len(chars))
        if log:
            log(epoch, losses[-1])
    return losses


def _aligned(*shape: int) -> np.ndarray:
    """Zeros that begin at a cache line, so that no vector of a row lies across two."""
    size = int(np.prod(shape))
    raw = np.zeros(size + 16, np.float32)
    skip = -raw.ctypes.data % 64 // 4
    return raw[skip : skip + size].reshape(shape)


class Reader:
    """Whole sequences read by a trained model: emissions of every position, and the exact best path where one is in doubt."""

    def __init__(self, p: Params, static: np.ndarray) -> None:
        n = p["whf"].shape[0]
        self.n, self.p = n, p
        x = np.concatenate([p["emb"], static.astype(np.float32)], axis=1)
        # sigmoid(z) = 1 / (1 + exp(-z)) and tanh(z) = 2 sigmoid(2z) - 1, so one exp serves all four gates, i, f, o and g; a gate is a
        # block of its own, [4, rows, n]. Signs and factors stand in the weights: i's exp comes out halved, a state is kept as its half.
        by = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
        less = np.array([np.log(2), 0, 0, 0], np.float32)[:, None, None]
        self.gate = {d: _aligned(4, len(x), n) for d in "fb"}
        for d, gate in self.gate.items():
            gate[:] = self._blocks(x @ p[f"wx{d}"] + p[f"bias{d}"]) * by - less
        # the product with the states is quicker if the weights lie column by column
        self.back = {d: np.ascontiguousarray((self._blocks(p[f"wh{d}"]) * by * np.float32(2)).transpose(0, 2, 1)).transpose(0, 2, 1) for d in "fb"}
        # no exponent of a gate can be above this, as states lie between -1/2 and 1/2
        self.most = {d: float((self.gate[d].max(axis=1) + np.abs(self.back[d]).sum(axis=1) / 2).max()) for d in "fb"}
        self.tags = {d: w * np.float32(2) for d, w in (("f", p["out"][:n]), ("b", p["out"][n:]))}

    def _blocks(self, w: np.ndarray) -> np.ndarray:
        return w.reshape(len(w), 4, self.n).transpose(1, 0, 2)

    def _run(self, chars: np.ndarray, lengths: np.ndarray, d: str) -> np.ndarray:
        """[time, batch, tags] what a direction adds to the scores; the sequences come in order of length, so those that reach a position are the last ones."""
        t, b = chars.shape
        n, gate, back, tags, steep = self.n, self.gate[d], self.back[d], self.tags[d], self.most[d] > STEEP
        ended = np.searchsorted(lengths, np.arange(t), side="right").tolist()
        c, h, full, spare = _aligned(b, n), _aligned(b, n), _aligned(4 * b * n), _aligned(4 * b * n)
        out, one, k = np.zeros((t, b, tags.shape[1]), np.float32), np.array([0.5, 1, 1, 1], np.float32)[:, None, None], -1
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            if k != ended[s]:
                k = ended[s]
                m = (b - k) * 4 * n
                z, y = full[:m].reshape(4, b - k, n), spare[:m].reshape(4, b - k, n)
                i, f, o, g = z
                own, state = h[k:], c[k:]  # the state is kept as -2c
            gate.take(chars[s, k:], axis=1, out=z, mode="clip")
            np.matmul(own, back, out=y)
            z += y
            if steep:
                np.minimum(z, STEEP, out=z)
            np.exp(z, out=z)
            z += one
            # with 1 + exp in each gate's place (half of it in i's): c / f + (2 - g) / (i g), times -2
            state /= f
            i *= g
            g -= 2
            g /= i
            state += g
            np.exp(state, out=own)
            own += 1
            np.divide(1, own, out=own)  # quicker than reciprocal
            own -= 0.5
            own /= o
            np.matmul(own, tags, out=out[s, k:])
        return out

    def emissions(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[tags, time * batch] of sequences in order of length."""
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0, as it should be
            e = self._run(chars, lengths, "f")
            e += self._run(chars, lengths, "b")
        e = np.ascontiguousarray(e.reshape(-1, e.shape[2]).T)
        e += self.p["bout"][:, None]
        return e

    def spans(self, seqs: list[np.ndarray], size: int = 384) -> list[list[tuple[int, int, int, float]]]:
        """(start, stop, type, score) of the best path of every sequence; the score is what the CRF loses if the span's tags become 0.

        A position that no span with a gain can hold has tag 0 on the best path; the path is sought only through the
        stretches between such positions, which gives the same path.
        """
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in seqs]
        lengths = np.array([len(s) for s in seqs], np.int64)
        held: list[tuple[np.ndarray, ...]] = []
        every = batches(lengths, size)
        for at, own in enumerate(every, 1):
            held.append(self._stretches([seqs[i] for i in own], own))
            if at == len(every) or sum(len(x[0]) for x in held) >= DOUBTS:
                self._paths(held, lengths, out)
                held = []
        return out

    def _stretches(self, seqs: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, ...]:
        """Emissions of the positions in doubt, sequence after sequence, and of every stretch of them its sequence, start and length."""
        n = np.array([len(s) for s in seqs], np.int64)
        e = self.emissions(padded(seqs).astype(np.intp), n)
        t, b = int(n.max()), len(n)
        cells = self._possible(e, t, b, n).T.ravel()  # sequence after sequence
        # none runs on into the next sequence
        begins = cells & ~np.concatenate([[False], cells[:-1]])
        begins[::t] |= cells[::t]
        ends = cells & ~np.concatenate([cells[1:], [False]])
        ends[t - 1 :: t] |= cells[t - 1 :: t]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        cell = np.flatnonzero(cells)
        return np.ascontiguousarray(e[:, (cell % t) * b + cell // t].T), own[first // t], first % t, last - first

    def _paths(self, held: list[tuple[np.ndarray, ...]], lengths: np.ndarray, out: list[list[tuple[int, int, int, float]]]) -> None:
        """The best path through every stretch, and its spans."""
        e, row, base, length = (np.concatenate(x) for x in zip(*held))
        last = np.cumsum(length)
        paths = self._best(e, last - length, last, base == 0, base + length == lengths[row])
        for a, r, k, path in zip((last - length).tolist(), row.tolist(), base.tolist(), paths):
            if path.any():
                for x, y, kind in runs(path):
                    out[r].append((k + x, k + y, kind, self._score(e, path, a, x, y, k, k + y == lengths[r])))

    def _possible(self, e: np.ndarray, t: int, b: int, n: np.ndarray) -> np.ndarray:
        """[time, batch] whether a span that gains anything can lie over a position.

        A span gains at most what its first tag gains over tag 0, what each further one can, whichever tag precedes it, and the way back to
        0. The largest sum over all spans that hold a position is the largest up to it and the largest from it on.
        """
        tr, e = self.p["trans"], e.reshape(-1, t, b)
        base = tr[0, 0]

        def gains(e: np.ndarray, by: np.ndarray) -> np.ndarray:
            return (e[1:] + by[:, None, None]).max(axis=0) - e[0]

        begin, more = gains(e, tr[0, 1:] - base), gains(e, tr[:, 1:].max(axis=0) - base)
        begin[:1] = gains(e[:, :1], self.p["start"][1:] - self.p["start"][0])
        out = np.arange(t)[:, None] >= n[None, :]
        begin[out], more[out] = -1e6, -1e3
        onward, rest = np.zeros((t, b), np.float32), np.empty(b, np.float32)
        for s in range(1, t):
            np.add(begin[s - 1], more[s], out=rest)
            np.maximum(begin[s], rest, out=begin[s])  # now the largest sum up to s
            np.add(onward[t - s], more[t - s], out=rest)
            np.maximum(rest, 0, out=onward[t - s - 1])
        begin += onward
        return (begin + max(0.0, float((tr[1:, 0] - base).max())) > -1e-3) & ~out

    def _score(self, flat: np.ndarray, path: np.ndarray, a: int, x: int, y: int, base: int, ends: bool) -> float:
        tr, tags = self.p["trans"], path[x:y]
        own = flat[a + x : a + y]
        gain = float((own[np.arange(y - x), tags] - own[:, 0]).sum()) + float((tr[tags[:-1], tags[1:]] - tr[0, 0]).sum())
        if base + x == 0:
            gain += float(self.p["start"][tags[0]] - self.p["start"][0])
        else:
            before = path[x - 1] if x else 0
            gain += float(tr[before, tags[0]] - tr[before, 0])
        if ends:
            return gain
        after = path[y] if y < len(path) else 0
        return gain + float(tr[tags[-1], after] - tr[0, after])

    def _best(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> list[np.ndarray]:
        """Viterbi through stretches: from the start scores or from tag 0, to the end or to tag 0."""
        p, out = self.p, [np.zeros(0, np.int64)] * len(first)
        lengths, into = last - first, np.ascontiguousarray(p["trans"].T)
        for own in batches(lengths, 1024):
            n = lengths[own]
            e = flat[np.minimum(first[own][:, None] + np.arange(n.max())[None, :], len(flat) - 1)]
            score = np.where(heads[own][:, None], p["start"], p["trans"][0]) + e[:, 0]
            back = []
            for s in range(1, n.max()):
                both = score[:, None, :] + into  # [batch, to, from]
                best = both.argmax(2)
                new = np.take_along_axis(both, best[:, :, None], 2)[:, :, 0] + e[:, s]
                m = (s < n)[:, None]
                back.append(np.where(m, best, np.arange(e.shape[2])))
                score = np.where(m, new, score)
            tag = (score + np.where(tails[own][:, None], 0, p["trans"][:, 0])).argmax(1)
            path = [tag]
            for ptr in reversed(back):
                tag = ptr[np.arange(len(tag)), tag]
                path.append(tag)
            path = np.stack(path[::-1], axis=1)
            for i, k in enumerate(own.tolist()):
                out[k] = path[i, : n[i]]
        return out


def runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, type index) of a tag sequence; a span may begin with an inner tag."""
    out, i = [], 0
    while i < len(tags):
        if tags[i]:
            t, j = (int(tags[i]) - 1) // 2, i + 1
            while j < len(tags) and tags[j] == 2 + 2 * t:
                j += 1
            out.append((i, j, t))
            i = j
        else:
            i += 1
    return out
