"""Linear-chain conditional random field over word-shape features, in numpy: training and batched Viterbi decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

OFFSETS = (-5, -4, -3, -2, -1, 0, 1, 2, 3)


class CRF:
    """Tags sequences of token types. A type has features; a token is scored by the features of the types around it.

    All that depends on a type is computed once a type, so decoding costs a few array look-ups a token.
    """

    def __init__(self, tags: list[str], featurise: Callable[[str], Iterable[str]]):
        self.tags, self.featurise = tags, featurise
        self.index: dict[str, int] = {}
        self.types: dict[str, int] = {}
        self.table = np.zeros((0, len(OFFSETS), len(tags)), dtype=np.float32)

    def __getstate__(self):
        return self.__dict__ | {"types": {}, "table": np.zeros((0, len(OFFSETS), len(self.tags)), dtype=np.float32)}

    # training

    def fit(self, examples: list[tuple[list[str], list[int]]], steps: int = 140, rate: float = 0.15, l2: float = 7e-4, words: float = 1.0) -> CRF:
        """``words`` times the penalty lies on features of single words (=...), so that shapes and surroundings explain what they can; it grows with the distance from the token."""
        k = len(self.tags)
        names: dict[str, int] = {}
        for types, _ in examples:
            for t in types:
                names.setdefault(t, len(names) + 1)  # 0: outside
        for t in ["\x00", *names]:
            for f in self.featurise(t):
                self.index.setdefault(f, len(self.index))
        x = np.zeros((len(names) + 1, len(self.index)), dtype=np.float32)
        for t, i in [("\x00", 0), *names.items()]:
            x[i, [self.index[f] for f in self.featurise(t)]] = 1
        price = np.array([l2 * (words if f[0] == "=" else 1.0) for f in self.index], dtype=np.float32)[None, :, None] * np.array([max(0.1, abs(o) ** 0.5 * 0.8) for o in OFFSETS], dtype=np.float32)[:, None, None]
        n, length = len(examples), max(len(t) for t, _ in examples)
        pad = max(map(abs, OFFSETS))
        ids = np.zeros((n, length + 2 * pad), dtype=np.int64)
        gold = np.zeros((n, length), dtype=np.int64)
        live = np.zeros((n, length), dtype=bool)
        for i, (types, tags) in enumerate(examples):
            ids[i, pad : pad + len(types)] = [names[t] for t in types]
            gold[i, : len(tags)] = tags
            live[i, : len(tags)] = True
        at = [ids[:, pad + o : pad + o + length] for o in OFFSETS]
        w = np.zeros((len(OFFSETS), len(self.index), k), dtype=np.float32)
        trans = np.zeros((k, k), dtype=np.float32)
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        onehot = np.eye(k, dtype=np.float32)[gold] * live[..., None]
        for step in range(1, steps + 1):
            emit = sum((x @ w[o])[at[o]] for o in range(len(OFFSETS)))
            et = np.exp(trans)
            a, norm = np.zeros_like(emit), np.zeros((n, length), dtype=np.float32)
            b = np.ones_like(emit)
            e = np.exp(emit - emit.max(-1, keepdims=True))
            a[:, 0] = e[:, 0] / e[:, 0].sum(-1, keepdims=True)
            for t in range(1, length):
                y = (a[:, t - 1] @ et) * e[:, t]
                y /= y.sum(-1, keepdims=True)
                a[:, t] = np.where(live[:, t, None], y, a[:, t - 1])
            for t in range(length - 2, -1, -1):
                y = (b[:, t + 1] * e[:, t + 1]) @ et.T
                y /= y.sum(-1, keepdims=True)
                b[:, t] = np.where(live[:, t + 1, None], y, 1)
            p = a * b
            p /= p.sum(-1, keepdims=True)
            p *= live[..., None]
            g_emit = (p - onehot) / n
            pair = np.zeros((k, k), dtype=np.float32)
            for t in range(1, length):
                q = a[:, t - 1, :, None] * et * (e[:, t] * b[:, t])[:, None, :]
                q /= q.sum((1, 2), keepdims=True)
                pair += (q * live[:, t, None, None]).sum(0)
            np.subtract.at(pair, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
            g_w = np.empty_like(w)
            flat = g_emit.reshape(-1, k)
            for o in range(len(OFFSETS)):
                by = np.stack([np.bincount(at[o].ravel(), flat[:, j], minlength=len(x)) for j in range(k)], 1).astype(np.float32)
                g_w[o] = x.T @ by
            for i, (param, g) in enumerate(((w, g_w + price * w), (trans, pair / n + l2 * trans))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                param -= rate * (1 - (step - 1) / steps) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.w, self.trans = w, trans
        return self

    # decoding

    def _rows(self, types: list[str]) -> np.ndarray:
        """Indices into the score table, with rows for types not met before."""
        new = [t for t in dict.fromkeys(types) if t not in self.types]
        if new:
            if len(self.types) > 400_000:  # forgets, so a worker's memory stays bounded
                self.types.clear()
                self.table = self.table[:0]
                new = list(dict.fromkeys(types))
            if not self.types:
                new = ["\x00", *(t for t in new if t != "\x00")]
            rows = np.zeros((len(new), len(OFFSETS), len(self.tags)), dtype=np.float32)
            for i, t in enumerate(new):
                self.types[t] = len(self.types)
                f = [self.index[x] for x in self.featurise(t) if x in self.index]
                if f:
                    rows[i] = self.w[:, f].sum(1)
            self.table = np.concatenate([self.table, rows])
        get = self.types.__getitem__
        return np.fromiter(map(get, types), dtype=np.int64, count=len(types))

    def decode(self, sequences: list[list[str]], batch: int = 256) -> list[np.ndarray]:
        """Best tag sequence of each sequence of types; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        pad = max(map(abs, OFFSETS))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and stop - start < batch and len(sequences[order[stop]]) * (stop - start + 1) < 400_000:
                stop += 1
            group = order[start:stop]
            start = stop
            length = len(sequences[group[-1]])
            flat = self._rows([t for i in group for t in sequences[i]])
            ids = np.zeros((len(group), length + 2 * pad), dtype=np.int64)
            at = 0
            sizes = np.array([len(sequences[i]) for i in group])
            for row, n in enumerate(sizes):
                ids[row, pad : pad + n] = flat[at : at + n]
                at += n
            emit = sum(self.table[ids[:, pad + o : pad + o + length], j] for j, o in enumerate(OFFSETS))
            score = emit[:, 0]
            back = np.zeros((length, len(group), len(self.tags)), dtype=np.int8)
            final = np.empty_like(score)
            ends = np.flatnonzero(sizes == 1)
            final[ends] = score[ends]
            at_row = np.arange(len(group))
            for t in range(1, length):
                y = score[:, :, None] + self.trans
                back[t] = best = y.argmax(1)
                score = np.take_along_axis(y, best[:, None, :], 1)[:, 0] + emit[:, t]
                if (ends := np.flatnonzero(sizes == t + 1)).size:
                    final[ends] = score[ends]
            last = final.argmax(1)
            path = np.zeros((length, len(group)), dtype=np.int8)
            now = last
            for t in range(length - 1, -1, -1):
                # a sequence's last token has its best tag; each one before it the tag that led there
                now = np.where(sizes - 1 <= t, last, back[t + 1][at_row, now] if t + 1 < length else last)
                path[t] = now
            for row, i in enumerate(group):
                out[i] = path[: sizes[row], row].copy()
        return out


def outline(word: str) -> str:
    """Shape: X x 0 for upper, lower and digit, runs cut to two."""
    s = re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", word))
    return re.sub(r"(.)\1{2,}", r"\1\1", s)
