"""Titles of two blocks held against each other in bulk: bounds on whole arrays, the exact ratio for the few pairs they leave."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property

import numpy as np

#: pairs whose common subsequence is found at once, bits of a word (one is left for the carry), length from which SequenceMatcher leaves popular characters out
CHUNK, BITS, POPULAR = 16384, 63, 200
#: texts held against each other at once, classes of characters whose subsequences are bounded one after another
PART, CLASSES = 2000, 4


def ratio(a: str, b: str, enough: float = 2.0) -> float:
    """SequenceMatcher(None, a, b).ratio(), or part of it once that is ``enough``."""
    if len(b) >= POPULAR:
        return SequenceMatcher(None, a, b).ratio()
    total, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        best = at = i = 0
        while i + best < len(x):  # the longest text of x in y, the first of equals
            if x[i : i + best + 1] in y:
                best, at = best + 1, i
                while i + best < len(x) and x[i : i + best + 1] in y:
                    best += 1
            i += 1
        if best:
            total += best
            if 2.0 * total / (len(a) + len(b)) >= enough:
                break
            j = y.find(x[at : at + best])
            if at and j:
                todo.append((x[:at], y[:j]))
            if at + best < len(x) and j + best < len(y):
                todo.append((x[at + best :], y[j + best :]))
    return 2.0 * total / (len(a) + len(b)) if a or b else 1.0


class Texts:
    """Texts as arrays: ``codes`` (0 after the end), ``n`` their lengths, ``has`` how often each code occurs."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, size: int):
        self.codes, self.n, self.size = codes, n, size

    @classmethod
    def of(cls, texts: list[str], code: dict[str, int]) -> Texts:
        n = np.array([len(t) for t in texts], np.int32)
        codes = np.zeros((len(texts), max(1, n.max(initial=0))), np.int16 if len(code) < 32767 else np.int32)
        codes[np.arange(codes.shape[1]) < n[:, None]] = [code[c] for c in "".join(texts)]
        return cls(codes, n, len(code) + 1)

    @cached_property
    def has(self) -> np.ndarray:
        kind = np.uint8 if self.codes.shape[1] < 256 else np.uint16 if self.codes.shape[1] < 65536 else np.int32
        at = self.codes.astype(np.int64) + np.arange(len(self.n))[:, None] * self.size
        return np.ascontiguousarray(np.bincount(at.ravel(), minlength=len(self.n) * self.size).reshape(-1, self.size).T.astype(kind))

    @cached_property
    def masks(self) -> np.ndarray:
        """By word, for each text and code the places where it stands."""
        width = -(-self.codes.shape[1] // BITS)
        masks = np.zeros((width, len(self.n) * self.size), np.uint64)
        for p in range(self.codes.shape[1]):
            masks[p // BITS, np.arange(len(self.n)) * self.size + self.codes[:, p]] |= np.uint64(1 << p % BITS)
        masks.reshape(width, len(self.n), self.size)[:, :, 0] = 0
        return masks

    def rows(self, k: np.ndarray) -> Texts:
        out = Texts(self.codes[k], self.n[k], self.size)
        out.has = np.ascontiguousarray(self.has[:, k])
        return out

    def only(self, codes: np.ndarray) -> Texts:
        """The texts without all other codes."""
        keep = np.isin(self.codes, codes)
        n = keep.sum(axis=1, dtype=np.int32)
        at = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, n.max(initial=0))]
        out = np.take_along_axis(self.codes, at, axis=1)
        return Texts(np.where(np.arange(out.shape[1]) < n[:, None], out, 0), n, self.size)


def _may(a: Texts, b: Texts, t: float, span: tuple[int, int, int, int], rows: int = 64):
    """(i, j, characters in common) of pairs of ``span`` that lengths and common characters allow to reach the ratio ``t``, some rows at a time.

    The texts of a span come by length.
    """
    x, x2, y, y2 = span
    kind = np.promote_types(a.has.dtype, b.has.dtype)
    used = np.flatnonzero(a.has[:, x:x2].any(axis=1) & b.has[:, y:y2].any(axis=1))
    used = used[used > 0]
    for lo in range(x, x2, rows):
        na = a.n[lo : min(lo + rows, x2), None]
        p, q = y + np.searchsorted(b.n[y:y2], (na[0, 0] * t / (2 - t) - 1e-6, na[-1, 0] * (2 - t) / t + 1e-6))
        if p == q:
            continue
        need = (na + b.n[p:q]) * (t / 2) - 1e-9
        shared = np.zeros(need.shape, kind)
        for c in used:
            shared += np.minimum(a.has[c, lo : lo + len(na), None], b.has[c, p:q])
        i, j = np.nonzero(shared >= need)
        yield i + lo, j + p, shared[i, j].astype(np.int32)


def common(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair (i, j), bit-parallel over the texts of b."""
    full, shift, out = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.zeros(len(i), np.int32)
    words = (-(-b.n // BITS))[j]
    for wide in range(1, int(words.max(initial=0)) + 1):
        some = np.flatnonzero(words == wide)
        for lo in range(0, len(some), CHUNK):
            k = some[lo : lo + CHUNK]
            x, base = i[k], j[k].astype(np.int64) * b.size
            codes = a.codes[x, : a.n[x].max(initial=0)].T.astype(np.int64)
            v = np.full((wide, len(k)), full)
            u, s, at = np.empty(len(k), np.uint64), np.empty(len(k), np.uint64), np.empty(len(k), np.int64)
            for step in codes:
                np.add(base, step, out=at)
                for w in range(wide):
                    b.masks[w].take(at, out=u, mode="clip")
                    u &= v[w]
                    np.add(v[w], u, out=s)
                    if w:
                        s += carry
                    if w + 1 < wide:
                        carry = s >> shift
                        s &= full
                    v[w] ^= u
                    v[w] |= s
            v[-1] &= full
            out[k] = wide * BITS - np.bitwise_count(v).sum(axis=0, dtype=np.int32)
    return out


def _classes(often: Counter, code: dict[str, int]) -> list[np.ndarray]:
    """Codes dealt out so that each class holds as many characters as any other."""
    out: list[list[int]] = [[] for _ in range(CLASSES)]
    held = [0] * CLASSES
    for c, n in often.most_common():
        k = held.index(min(held))
        out[k].append(code[c])
        held[k] += n
    return [np.array(x, np.int64) for x in out if x]


class _Part:
    """Some texts, by group and length, and their subsequences by class of characters."""

    def __init__(self, at: np.ndarray, whole: Texts, classes: list[np.ndarray]):
        self.at, self.whole, self.classes = at, whole, classes

    @cached_property
    def cut(self) -> list[Texts]:
        return [self.whole.only(c) for c in self.classes]


def _reach(a: _Part, b: _Part, i: np.ndarray, j: np.ndarray, shared: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose longest common subsequence allows the ratio ``t``.

    It is no longer than those of the texts cut down to each class of characters together; a class that wasn't looked at counts with the characters in common.
    """
    need = (a.whole.n[i] + b.whole.n[j]) * (t / 2) - 1e-9
    if len(i) > 2000:
        for k, codes in enumerate(a.classes):
            same = np.zeros(len(i), np.int32)
            for c in codes:
                same += np.minimum(a.whole.has[c].take(i), b.whole.has[c].take(j))
            shared = shared - same + common(a.cut[k], b.cut[k], i, j)
            keep = shared >= need
            i, j, shared, need = i[keep], j[keep], shared[keep], need[keep]
    keep = common(a.whole, b.whole, i, j) >= need
    return i[keep], j[keep]


def close_pairs(xs: list[str], ys: list[str], t: float, first: np.ndarray | None = None, after: tuple[np.ndarray, np.ndarray] | None = None, groups: list[tuple[int, int]] | None = None, exact: bool = True) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of the pairs of which neither holds the other and whose ratio reaches ``t``.

    With ``first``, an order of ys, of each x only its first pair by it; with ``after``, a place of each x and of each y, only pairs
    whose x stands after its y; with ``groups``, numbers of xs and ys that belong together, only pairs within a group. The ratio is
    part of itself if it need not be ``exact``.
    """
    often = Counter("".join(xs)) + Counter("".join(ys))
    code = {c: n for n, c in enumerate(sorted(often), 1)}
    classes = _classes(often, code)
    nx, ny = (np.array([len(z) for z in zs], np.int64) for zs in (xs, ys))
    sizes = np.array(groups or [(len(xs), len(ys))])
    ends = np.vstack([[0, 0], sizes.cumsum(axis=0)])
    spans = [(x, x2, y, y2) for (x, y), (x2, y2) in zip(ends.tolist(), ends[1:].tolist())]

    def parts(texts: list[str], n: np.ndarray, order: np.ndarray | None, group: np.ndarray) -> list[_Part]:
        every = np.argsort(n if order is None else order, kind="stable")
        cut = [every] if groups else [every[lo : lo + PART] for lo in range(0, len(every), PART)]
        cut = [k[np.lexsort((n[k], group[k]))] for k in cut]
        return [_Part(k, Texts.of([texts[p] for p in k], code), classes) for k in cut]

    px = parts(xs, nx, None if after is None else after[0], np.repeat(np.arange(len(sizes)), sizes[:, 0]))
    done = np.zeros(len(xs), bool)

    def settle(a: _Part, b: _Part, some: list) -> Iterator[tuple[int, int, float]]:
        i, j = _reach(a, b, *(np.concatenate(z) for z in zip(*some)), t)
        i, j = a.at[i], b.at[j]
        order = np.lexsort((j if first is None else first[j], i))
        for p, q in zip(i[order].tolist(), j[order].tolist()):
            if first is not None and done[p]:
                continue
            x, y = xs[p], ys[q]
            if x in y or y in x:
                continue
            r = ratio(x, y) if exact else ratio(x, y, t)
            if r >= t:
                yield p, q, r
                done[p] = True

    for b in parts(ys, ny, first if first is not None else None if after is None else after[1], np.repeat(np.arange(len(sizes)), sizes[:, 1])):
        for a in px:
            if after is not None and not groups and after[0][a.at].max(initial=-1) <= after[1][b.at].min(initial=0):
                continue
            if first is not None and not groups and done[a.at].any():
                open_ = np.flatnonzero(~done[a.at])
                a = _Part(a.at[open_], a.whole.rows(open_), classes)
            some, held = [], 0
            for span in spans if groups else [(0, len(a.at), 0, len(b.at))]:
                for i, j, shared in _may(a.whole, b.whole, t, span):
                    if after is not None:
                        ok = after[0][a.at[i]] > after[1][b.at[j]]
                        i, j, shared = i[ok], j[ok], shared[ok]
                    some.append((i, j, shared))
                    held += len(i)
                    if held > 500_000:
                        yield from settle(a, b, some)
                        some, held = [], 0
            if some:
                yield from settle(a, b, some)
