"""Distances and common n-grams of many pairs of sequences at once, as array operations over all of them.

Sequences are arrays of codes from 1 on, each pair with its own. Rows of the tables of alignments are bits, 63 to a word (the last one takes
carries), four words to a unit, the words of all pairs of a group in one array; a step takes one more element of each longer sequence. All results are exact."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

BITS, UNIT = 63, 4
_ONE, _TOP, _FULL = np.uint64(1), np.uint64(BITS), np.uint64(1 << BITS)
#: Words of a group, and numbers that the tables of its codes and steps hold, unless a single pair needs more.
WORDS, CELLS = 8192, 1 << 22
#: Elements of all longer sequences of a group, in multiples of the longest one, from which steps over the whole group pay.
FEW = 24


def char_codes(pairs: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, codes, number of different ones) by character."""
    known = np.zeros(0x110000, dtype=np.int32)
    out = []
    for a, b in pairs:
        x = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.arange(len(x), dtype=np.int32)
        known[x] = at
        kept = x[known[x] == at]  # one place of each character
        known[kept] = np.arange(1, len(kept) + 1, dtype=np.int32)
        x = known[x]
        out.append((x[: len(a)], x[len(a) :], len(kept)))
    return out


def word_codes(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The same by word."""
    out = []
    for a, b in pairs:
        both = a + b
        known = {w: i for i, w in enumerate(dict.fromkeys(both), 1)}
        x = np.fromiter(map(known.__getitem__, both), dtype=np.int32, count=len(both))
        out.append((x[: len(a)], x[len(a) :], len(known)))
    return out


class _Group:
    """Pairs in falling order of their longer sequences, so that those not yet at their end are always the first ones."""

    def __init__(self, short: list[np.ndarray], long: list[np.ndarray], kinds: np.ndarray):
        m, self.n = np.array([len(x) for x in short]), np.array([len(x) for x in long])
        units, size = _units(m), len(short)
        w = units * UNIT
        self.first, block = np.cumsum(w) - w, np.cumsum(kinds * units) - kinds * units
        owner = np.repeat(np.arange(size), w)
        word = np.arange(len(owner)) - self.first[owner]
        self.mask = (_ONE << np.clip(m[owner] - BITS * word, 0, BITS).astype(np.uint64)) - _ONE
        self.start = (word == 0).astype(np.uint64)
        self.owner, self.unit = owner[::UNIT].copy(), word[::UNIT] // UNIT
        places = np.zeros(int((kinds * w).sum()), dtype=np.uint64)  # the bits of each code of each pair
        of, at = np.repeat(np.arange(size), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        np.add.at(places, (block[of] + (np.concatenate(short) - 1) * units[of]) * UNIT + at // BITS, _ONE << (at % BITS).astype(np.uint64))
        self.places = places.reshape(-1, UNIT)
        of, at = np.repeat(np.arange(size), self.n), np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.rows = np.zeros((int(self.n.max()), size), dtype=np.int64)
        self.rows[at, of] = block[of] + (np.concatenate(long) - 1) * units[of]
        self.ends = np.append(self.first, len(owner))

    def runs(self) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """(words of the pairs that go on, for each step where the next element of the longer sequence stands in them), by runs of
        steps with the same pairs."""
        idx, found = np.empty(len(self.owner), dtype=np.int64), np.empty((len(self.owner), UNIT), dtype=np.uint64)
        ends = np.unique(self.n[self.n > 0])
        alive = np.searchsorted(-self.n, -ends, side="right")

        def steps(begin: int, end: int, k: int) -> Iterator[np.ndarray]:
            owner, unit, i, out = self.owner[:k], self.unit[:k], idx[:k], found[:k]
            flat = out.reshape(-1)
            for row in self.rows[begin:end]:
                row.take(owner, out=i, mode="clip")
                np.add(i, unit, out=i)
                self.places.take(i, axis=0, out=out, mode="clip")
                yield flat

        begin = 0
        for end, k in zip(ends.tolist(), self.ends[alive].tolist()):
            yield k, steps(begin, end, k // UNIT)
            begin = end

    def count(self, bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits & self.mask).astype(np.int64), self.first)

    def distances(self) -> np.ndarray:
        up, down = self.mask.copy(), np.zeros_like(self.mask)
        sums, carries, flags = np.empty_like(up), np.empty((2, len(up)), dtype=np.uint64), np.empty(len(up), dtype=bool)
        across = np.empty((2, len(up)), dtype=np.uint64)
        and_, or_, xor, inv, add, left, right = np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.invert, np.add, np.left_shift, np.right_shift
        for k, steps in self.runs():
            vp, vn, t, h, c, mask, start = up[:k], down[:k], sums[:k], across[:, :k], carries[:, :k], self.mask[:k], self.start[:k]
            hp, hn, h1, c1, carry = h[0], h[1], h[:, 1:], c[:, :-1], _carrying(t, c[0], flags[:k])
            for x in steps:
                or_(x, vn, x)
                and_(x, vp, t)
                add(t, vp, t)
                carry()
                xor(t, vp, t)
                or_(t, x, t)
                and_(vp, t, hn)
                or_(vp, t, hp)
                inv(hp, hp)
                or_(hp, vn, hp)
                left(h, _ONE, h)
                right(h, _TOP, c)
                or_(h1, c1, h1)
                or_(hp, start, hp)
                and_(t, hp, vn)
                or_(t, hp, t)
                inv(t, t)
                or_(t, hn, t)
                and_(t, mask, vp)
        return self.n + self.count(up) - self.count(down)

    def common(self) -> np.ndarray:
        """Lengths of longest common subsequences."""
        rest = self.mask.copy()
        sums, carries, flags = np.empty_like(rest), np.empty_like(rest), np.empty(len(rest), dtype=bool)
        for k, steps in self.runs():
            v, t, mask, carry = rest[:k], sums[:k], self.mask[:k], _carrying(sums[:k], carries[:k], flags[:k])
            for x in steps:
                np.bitwise_and(v, x, t)
                np.bitwise_xor(v, t, x)
                np.add(v, t, t)
                carry()
                np.bitwise_or(t, x, t)
                np.bitwise_and(t, mask, v)
        return self.count(self.mask) - self.count(rest)


def _units(m):
    """Of ``UNIT`` words, for sequences of m elements and a bit to spare."""
    return m // (BITS * UNIT) + 1


def _carrying(t: np.ndarray, c: np.ndarray, flags: np.ndarray) -> Callable[[], None]:
    """What takes the carries of the sums in t to the next words. The bit that each pair has to spare ends them."""
    after, before = t[1:], c[:-1]

    def carry() -> None:
        np.right_shift(t, _TOP, c)
        np.add(after, before, after)
        if np.equal(t, _FULL, flags).any():
            at = np.flatnonzero(flags & (c == 0)) + 1  # words of ones only hand a carry on
            while len(at):
                t[at] += _ONE
                at = at[t[at] == _FULL] + 1

    return carry


def _bits(a: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def _distance(a: list[int], b: list[int]) -> int:
    """The same for one pair, whose words are one long number."""
    places, full = _bits(a), (1 << len(a)) - 1
    vp, vn = full, 0
    for y in b:
        x = places.get(y, 0) | vn
        d = (((x & vp) + vp) ^ vp | x) & full
        h = ((vn | full ^ (vp | d)) << 1 | 1) & full
        vn, vp = h & d, (vp & d) << 1 & full | full ^ (d | h)
    return len(b) + vp.bit_count() - vn.bit_count()


def _common(a: list[int], b: list[int]) -> int:
    places, full = _bits(a), (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & places.get(y, 0)
        v = (v + u | v ^ u) & full
    return len(a) - v.bit_count()


def _grouped(coded: list, work: Callable[[_Group], np.ndarray], alone: Callable[[list[int], list[int]], int]) -> list[int]:
    pairs = [(a, b, k) if len(a) <= len(b) else (b, a, k) for a, b, k in coded]
    order = sorted(range(len(pairs)), key=lambda i: -len(pairs[i][1]))
    out = [0] * len(pairs)
    group: list[int] = []
    words = cells = 0

    def run() -> None:
        if not group:
            return
        if sum(len(pairs[i][1]) for i in group) < FEW * len(pairs[group[0]][1]):
            got = [alone(pairs[i][0].tolist(), pairs[i][1].tolist()) for i in group]
        else:
            got = work(_Group([pairs[i][0] for i in group], [pairs[i][1] for i in group], np.array([pairs[i][2] for i in group]))).tolist()
        for i, d in zip(group, got):
            out[i] = d

    for i in order:
        a, _, kinds = pairs[i]
        w = _units(len(a)) * UNIT
        words, cells = words + w, cells + w * kinds
        if group and max(words / WORDS, cells / CELLS, (len(group) + 1) * len(pairs[group[0]][1]) / CELLS) > 1:
            run()
            group, words, cells = [], w, w * kinds
        group.append(i)
    run()
    return out


def edit_distances(coded: list) -> list[int]:
    """Levenshtein distances."""
    return _grouped(coded, _Group.distances, _distance)


def common_lengths(coded: list) -> list[int]:
    """Lengths of longest common subsequences."""
    return _grouped(coded, _Group.common, _common)


def gram_hits(coded: list, most: int, elements: int = 1 << 16) -> np.ndarray:
    """(pairs, most): how many n-grams of 1 to ``most`` elements both sequences have, each as often as the one that has it less often.

    Sorted once by the longest: shorter ones are their beginnings."""
    out = np.zeros((len(coded), most), dtype=np.int64)
    at = 0
    while at < len(coded):
        end, total, bits = at, 0, 1
        while end < len(coded):
            a, b, k = coded[end]
            more = max(bits, int(k).bit_length())
            if end > at and (total + len(a) + len(b) > elements or most * more + 1 + (end - at).bit_length() > 64):
                break
            end, total, bits = end + 1, total + len(a) + len(b), more
        if most * bits + 1 > 64:  # one pair with many different elements
            a, b = coded[at][0].tolist(), coded[at][1].tolist()
            out[at] = [(Counter(zip(*(a[i:] for i in range(n)))) & Counter(zip(*(b[i:] for i in range(n))))).total() for n in range(1, most + 1)]
        elif total:
            out[at:end] = _hits(coded[at:end], most, bits)
        at = end
    return out


def _hits(coded: list, most: int, bits: int) -> np.ndarray:
    gap = np.zeros(most - 1, dtype=np.int32)
    codes = np.concatenate([x for a, b, _ in coded for x in (a, gap, b, gap)]).astype(np.uint64)
    sizes = np.array([len(x) + most - 1 for a, b, _ in coded for x in (a, b)])
    key = np.repeat(np.arange(len(coded), dtype=np.uint64).repeat(2), sizes)
    for n in range(most):
        key <<= np.uint64(bits)
        key[: len(codes) - n] |= codes[n:]
    key = key << _ONE | np.repeat(np.arange(len(sizes), dtype=np.uint64) & _ONE, sizes)
    key = key[codes > 0]
    key.sort()
    right = np.concatenate(([0], np.cumsum((key & _ONE).astype(np.int64))))
    out = np.zeros((len(coded), most), dtype=np.int64)
    for n in range(1, most + 1):
        gram = key >> np.uint64(1 + bits * (most - n))
        start = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1))
        edges = np.append(start, len(key))
        b = np.diff(right[edges])
        hits = np.minimum(b, np.diff(edges) - b)
        gram = gram[start]
        hits[(gram & np.uint64((1 << bits) - 1)) == 0] = 0  # shorter than n at the end
        out[:, n - 1] = np.bincount((gram >> np.uint64(bits * n)).astype(np.int64), weights=hits, minlength=len(coded))
    return out


def first_matches(coded: list) -> tuple[np.ndarray, np.ndarray]:
    """(matches, chunks) of each pair, where each element of the first sequence takes the first free equal one of the second, and a chunk
    is a run of matches that stand side by side in both."""
    kinds = 1 + max((k for *_, k in coded), default=0)
    sides = []
    for side in (0, 1):
        seqs = [x[side] for x in coded]
        of = np.repeat(np.arange(len(coded)), [len(x) for x in seqs])
        key = of * kinds + np.concatenate([*seqs, np.zeros(0, dtype=np.int32)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.arange(len(key))
        begin = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(key)], at, 0)) if len(key) else at
        sides.append((of, order, key, at - begin))
    (of, order, key, nth), (_, other, key2, nth2) = sides
    if not len(key) or not len(key2):
        return np.zeros(len(coded), dtype=np.int64), np.zeros(len(coded), dtype=np.int64)
    most = 1 + max(int(nth.max()), int(nth2.max()))
    want, have = key * most + nth, key2 * most + nth2
    j = np.minimum(np.searchsorted(have, want), len(have) - 1)
    hit = have[j] == want
    to = np.full(len(key), -1)
    to[order[hit]] = other[j[hit]]
    i = np.flatnonzero(to >= 0)
    to, of = to[i], of[i]
    fresh = np.append(True, (np.diff(i) != 1) | (np.diff(to) != 1) | (np.diff(of) != 0))[: len(i)]
    return np.bincount(of, minlength=len(coded)), np.bincount(of[fresh], minlength=len(coded))
