"""Token sets of two blocks against each other, in arrays: which sets of one block some set of the other is like."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

#: Words of 64 bits in a sketch of the tokens of a set.
SKETCH = 4
#: Words of 64 bits in the sketch that what passes the first has to pass from both sides.
WIDE = 8
#: Candidates held at once.
CHUNK = 1 << 20
#: The same in like_rows.
MET = 1 << 18
#: Ratio of the size classes.
CLASS = 1.25


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on an array of 64-bit integers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each row starts, with the end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def runs(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, …, low[i] + n[i] - 1 for each i, one after another."""
    return np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)


def any_bits(tokens: np.ndarray, starts: np.ndarray, width: int = SKETCH) -> np.ndarray:
    """The 64 x width bits set by the tokens of each non-empty set: a bit that one set has alone is a token that it has alone."""
    place = (mix64(tokens) % np.uint64(64 * width)).astype(np.int16)
    out = np.empty((len(starts) - 1, width), np.uint64)
    for i in range(width):
        out[:, i] = np.bitwise_or.reduceat(np.where(place >> 6 == i, np.uint64(1) << (place & 63).astype(np.uint64), np.uint64(0)), starts[:-1])
    return out


def covered_rows(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], threshold: float, rounds: tuple[int, ...] = (1, 4)) -> np.ndarray:
    """Whether each set of left has a Jaccard likeness of at least threshold with some set of right. Both are (values, starts) of
    non-empty sets; exact.

    A set of n tokens that must share k with sets of some size is looked up under its n - k + 1 rarest tokens, by the frequency
    in right. What meets passes the sketches and is counted, the likeliest of each left set first; a set that has found a
    partner leaves, so that frequent tokens are read for those that are still without one.
    """
    (pt, ps), (et, es) = left, right
    m, n = np.diff(ps), np.diff(es)
    hit = np.zeros(len(m), bool)
    if not len(m) or not len(n):
        return hit
    needed = lambda x, y: np.ceil(threshold / (1 + threshold) * (x + y) - 1e-9).astype(np.int64)
    sp, se = any_bits(pt, ps), any_bits(et, es)
    names = np.unique(et)
    ei = np.searchsorted(names, et).astype(np.int32)
    df = np.bincount(ei, minlength=len(names))
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    ei = ei[np.lexsort((ei, df[ei], of))]
    place = (np.arange(len(et)) - np.repeat(es[:-1], n)).astype(np.int32)
    pi = np.minimum(np.searchsorted(names, pt), len(names) - 1)
    shared = names[pi] == pt
    pi, po = pi[shared], np.repeat(np.arange(len(m)), m)[shared]
    known = np.sort(po * len(names) + pi)
    size_class = np.floor(np.log(m) / math.log(CLASS) + 1e-9).astype(np.int64)

    def settle(cp: np.ndarray, ce: np.ndarray) -> None:
        """Count what these pairs share."""
        for lo in range(0, len(cp), CHUNK // 4):
            x, y = cp[lo : lo + CHUNK // 4], ce[lo : lo + CHUNK // 4]
            key = np.repeat(x * len(names), n[y]) + ei[runs(es[y], n[y])]
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            s = np.add.reduceat((known[at] == key).astype(np.int64), np.cumsum(n[y]) - n[y])
            hit[x[s >= threshold * (m[x] + n[y] - s) - 1e-9]] = True

    for c in np.unique(size_class):
        own = size_class == c
        low, high = m[own].min(), m[own].max()
        k = needed(low, n)
        meets = (k <= n) & (n >= np.ceil(threshold * low - 1e-9)) & (n <= np.floor(high / threshold + 1e-9))
        filed = np.flatnonzero(meets[of] & (place < (n - k + 1)[of]))
        filed = filed[np.argsort(ei[filed], kind="stable")]
        tokens, rows = ei[filed], of[filed]
        mine = own[po]
        token, owner = pi[mine], po[mine]
        a = np.searchsorted(tokens, token, "left")
        many = np.searchsorted(tokens, token, "right") - a
        order = np.argsort(many, kind="stable")
        order = order[many[order] > 0]
        total = np.cumsum(many[order])
        i = 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CHUNK)))
            part, i = order[i:j], j
            part = part[~hit[owner[part]]]
            cp, ce = np.repeat(owner[part], many[part]), rows[runs(a[part], many[part])]
            alone = np.zeros(len(cp), np.int64)
            for w in range(SKETCH):
                alone += np.bitwise_count(se[ce, w] & ~sp[cp, w])
            spare = n[ce] - needed(m[cp], n[ce]) - alone
            good = np.flatnonzero(spare >= 0)
            good = good[np.lexsort((-spare[good], cp[good]))]
            cp, ce = cp[good], ce[good]
            for most in (*rounds, None):
                if not len(cp):
                    break
                now = np.ones(len(cp), bool) if most is None else np.arange(len(cp)) - np.searchsorted(cp, cp) < most
                settle(cp[now], ce[now])
                left_over = ~now & ~hit[cp]
                cp, ce = cp[left_over], ce[left_over]
    return hit


def wide_bits(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """any_bits of WIDE words, at places that have nothing to do with those of any_bits."""
    n = len(starts) - 1
    place = (mix64(mix64(tokens)) % np.uint64(64 * WIDE)).astype(np.int64)
    out = np.zeros(n * WIDE, np.uint64)
    np.bitwise_or.at(out, np.repeat(np.arange(n) * WIDE, np.diff(starts)) + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return out.reshape(n, WIDE)


#: A token that so few sets of two blocks have, or one set in FEW, is looked up by itself, a more frequent one together with a second.
RARE, FEW = 128, 350


def like_rows(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], need, least, same: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left and of right, (values, starts) of non-empty sets, that share at least need(m, n) values for their sizes m
    and n, and how many they share; exact. least(n): the smallest size that a set of n can match. same: right is left, and a row meets later ones only.

    Two sets that share k values have the first one, by the frequency in both blocks, among the n - k + 1 rarest of each, and
    the second one among the n - k + 2 rarest. Sets meet under the first where it is rare and else under both, which few
    sets have in common however frequent each of the two is.
    """
    (lt, ls), (rt, rs) = left, right
    sizes, starts = (np.diff(ls), np.diff(rs)), (ls[:-1], rs[:-1])
    if not len(sizes[0]) or not len(sizes[1]):
        return (np.zeros(0, np.int64),) * 3
    names = np.unique(np.concatenate([lt, rt]))
    v = len(names)
    values = [np.searchsorted(names, t).astype(np.int32) for t in (lt, rt)]
    df = sum(np.bincount(x, minlength=v) for x in values)
    rank = np.empty(v, np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(v, dtype=np.int32)
    df = np.sort(df)
    bar = max(RARE, (len(sizes[0]) + len(sizes[1])) // FEW)
    of = [np.repeat(np.arange(len(n), dtype=np.int32), n) for n in sizes]
    values = [rank[x][np.lexsort((rank[x], o))] for x, o in zip(values, of)]
    place = [(np.arange(len(x)) - np.repeat(s, n)).astype(np.int32) for x, s, n in zip(values, starts, sizes)]
    bits = [any_bits(lt, ls), any_bits(rt, rs)]
    wide = [wide_bits(lt, ls), wide_bits(rt, rs)]
    known = np.repeat(np.arange(len(sizes[0])), sizes[0]) * v + values[0]  # sorted, as values are within each row
    found: list[np.ndarray] = []
    common: list[np.ndarray] = []

    def meet(kx: np.ndarray, rx: np.ndarray, ky: np.ndarray, ry: np.ndarray) -> None:
        """Rows under equal keys, ky sorted: by the sketches, the wide ones once for each pair, then by counting."""
        a = np.searchsorted(ky, kx, "left")
        many = np.searchsorted(ky, kx, "right") - a
        at = np.flatnonzero(many)
        total = np.cumsum(many[at])
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + MET)))
            part, i = at[i:j], j
            p, q = np.repeat(rx[part], many[part]), ry[runs(a[part], many[part])]
            if same:
                ok = p < q
                p, q = p[ok], q[ok]
            alone = np.zeros(len(p), np.int64)
            for w in range(SKETCH):
                alone += np.bitwise_count(bits[0][p, w] & ~bits[1][q, w])
            m, n = sizes[0][p], sizes[1][q]
            k = need(m, n)
            ok = np.flatnonzero((alone <= m - k) & (k <= np.minimum(m, n)))
            pair = np.unique(p[ok].astype(np.int64) * len(sizes[1]) + q[ok])
            p, q = np.divmod(pair, len(sizes[1]))
            x, y, k = wide[0][p], wide[1][q], need(sizes[0][p], sizes[1][q])
            spare = [n - k - np.bitwise_count(b).sum(1, dtype=np.int64) for n, b in ((sizes[0][p], x & ~y), (sizes[1][q], y & ~x))]
            pair = pair[(spare[0] >= 0) & (spare[1] >= 0)]
            for lo in range(0, len(pair), MET // 4):
                p, q = np.divmod(pair[lo : lo + MET // 4], len(sizes[1]))
                n = sizes[1][q]
                key = np.repeat(p * v, n) + values[1][runs(starts[1][q], n)]
                where = np.minimum(np.searchsorted(known, key), len(known) - 1)
                shared = np.add.reduceat((known[where] == key).astype(np.int64), np.cumsum(n) - n)
                good = shared >= need(sizes[0][p], n)
                found.append(pair[lo : lo + MET // 4][good])
                common.append(shared[good])

    classes = [np.floor(np.log(n) / math.log(CLASS) + 1e-9).astype(np.int64) for n in sizes]
    for cx in np.unique(classes[0]):
        for cy in np.unique(classes[1]):
            own = classes[0] == cx, classes[1] == cy
            low = [sizes[i][own[i]].min() for i in (0, 1)]
            high = [sizes[i][own[i]].max() for i in (0, 1)]
            if high[0] < least(low[1]) or high[1] < least(low[0]):
                continue
            # the fewest values that a set has to share with any of the other class
            k = [need(sizes[i], np.maximum(low[1 - i], least(sizes[i]))) for i in (0, 1)]
            single = min(k[i][own[i]].min() for i in (0, 1)) < 2
            entry = []
            for i in (0, 1):
                e = np.flatnonzero(own[i][of[i]] & (place[i] <= (sizes[i] - k[i])[of[i]]) & (df[values[i]] > 1))
                entry.append(e[np.argsort(values[i][e], kind="stable")])
            here = [np.bincount(values[i][entry[i]], minlength=v) > 0 for i in (0, 1)]
            entry = [e[here[1 - i][values[i][e]]] for i, e in enumerate(entry)]
            rare = [np.ones(len(e), bool) if single else df[values[i][e]] <= bar for i, e in enumerate(entry)]
            x, y = (e[r] for e, r in zip(entry, rare))
            meet(values[0][x], of[0][x], values[1][y], of[1][y])
            x, y = (e[~r] for e, r in zip(entry, rare))
            if not len(x) or not len(y):
                continue
            # the values that may come second, for the entries of some first values at a time
            after = [(sizes[i] - k[i])[of[i][e]] + 1 - place[i][e] for i, e in ((0, x), (1, y))]
            work = np.bincount(values[0][x], after[0], v) + np.bincount(values[1][y], after[1], v)
            bound = np.cumsum(work) // (2 * CHUNK)
            cut = np.flatnonzero(np.concatenate([[True], bound[1:] != bound[:-1]]))
            for lo, hi in zip(cut, [*cut[1:], v]):
                keys = []
                for i, e, n in ((0, x, after[0]), (1, y, after[1])):
                    s = slice(*np.searchsorted(values[i][e], [lo, hi]))
                    e, n = e[s], n[s]
                    second = runs(e + 1, n)
                    keys.append((np.repeat(values[i][e].astype(np.int64), n) * v + values[i][second], np.repeat(of[i][e], n)))
                (kx, rx), (ky, ry) = keys
                order = np.argsort(ky, kind="stable")
                meet(kx, rx, ky[order], ry[order])
    if not found:
        return (np.zeros(0, np.int64),) * 3
    pair, first = np.unique(np.concatenate(found), return_index=True)
    return *np.divmod(pair, len(sizes[1])), np.concatenate(common)[first]


def disjoint(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets p[i] of left and q[i] of right, (values, starts), have nothing in common."""
    (lt, ls), (rt, rs) = left, right
    out = np.ones(len(p), bool)
    if not len(lt) or not len(rt):
        return out
    names = np.unique(np.concatenate([lt, rt]))
    n = np.diff(rs)
    known = np.sort(np.repeat(np.arange(len(ls) - 1), np.diff(ls)) * len(names) + np.searchsorted(names, lt))
    values = np.searchsorted(names, rt)
    for lo in range(0, len(p), CHUNK):
        x, y = p[lo : lo + CHUNK], q[lo : lo + CHUNK]
        key = np.repeat(x * len(names), n[y]) + values[runs(rs[y], n[y])]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out[np.repeat(np.arange(lo, lo + len(x)), n[y])[known[at] == key]] = False
    return out
