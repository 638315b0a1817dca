"""Links between the sets of one unit, by dual traversal of a signature tree.

A leaf holds a few sets, an inner node a few children. Every node has the OR of the token bitmaps below it, the range of set
sizes, and the largest excess: elements of a set beyond the set bits of its bitmap. For sets a below node A and b below B

    |a & b| <= min(popcount(A & B) + min(excess A, excess B), largest size in A, largest size in B),

and a linked pair needs |a & b| >= threshold / (1 + threshold) * (|a| + |b|), at least that for the smallest sizes. Pairs of nodes
that cannot reach it are dropped with all below them; pairs of sets that pass their own bound are compared exactly.

Only connections are asked for, so pairs of nodes or sets that earlier links have connected already are passed over: a group
of copies of one text costs about one comparison a member, and yields one link a member.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
FAN = 8
LEAST_BITS = 512
MOST_BITS = 1 << 16
PAIRS_AT_ONCE = 128
BITMAP_BYTES = 64 << 20


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], percent: int):
        """``sets``: sorted distinct hashes, none empty; linked if 100 * intersection >= percent * union."""
        self.percent = percent
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.sets = [sets[i] for i in order]
        maps, pop = bitmaps(self.sets)
        size = np.array([len(s) for s in self.sets], dtype="int64")
        self.build(np.array(order), maps, size, size - pop, np.arange(len(sets)))

    def build(self, order: np.ndarray, maps: np.ndarray, size: np.ndarray, excess: np.ndarray, root: np.ndarray) -> None:
        """Nodes over rows in tree order; ``order`` has their places in the given list, ``root`` what is connected already."""
        self.order, self.maps, self.size, self.excess, self.root = order, maps, size, excess, root
        self.links: list[tuple[int, int]] = []
        # levels[0] are the leaves; a level holds (bitmaps, least size, largest size, largest excess).
        self.levels = []
        level = (self.maps, self.size, self.size, self.excess)
        fan = LEAF
        while True:
            starts = np.arange(0, len(level[1]), fan)
            level = (
                np.bitwise_or.reduceat(level[0], starts, axis=0),
                np.minimum.reduceat(level[1], starts),
                np.maximum.reduceat(level[2], starts),
                np.maximum.reduceat(level[3], starts),
            )
            self.levels.append(level)
            if len(starts) == 1:
                break
            fan = FAN

    def possible(self, level: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level may hold a linked pair."""
        maps, least, largest, excess = level
        out = np.zeros(len(a), dtype=bool)
        step = max(1, BITMAP_BYTES // (8 * maps.shape[1]))
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            # The ratio of sizes first, then the bitmaps of what is left.
            near = (100 * largest[x] >= self.percent * least[y]) & (100 * largest[y] >= self.percent * least[x])
            x, y = x[near], y[near]
            common = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype="int64") + np.minimum(excess[x], excess[y])
            common = np.minimum(common, np.minimum(largest[x], largest[y]))
            out[i + np.flatnonzero(near)] = (100 + self.percent) * common >= self.percent * (least[x] + least[y])
        return out

    def connect(self) -> list[tuple[int, int]]:
        """Links that connect what is connected, as positions in the given list."""
        a = b = np.zeros(1, dtype="int64")
        for depth in range(len(self.levels) - 1, -1, -1):
            keep = self.possible(self.levels[depth], a, b)
            a, b = a[keep], b[keep]
            if depth:
                below = len(self.levels[depth - 1][1])
                child = np.arange(FAN)
                x = (a[:, None, None] * FAN + child[:, None] + 0 * child).ravel()
                y = (b[:, None, None] * FAN + child + 0 * child[:, None]).ravel()
                keep = (x <= y) & (y < below)
                a, b = x[keep], y[keep]
        # Neighbours first: near copies are neighbours mostly, and what they connect is passed over later.
        nearest = np.argsort(b - a, kind="stable")
        a, b = a[nearest], b[nearest]
        bounds = np.arange(0, len(self.size), LEAF)
        leaf = (self.maps, self.size, self.size, self.excess)
        for i in range(0, len(a), PAIRS_AT_ONCE):
            low, high = np.minimum.reduceat(self.root, bounds), np.maximum.reduceat(self.root, bounds)
            x, y = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
            joined = (low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y])
            x, y = x[~joined], y[~joined]
            at = np.arange(LEAF)
            p = (x[:, None, None] * LEAF + at[:, None] + 0 * at).ravel()
            q = (y[:, None, None] * LEAF + at + 0 * at[:, None]).ravel()
            keep = (p < q) & (q < len(self.size))
            p, q = p[keep], q[keep]
            keep = self.root[p] != self.root[q]
            p, q = p[keep], q[keep]
            keep = self.possible(leaf, p, q)
            for j, k in zip(p[keep].tolist(), q[keep].tolist(), strict=True):
                if self.root[j] != self.root[k] and self.linked(j, k):
                    self.links.append((int(self.order[j]), int(self.order[k])))
                    self.root[self.root == self.root[k]] = self.root[j]
        return self.links

    def linked(self, j: int, k: int) -> bool:
        """The exact comparison of two sets that may be linked."""
        s, t = self.sets[j], self.sets[k]
        both = len(s) + len(t)
        common = both - len(np.unique(np.concatenate([s, t])))
        return 100 * common >= self.percent * (both - common)


def bitmaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap per set (64-bit words) of about four bits per element of the largest, and the number of bits set."""
    largest = max(len(s) for s in sets)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * largest - 1).bit_length()))
    while bits > LEAST_BITS and bits // 8 * len(sets) > BITMAP_BYTES:
        bits //= 2
    maps = np.zeros((len(sets), bits // 8), dtype="uint8")
    for row, s in zip(maps, sets, strict=True):
        at = (s & np.uint64(bits - 1)).astype("int64")
        flags = np.zeros(bits, dtype="uint8")
        flags[at] = 1
        row[:] = np.packbits(flags)
    maps = maps.view("uint64")
    return maps, np.bitwise_count(maps).sum(axis=1, dtype="int64")


# ---- sketches: the bitmap of one set, small enough to travel instead of it


class SketchTree(SignatureTree):
    """Connects sets that their sketches cannot tell apart from linked ones."""

    def __init__(self, least: list[int], size: list[int], maps: list[bytes], percent: int, known: list[int]):
        """``least``: smallest hash of each set; ``known``: sets of equal value are connected already."""
        self.percent = percent
        order = np.lexsort((np.array(size), np.array(least)))
        widest = max(len(m) for m in maps)
        rows = np.frombuffer(b"".join(widened(maps[i], widest) for i in order), "uint64").reshape(len(maps), -1)
        sizes = np.array(size, dtype="int64")[order]
        pop = np.array([int.from_bytes(maps[i]).bit_count() for i in order], dtype="int64")
        self.build(order, rows, sizes, sizes - pop, np.unique(known, return_inverse=True)[1][order])

    def linked(self, j: int, k: int) -> bool:
        return True


def sketch(s: np.ndarray) -> bytes:
    """The bitmap of a set: two to four bits per element."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    flags = np.zeros(bits, dtype="uint8")
    flags[(s & np.uint64(bits - 1)).astype("int64")] = 1
    return np.packbits(flags).tobytes()


def widened(data: bytes, size: int) -> bytes:
    """A sketch repeated to the width of a larger one: a superset of the bits its set would have there."""
    return data * (size // len(data))


def may_link(x: int, a: bytes, y: int, b: bytes, percent: int) -> bool:
    """Whether sets of x and y elements with sketches a and b can be linked."""
    spare = min(x - int.from_bytes(a).bit_count(), y - int.from_bytes(b).bit_count())
    size = max(len(a), len(b))
    common = (int.from_bytes(widened(a, size)) & int.from_bytes(widened(b, size))).bit_count()
    return (100 + percent) * min(common + spare, x, y) >= percent * (x + y)


def connect_sketches(least: list[int], size: list[int], maps: list[bytes], percent: int, known: list[int]) -> list[tuple[int, int]]:
    """Pairs that connect all sets whose sketches may be linked, beyond what is ``known``: a tree, or a leaf if there are few."""
    if len(size) > LEAF:
        return SketchTree(least, size, maps, percent, known).connect()
    root, links = list(known), []
    for j in range(len(size)):
        for k in range(j):
            if root[j] != root[k] and may_link(size[j], maps[j], size[k], maps[k], percent):
                links.append((j, k))
                old = root[k]
                root = [root[j] if r == old else r for r in root]
    return links
