"""A cover tree over one tile of integer vectors, for inner products.

Every vector gets one more component that brings all to the same norm, which
makes large inner products small distances and leaves products with a query
(whose own extra component is 0) as they are.  For a node with center p and
covering radius r, every product q.c below it lies within |q| r of q.p.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

#: Mean rows below a lowest node.
LEAF = 32
#: Ratio of the radii of neighbouring levels.
BASE = 1.3
#: Norm up to which vectors are multiplied in doubles; two such products stay far below 2**53.
PLAIN_NORM = 2.0 ** 24
LONG_MAX = 2 ** 63 - 1


def quantise(flat: np.ndarray, lengths: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as whole doubles, one vector a row, short ones filled up with zeros."""
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    with np.errstate(over="ignore"):
        whole = np.nan_to_num(np.floor(flat * scale))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = whole
    return out


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(np.einsum("ij,ij->i", x, x))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q in whole numbers of any size, held at the ends of a long."""
    width = min(x.shape[1], len(q))
    mine = [int(v) for v in q[:width]]
    sums = [sum(int(a) * b for a, b in zip(row, mine) if a and b) for row in x[:, :width].tolist()]
    return np.array([max(-LONG_MAX - 1, min(LONG_MAX, s)) for s in sums], object)


class CoverTree:
    """Rows of at most ``PLAIN_NORM`` in a tree, larger ones in a list beside it.

    Centers are found farthest first, so those at least r apart cover all
    rows within r, whatever r is: each level of the tree is a prefix of them.
    A level's radius is ``BASE`` times smaller than the one's above it; a
    center's parent is the nearest center of the level above.  The radii kept
    are the largest true distances, which are at most the levels' own sums.
    """

    def __init__(self, row: np.ndarray, ident: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.labels, code = np.unique(label, return_inverse=True)
        length = norms(x)
        plain = length <= PLAIN_NORM
        self.large = tuple(a[~plain] for a in (row, ident, code, x))
        x, length = x[plain], length[plain]
        self.center, self.level_radius = np.zeros(0, np.int64), []
        order = np.arange(len(x))
        if len(x):
            wide = np.c_[x, np.sqrt(np.maximum(length.max() ** 2 - length ** 2, 0.0))]
            order = self._grow(wide)
            self.centers = x[self.chosen]
        self.row, self.ident, self.code = (a[plain][order] for a in (row, ident, code))
        self.x = x[order]

    def _grow(self, wide: np.ndarray) -> np.ndarray:
        """Build the nodes; returns the rows in the order of the lowest nodes."""
        n = len(wide)

        def distance(i: int) -> np.ndarray:
            return norms(wide - wide[i])

        chosen, gap = [int(np.argmin(norms(wide - wide.mean(0))))], [np.inf]
        near, owner = distance(chosen[0]), np.zeros(n, np.int64)
        while len(chosen) < max(1, n // LEAF) and near.max() > 0:
            far = int(near.argmax())
            gap.append(float(near[far]))
            d = distance(far)
            owner[d < near] = len(chosen)
            near = np.minimum(near, d)
            chosen.append(far)
        self.chosen, gaps = np.array(chosen), np.array(gap)
        sizes, radius = [1], float(gaps[1]) if len(gaps) > 1 else 0.0
        self.level_radius.append(radius)
        while sizes[-1] < len(chosen):
            radius /= BASE
            if (more := int((gaps > radius).sum())) > sizes[-1]:
                sizes.append(more)
                self.level_radius.append(radius)
        # each center's parent on the level above, then each row's ancestor on every level
        parents = []
        for above, size in zip(sizes, sizes[1:]):
            own = np.arange(size)
            for j in range(above, size):
                own[j] = int(norms(wide[self.chosen[:above]] - wide[self.chosen[j]]).argmin())
            parents.append(own)
        ancestors = [owner]
        for own in reversed(parents):
            ancestors.insert(0, own[ancestors[0]])
        center, radii, kids, place = [], [], [], np.array([0])
        for k, size in enumerate(sizes):
            if k:  # children stand together, in the order of their parents
                order = np.argsort(place[parents[k - 1]], kind="stable")
                place = np.empty(size, np.int64)
                place[order] = np.arange(size)
            else:
                order = np.array([0])
            r = np.zeros(size)
            np.maximum.at(r, ancestors[k], norms(wide - wide[self.chosen[ancestors[k]]]))
            center.append(order)
            radii.append(r[order])
            below = ancestors[k] if k + 1 == len(sizes) else parents[k]
            kids.append(np.r_[0, np.cumsum(np.bincount(below, minlength=size)[order])])
        starts = np.r_[0, np.cumsum(sizes)]
        self.leaves = int(starts[-2])  # nodes from here on hold rows, kids are row numbers there
        self.center, self.radius = np.concatenate(center), np.concatenate(radii)
        self.first = np.concatenate([k[:-1] + (starts[i + 1] if i + 1 < len(sizes) else 0) for i, k in enumerate(kids)])
        self.last = np.concatenate([k[1:] + (starts[i + 1] if i + 1 < len(sizes) else 0) for i, k in enumerate(kids)])
        return np.argsort(place[owner], kind="stable")

    def search(self, best: "Best", q: np.ndarray, length: float, me: int, label: str, same: bool) -> None:
        """Bring ``best`` up to date with the rows of this tile of the same or of other labels.

        Nodes are taken best first, by the largest product that may be below
        them and inside a window; those wholly outside all windows (as far as
        they are not filled with better rows) are skipped, rows are verified.
        """
        mine = np.flatnonzero(self.labels == label)
        if not len(mine) if same else len(mine) == len(self.labels):
            return
        code = int(mine[0]) if len(mine) else -1

        def verify(row, ident, codes, score):
            ok = ((codes == code) == same) & (row != me)
            best.add(score[ok], ident[ok])

        if len(self.large[0]):
            verify(*self.large[:3], exact(self.large[3], q))
        if not len(self.x):
            return
        if length > PLAIN_NORM:
            return verify(self.row, self.ident, self.code, exact(self.x, q))
        width = min(self.x.shape[1], len(q))
        q = q[:width]
        at_center = (self.centers[:, :width] @ q)[self.center]
        slack = length * self.radius * (1 + 1e-9) + 1e-3
        low, high = at_center - slack, at_center + slack
        heap = [(-high[0], 0)]
        while heap:
            bound, node = heappop(heap)
            if not best.may_hold(low[node], -bound).any():
                continue
            a, b = self.first[node], self.last[node]
            if node < self.leaves:
                for kid in (np.flatnonzero(best.may_hold(low[a:b], high[a:b])) + a).tolist():
                    heappush(heap, (-high[kid], kid))
            else:
                verify(self.row[a:b], self.ident[a:b], self.code[a:b], (self.x[a:b, :width] @ q).astype(np.int64))


class Best:
    """For each window [low, high] of scores the ``k`` best (score, id), higher scores and then smaller ids first."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.k = k
        held = [[max(-LONG_MAX - 1, min(LONG_MAX, x)) for x in w] for w in windows]
        ends = np.array(held, np.int64).reshape(-1, 2)
        self.need, self.top = ends[:, :1].copy(), ends[:, 1:].copy()
        self.lists: list[list[tuple[int, int]]] = [[] for _ in windows]

    def may_hold(self, low, high) -> np.ndarray:
        """Whether rows of products between ``low`` and ``high`` may enter a window's list."""
        return ((np.atleast_1d(high) >= self.need) & (np.atleast_1d(low) <= self.top)).any(0)

    def add(self, score: np.ndarray, ident: np.ndarray) -> None:
        inside = (score >= self.need) & (score <= self.top)
        for j in np.flatnonzero(inside.any(1)).tolist():
            held = self.lists[j]
            at = np.flatnonzero(inside[j])
            if len(held) == self.k:  # of scores equal to the last one's only smaller ids
                at = at[(score[at] > -held[-1][0]) | (ident[at] < held[-1][1])]
            if len(at) > self.k:
                order = sorted(at.tolist(), key=lambda i: (-int(score[i]), ident[i]))
                at = np.array(order[:self.k])
            held = sorted(held + [(-int(score[i]), int(ident[i])) for i in at.tolist()])[:self.k]
            self.lists[j] = held
            if len(held) == self.k:
                self.need[j, 0] = max(self.need[j, 0], -held[-1][0])
