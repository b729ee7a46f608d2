"""Average linkage of one group in one task, from its nodes' mean vectors.

The mean similarity of two groups is the product of their mean vectors, and that to a
merged group lies between those to its halves. So a node can keep a list of its nearest
nodes and a bound for all others through any merges: a merged node takes over both
lists and the mean of both bounds, and an entry of a list stands for what has become of
it. Where the best of a list is above the bound it is the nearest of all; only where it
is not, the node is compared with all others again. These comparisons are matrix
products in single precision, whose rounding is part of the bound; similarities that
decide are taken in double. Memory is that of the vectors and lists, and nothing is
left out: the merges are those of the one-by-one linkage.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Nearest nodes that a comparison with all keeps, entries of a list at most, rows and columns that are compared at once, the first columns, which give a bound, and rows whose lists are measured at once.
KEPT, WIDE, STRIP, COLUMNS, FIRST, ROWS = 16, 32, 512, 16384, 2048, 1024
#: Share of the nodes below which a round of merges gives way to a chain of nearest nodes.
FEW = 0.001

Merge = tuple[int, int, float, int]


class Kept:
    """The KEPT most similar of the columns shown so far, for each of some rows, and a bound for the others."""

    def __init__(self, rows: int):
        self.row, self.col, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.least, self.bound = np.full(rows, -1e30, np.float32), np.full(rows, -np.inf)

    def add(self, d: np.ndarray, ids: np.ndarray) -> None:
        """Shows similarities of the rows to the columns ids."""
        if not len(self.row) and d.shape[1] > KEPT:
            self.least = np.maximum(self.least, np.partition(d, d.shape[1] - KEPT, axis=1)[:, d.shape[1] - KEPT])
        flat = np.flatnonzero(d >= self.least[:, None])
        r, c = np.divmod(flat, d.shape[1])
        row, col, score = np.append(self.row, r), np.append(self.col, ids[c]), np.append(self.score, d.ravel()[flat])
        order = np.lexsort((-score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (place < KEPT) & (score > -1e30)
        last = keep & (place == KEPT - 1)
        self.least[row[last]] = self.bound[row[last]] = score[last]  # what goes is not above the last that stays
        self.row, self.col, self.score = row[keep], col[keep], score[keep]

    def lists(self, none: int) -> np.ndarray:
        out = np.full((len(self.least), KEPT), none, np.int64)
        out[self.row, np.arange(len(self.row)) - np.searchsorted(self.row, self.row)] = self.col
        return out


def nearest_lists(y: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes the KEPT most similar of all rows of y (or len(y), where there are fewer), and a bound for the others. The last column of y is a penalty."""
    n = len(y)
    out, bound = np.full((len(nodes), KEPT), n, np.int64), np.full(len(nodes), -np.inf)
    for s in range(0, len(nodes), STRIP):
        some = nodes[s : s + STRIP]
        a = y[some]
        a[:, -1] = 1
        kept = Kept(len(some))
        start, width = 0, min(FIRST, COLUMNS)
        while start < n:
            end = min(n, start + width)
            d = a @ y[start:end].T
            inside = np.flatnonzero((some >= start) & (some < end))
            d[inside, some[inside] - start] = -np.inf
            kept.add(d, np.arange(start, end))
            start, width = end, min(2 * width, COLUMNS)
        out[s : s + STRIP], bound[s : s + STRIP] = kept.lists(n), kept.bound
    return out, bound


class Linkage:
    """Nodes that merge; a merged node has the place of its first half. `tau`: nodes whose nearest is below it are closed."""

    def __init__(self, mean: np.ndarray, weight: np.ndarray, tau: float | None):
        n, d = mean.shape
        self.x = np.vstack([mean, np.zeros((1, d))]).astype(float)
        self.w = weight.astype(float)
        self.tau = -np.inf if tau is None else tau
        most = float((self.x * self.x).sum(1).max())
        self.penalty = np.float32(-4 * max(most, 1.0))
        self.slack = (d + 8) * 2.0**-23 * max(most, 1.0)
        self.name, self.next, self.out = np.arange(n), n, []
        self.lists = np.full((n, WIDE), n, np.int32)
        self.bound, self.best, self.near = np.full(n, -np.inf), np.full(n, -np.inf), np.full(n, n)
        self.sure = np.zeros(n + 1, bool)
        self._start(n)

    def _start(self, n: int) -> None:
        self.n = n
        self.root, self.alive = np.arange(n + 1), np.append(np.ones(n, bool), False)
        self.y = np.zeros((n, self.x.shape[1] + 1), np.float32)
        self.y[:, :-1] = self.x[:n]
        self.live = np.arange(n)

    def compact(self) -> None:
        """Forgets the places of nodes that are merged or closed."""
        keep, to = self.live, np.full(self.n + 1, len(self.live))
        to[keep] = np.arange(len(keep))
        self.lists = to[self.roots(self.lists[keep])].astype(np.int32)
        self.near, self.bound, self.best, self.w, self.name = to[self.near[keep]], self.bound[keep], self.best[keep], self.w[keep], self.name[keep]
        self.x, self.sure = self.x[np.append(keep, self.n)], self.sure[np.append(keep, self.n)]
        self._start(len(keep))

    def roots(self, e: np.ndarray) -> np.ndarray:
        e = self.root[e]
        while True:
            up = self.root[e]
            if np.array_equal(up, e):
                return e
            self.root[e], e = self.root[up], up

    def look(self, nodes: np.ndarray, lists: np.ndarray) -> None:
        """The nearest of nodes by their lists: sure where it is above the bound for the others."""
        n = self.n
        for s in range(0, len(nodes), ROWS):
            i = nodes[s : s + ROWS]
            e = np.sort(self.roots(lists[s : s + ROWS]), 1)
            twice = np.zeros(e.shape, bool)
            twice[:, 1:] = e[:, 1:] == e[:, :-1]
            e[twice | ~self.alive[e] | (e == i[:, None])] = n
            score = np.round(np.matmul(self.x[e], self.x[i][:, :, None])[:, :, 0], 12)
            score[e == n] = -np.inf
            if e.shape[1] > WIDE:
                order = np.argsort(-score, 1, kind="stable")
                e, score = np.take_along_axis(e, order, 1), np.take_along_axis(score, order, 1)
                self.bound[i] = np.maximum(self.bound[i], score[:, WIDE])
                e, score = e[:, :WIDE], score[:, :WIDE]
            self.lists[i, : e.shape[1]] = e
            self.lists[i, e.shape[1] :] = n
            at = score.argmax(1)
            k = np.arange(len(i))
            self.near[i], self.best[i] = e[k, at], score[k, at]
            self.sure[i] = self.best[i] > self.bound[i]

    def scan(self, nodes: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """The nearest of nodes by comparing them with all others, or from what such a comparison gave."""
        lists, bound = known or nearest_lists(self.y, nodes)
        self.bound[nodes] = bound + self.slack
        self.look(nodes, lists)
        left = nodes[~self.sure[nodes]]
        if self.tau > -np.inf:
            left = left[np.maximum(self.best[left], self.bound[left]) >= self.tau]
        for s in range(0, len(left), 64):  # ties, or nodes too close to the bound
            i = left[s : s + 64]
            score = np.round(self.x[i] @ self.x[: self.n].T, 12)
            score[:, ~self.alive[: self.n]] = -np.inf
            score[np.arange(len(i)), i] = -np.inf
            self.near[i], self.best[i], self.sure[i] = score.argmax(1), score.max(1), True

    def close(self, nodes: np.ndarray) -> None:
        """Nodes all of whose similarities are below tau never merge again."""
        if self.tau > -np.inf:
            over = nodes[np.maximum(self.best[nodes], np.where(self.sure[nodes], -np.inf, self.bound[nodes])) < self.tau]
            self.alive[over] = False
            self.y[over, -1] = self.penalty
            self.live = self.live[self.alive[self.live]]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges nodes a < b; returns the lists of both halves."""
        x, w = self.x, self.w
        wa, wb = w[a], w[b]
        score, size = (x[a] * x[b]).sum(1), wa + wb
        self.out += zip(self.name[a].tolist(), self.name[b].tolist(), score.tolist(), size.astype(int).tolist(), strict=True)
        x[a] = (x[a] * wa[:, None] + x[b] * wb[:, None]) / size[:, None]
        self.y[a, :-1] = x[a]
        self.y[b, -1] = self.penalty
        self.bound[a] = np.maximum(self.bound[a], self.bound[b]) if not np.isfinite(self.bound[a] + self.bound[b]).all() else (self.bound[a] * wa + self.bound[b] * wb) / size
        w[a] = size
        self.alive[b], self.root[b] = False, a
        self.name[a] = np.arange(self.next, self.next + len(a))
        self.next += len(a)
        return np.hstack([self.lists[a], self.lists[b]])

    def rounds(self, known: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Merges all nodes that are each other's nearest, round by round, until few are."""
        self.scan(self.live, known)
        fresh = self.live
        self.close(fresh)
        while True:
            f = fresh[self.alive[fresh] & self.sure[fresh]]
            m = self.near[f]
            both = (self.best[f] >= self.tau) & (self.best[f] > -np.inf) & self.sure[m] & self.alive[m] & (np.append(self.near, self.n)[m] == f)
            a, first = np.unique(np.minimum(f, m)[both], return_index=True)
            b = np.maximum(f, m)[both][first]
            if len(a) <= FEW * len(self.live):
                left = self.live[~self.sure[self.live]]
                if len(left) <= FEW * len(self.live):
                    return
                self.scan(left)
                self.close(left)
                fresh = np.union1d(f, left)
                continue
            lists = self.merge(a, b)
            self.live = self.live[self.alive[self.live]]
            changed = np.zeros(self.n + 1, bool)
            changed[a] = changed[b] = True
            self.look(a, lists)
            changed_near = self.live[changed[self.near[self.live]]]
            others = np.setdiff1d(changed_near, a, assume_unique=True)
            self.look(others, self.lists[others])
            fresh = np.append(a, others)
            self.close(fresh)
            if self.n > 2 * len(self.live):
                where = np.zeros(self.n + 1, bool)
                where[fresh] = True
                fresh = np.flatnonzero(where[self.live])
                self.compact()

    def chain(self) -> None:
        """Follows nearest nodes until two are each other's nearest; at most about three looks for each merge."""
        chain: list[int] = []
        while len(self.live) > 1:
            if self.n > 2 * len(self.live) + 64:
                to = np.searchsorted(self.live, chain)
                self.compact()
                chain = to.tolist()
            last = chain[-1] if chain else int(self.live[0])
            chain = chain or [last]
            one = np.array([last])
            if not self.sure[last]:
                self.look(one, self.lists[one])
                if not self.sure[last]:
                    self.scan(one)
            if len(chain) > 1 and self.best[chain[-2]] >= self.best[last]:
                a, b = sorted((chain.pop(), chain.pop()))
                lists = self.merge(np.array([a]), np.array([b]))
                self.live = np.delete(self.live, np.searchsorted(self.live, b))
                near = self.near[self.live]
                self.sure[self.live[(near == a) | (near == b)]] = False
                self.look(np.array([a]), lists)
            elif self.best[last] < self.tau or not self.sure[last]:
                self.alive[last] = False
                self.y[last, -1] = self.penalty
                self.live = np.delete(self.live, np.searchsorted(self.live, last))
                chain.pop()
            else:
                chain.append(int(self.near[last]))

    def absorb(self, least: int) -> None:
        """Joins the smallest node under `least` members (ties: the first) to the most similar one until none is left, or one node."""
        small = np.flatnonzero(self.w < least)
        self.bound[:] = np.inf  # of nodes that were not compared
        if len(small) and self.n > 1:
            self.scan(small)
        queue = [(self.w[i], i) for i in small.tolist()]
        heapq.heapify(queue)
        left = self.n
        while queue and left > 1:
            size, i = heapq.heappop(queue)
            if not self.alive[i] or self.w[i] != size:
                continue
            one = np.array([i])
            self.look(one, self.lists[one])
            if not self.sure[i]:
                self.scan(one)
            a, b = sorted((i, int(self.near[i])))
            lists = self.merge(np.array([a]), np.array([b]))
            left -= 1
            if self.w[a] < least:
                self.look(np.array([a]), lists)
                heapq.heappush(queue, (self.w[a], a))


def linkage(mean: np.ndarray, weight: np.ndarray, tau: float | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[Merge]:
    """The merges of the nodes by mean similarity, children before parents, with tau those that reach it; new nodes are numbered on. `known`: what nearest_lists() gives for all nodes."""
    nodes = Linkage(np.asarray(mean), np.asarray(weight), tau)
    if nodes.n > 1:
        nodes.rounds(known)
        nodes.chain()
    return nodes.out
