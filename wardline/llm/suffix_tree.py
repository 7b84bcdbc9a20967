"""Suffix trees by Ukkonen's construction, and the longest common extension of two positions in constant time.

The tree's Euler tour is kept as string depths. The depth of the lowest common ancestor of two leaves is the least depth between their places in
the tour, found from a sparse table over tour blocks and the running minima inside blocks. Memory is linear; queries come as numpy arrays.
"""

from __future__ import annotations

import numpy as np

TOUR_BLOCK = 32


def _grown(s: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Ukkonen, left to right. ``s`` ends with a symbol found nowhere else in it. Per node (0 is the root): where its edge begins and ends in ``s`` and its
    parent; and the nodes that are leaves, in the order of their suffixes."""
    size, open_end = max(s) + 1, len(s)
    begin, end, link, parent, leaves = [0], [0], [0], [0], []
    child: dict[int, int] = {}  # node * size + first symbol of the edge
    node = at = along = waiting = 0  # the active point: ``along`` symbols down the edge that starts with s[at]
    for i, symbol in enumerate(s):
        waiting, fresh = waiting + 1, 0
        while waiting:
            if not along:
                at = i
            slot = node * size + s[at]
            below = child.get(slot)
            if below is None:
                child[slot] = new = len(begin)
                owner = node
            else:
                span = end[below] - begin[below]
                if along >= span and end[below] <= i:  # walk down a whole edge
                    node, at, along = below, at + span, along - span
                    continue
                here = begin[below] + along
                if s[here] == symbol:
                    along += 1
                    if fresh:
                        link[fresh] = node
                    break
                owner = len(begin)
                begin.append(begin[below])
                end.append(here)
                link.append(0)
                parent.append(node)
                child[slot] = owner
                begin[below], parent[below] = here, owner
                child[owner * size + s[here]] = below
                new = len(begin)
                child[owner * size + symbol] = new
            begin.append(i)
            end.append(open_end)
            link.append(0)
            parent.append(owner)
            leaves.append(new)
            if fresh:
                link[fresh] = owner
            fresh = owner if owner != node else 0
            waiting -= 1
            if node:
                node = link[node]
            elif along:
                along -= 1
                at = i - waiting + 1
    return begin, end, parent, leaves


class SuffixTree:
    """Of a list of positive integers."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        begin, end, parent, leaves = _grown(s)
        begin, end, parent = (np.array(x, np.int64) for x in (begin, end, parent))
        nodes, text = len(begin), np.array(s, np.int64)
        # children of a node next to each other, by the first symbol of their edges
        order = np.lexsort((text[begin[1:]], parent[1:])) + 1
        first = np.searchsorted(parent[order], np.arange(nodes + 1)).tolist()
        order, parents, spans = order.tolist(), parent.tolist(), (end - begin).tolist()
        depth, tour, seen = [0] * nodes, [], [0] * nodes
        pending = first[:nodes]  # the next child to visit
        node = 0
        while True:
            tour.append(depth[node])
            k = pending[node]
            if k < first[node + 1]:
                pending[node] = k + 1
                below = order[k]
                depth[below] = depth[node] + spans[below]
                seen[below] = len(tour)
                node = below
            elif node:
                node = parents[node]
            else:
                break
        #: Where each suffix, the empty one last, stands in the tour; smaller suffixes stand further left.
        self.place = np.array(seen, np.int64)[np.array(leaves, np.int64)]
        self._index(np.array(tour, np.int32))

    def _index(self, tour: np.ndarray) -> None:
        blocks = -(-len(tour) // TOUR_BLOCK)
        grid = np.full((blocks, TOUR_BLOCK), np.iinfo(np.int32).max, np.int32)
        grid.ravel()[:len(tour)] = tour
        self._tour = grid.ravel()
        self._upto = np.minimum.accumulate(grid, axis=1).ravel()
        self._after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self._table = [grid.min(axis=1)]
        while 2 << (len(self._table) - 1) <= blocks:
            half, last = 1 << (len(self._table) - 1), self._table[-1]
            self._table.append(np.minimum(last[:-half], last[half:]))

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from the different positions ``a`` and ``b`` on agree; a position may be the end."""
        x, y = self.place[a], self.place[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // TOUR_BLOCK, y // TOUR_BLOCK
        out = np.minimum(self._after[x], self._upto[y])
        gap = q - p - 1
        wide = np.flatnonzero(gap > 0)
        if len(wide):
            level = np.frexp(gap[wide].astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                w = wide[level == k]
                out[w] = np.minimum(out[w], np.minimum(self._table[k][p[w] + 1], self._table[k][q[w] - (1 << k)]))
        same = np.flatnonzero(gap < 0)
        if len(same):
            least, at, upto = self._tour[x[same]], x[same], y[same]
            for step in range(1, TOUR_BLOCK):
                least = np.minimum(least, self._tour[np.minimum(at + step, upto)])
            out[same] = least
        return out.astype(np.int64)
