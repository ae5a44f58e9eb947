"""Minimum-weight perfect matching by the primal-dual blossom method.

Every vertex and every blossom (an odd cycle of tight edges, shrunk to one node)
carries a dual value. An edge is tight when its weight equals what its ends
offer, less the values of the blossoms that hold both. Alternating trees grow
from all unmatched nodes over tight edges: outer nodes give off edges, inner
ones are reached by unmatched edges. A tight edge between two trees augments
the matching; one within a tree closes a blossom. When nothing is tight, the
duals move by the least amount that makes something happen. Weights are
integers and doubled inside, so all duals stay integers and the result is exact.
"""

from __future__ import annotations

OUTER, INNER = 1, 2


class _Search:
    def __init__(self, n: int, edges: list[tuple[int, int, int]]):
        self.n, self.edges = n, [(a, b, 2 * w) for a, b, w in edges if a != b]
        least = min((w for _, _, w in self.edges), default=0)
        self.offer = [least // 2] * n  # of vertices
        self.value: dict[int, int] = {}  # of blossoms, by number from n on
        self.mate: list[int] = [-1] * n
        self.top = list(range(n))  # outermost node that holds a vertex
        self.base = {v: v for v in range(n)}
        self.ring: dict[int, list[int]] = {}  # nodes of a blossom in turn, from the one with its base
        self.links: dict[int, list[tuple[int, int]]] = {}  # vertex pairs that join each node of the ring to the next
        self.label: dict[int, int] = {}
        self.via: dict[int, tuple[int, int] | None] = {}  # (vertex outside, vertex inside) by which a node was reached
        self.fresh = n

    def leaves(self, x: int) -> list[int]:
        out, work = [], [x]
        while work:
            y = work.pop()
            if y < self.n:
                out.append(y)
            else:
                work += self.ring[y]
        return out

    def holder(self, b: int, v: int) -> int:
        """Place in the ring of blossom ``b`` of the node that holds ``v``."""
        return next(i for i, x in enumerate(self.ring[b]) if v in self.leaves(x))

    def reach(self, x: int, label: int, via: tuple[int, int] | None) -> None:
        """Label a node; behind an inner one its mate's node becomes outer."""
        while True:
            self.label[x], self.via[x] = label, via
            if label == OUTER:
                return
            at = self.base[x]
            x, label, via = self.top[self.mate[at]], OUTER, (at, self.mate[at])

    def to_root(self, v: int) -> list[int]:
        """Nodes from the one of ``v`` up its tree."""
        out, x = [], self.top[v]
        while True:
            out.append(x)
            if self.via[x] is None:
                return out
            x = self.top[self.via[x][0]]

    def shrink(self, u: int, v: int, meet: int) -> None:
        """Close the blossom of the tight edge u, v whose tree paths part at ``meet``."""
        down, down_links, x = [], [], self.top[u]
        while x != meet:
            down.append(x)
            down_links.append(self.via[x])
            x = self.top[self.via[x][0]]
        up, up_links, x = [], [], self.top[v]
        while x != meet:
            up.append(x)
            up_links.append(self.via[x][::-1])
            x = self.top[self.via[x][0]]
        b, self.fresh = self.fresh, self.fresh + 1
        self.ring[b], self.links[b] = [meet, *down[::-1], *up], [*down_links[::-1], (u, v), *up_links]
        self.base[b], self.value[b] = self.base[meet], 0
        self.label[b], self.via[b] = OUTER, self.via[meet]
        for x in self.ring[b]:
            del self.label[x], self.via[x]
        for x in self.leaves(b):
            self.top[x] = b

    def flip(self, b: int, v: int) -> None:
        """Turn the matching inside blossom ``b`` so that its base is ``v``."""
        work = [(b, v)]
        while work:
            b, v = work.pop()
            if b < self.n:
                continue
            ring, links = self.ring[b], self.links[b]
            at = i = self.holder(b, v)
            work.append((ring[i], v))
            while i:  # towards the old base: along the matched edge, then across an unmatched one, which becomes matched
                if i % 2:
                    (a, c), k, j = links[(i + 1) % len(ring)], (i + 1) % len(ring), (i + 2) % len(ring)
                else:
                    (c, a), k, j = links[i - 2], i - 1, i - 2
                work += [(ring[k], a), (ring[j], c)]
                self.mate[a], self.mate[c] = c, a
                i = j
            self.ring[b], self.links[b] = ring[at:] + ring[:at], links[at:] + links[:at]
            self.base[b] = v

    def augment(self, u: int, v: int) -> None:
        """Match u with v and turn the tree paths of both up to their roots."""
        for s, t in ((u, v), (v, u)):
            while True:
                x = self.top[s]
                self.flip(x, s)
                self.mate[s] = t
                self.base[x] = s
                if self.via[x] is None:
                    break
                inner = self.top[self.via[x][0]]
                s, t = self.via[inner]
                self.flip(inner, t)
                self.mate[t] = s
                self.base[inner] = t

    def open(self, b: int, relabel: bool) -> None:
        """Undo blossom ``b``; an inner one hands its place in the tree to the even side of its ring."""
        ring, links = self.ring.pop(b), self.links.pop(b)
        del self.value[b]
        for x in ring:
            for v in self.leaves(x):
                self.top[v] = x
        via = self.via.pop(b, None)
        self.label.pop(b, None)
        if not relabel:
            return
        for x in ring:
            self.label.pop(x, None)
            self.via.pop(x, None)
        i = ring.index(self.top[via[1]])
        step = 1 if i % 2 else -1
        self.label[ring[i]], self.via[ring[i]] = INNER, via
        outer = False
        while i:
            j = (i + step) % len(ring)
            edge = links[i] if step == 1 else links[j][::-1]
            outer = not outer
            self.label[ring[j]], self.via[ring[j]] = OUTER if outer else INNER, edge
            i = j

    def slack(self, e: tuple[int, int, int]) -> int:
        """Of an edge between two outermost nodes."""
        return e[2] - self.offer[e[0]] - self.offer[e[1]]

    def grow(self) -> bool:
        """Use tight edges while there are any; true once the matching has grown."""
        moved = True
        while moved:
            moved = False
            for e in self.edges:
                u, v, _ = e
                a, b = self.top[u], self.top[v]
                if a == b or self.slack(e):
                    continue
                if self.label.get(a) != OUTER:
                    u, v, a, b = v, u, b, a
                if self.label.get(a) != OUTER or self.label.get(b) == INNER:
                    continue
                moved = True
                if b not in self.label:
                    self.reach(b, INNER, (u, v))
                    continue
                mine, other = self.to_root(u), self.to_root(v)
                if mine[-1] != other[-1]:
                    self.augment(u, v)
                    return True
                shared = set(other)
                self.shrink(u, v, next(x for x in mine if x in shared))
        return False

    def shift(self) -> bool:
        """Move the duals until an edge turns tight or an inner blossom is used up; false if nothing bounds them."""
        found = []
        for e in self.edges:
            a, b = self.label.get(self.top[e[0]]), self.label.get(self.top[e[1]])
            if self.top[e[0]] != self.top[e[1]] and OUTER in (a, b) and INNER not in (a, b):
                found.append(self.slack(e) // 2 if a == b else self.slack(e))
        found += [z // 2 for b, z in self.value.items() if self.label.get(b) == INNER]
        if not found:
            return False
        by = min(found)
        for v in range(self.n):
            of = self.label.get(self.top[v])
            self.offer[v] += by if of == OUTER else -by if of == INNER else 0
        for b in list(self.value):
            of = self.label.get(b)
            self.value[b] += 2 * by if of == OUTER else -2 * by if of == INNER else 0
            if of == INNER and not self.value[b]:
                self.open(b, True)
        return True

    def solve(self) -> list[int] | None:
        while True:
            self.label, self.via = {}, {}
            free = sorted({self.top[v] for v in range(self.n) if self.mate[v] < 0})
            if not free:
                return self.mate
            for x in free:
                self.reach(x, OUTER, None)
            while not self.grow():
                if not self.shift():
                    return None
            for b in sorted(self.value, reverse=True):
                if not self.value.get(b, 1) and self.is_top(b):
                    self.open(b, False)

    def is_top(self, b: int) -> bool:
        return self.top[self.leaves(b)[0]] == b


def minimum_matching(n: int, edges: list[tuple[int, int, int]]) -> list[int] | None:
    """Partner of each of ``n`` nodes in a perfect matching of least total weight, or None where no perfect one exists.

    ``edges`` are (node, node, whole weight); of parallel ones the lightest counts, loops are left out.
    """
    return None if n % 2 else _Search(n, edges).solve()
