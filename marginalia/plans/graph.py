"""Elimination orders and junction trees (E15-E24, U04, U07). A model has tens of attributes, so this is driver work."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence
from functools import cached_property

from marginalia.plans.schema import Clique, Domain


class DisjointSets:
    """Union-find over any hashable items."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> bool:
        """Join the sets of a and b; whether they were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        return a != b

    def connected(self, a, b) -> bool:
        return self.find(a) == self.find(b)


def adjacency(domain: Domain, cliques: Iterable[Sequence[str]]) -> dict[str, set[str]]:
    """Which attributes share a clique."""
    near: dict[str, set[str]] = {a: set() for a in domain}
    for c in cliques:
        for a in c:
            near[a] |= set(c) - {a}
    return near


def elimination_order(domain: Domain, cliques: Iterable[Sequence[str]], elim: Iterable[str] | None = None, rng: random.Random | None = None) -> list[str]:
    """Eliminate, each time, the attribute whose neighbourhood has the fewest cells (first in schema order on ties).

    With ``rng`` the choice is random, by softmax of minus the log of the cells: half the cells, twice as likely.
    """
    near, order = adjacency(domain, cliques), []
    left = list(domain.canonical(elim if elim is not None else domain.attrs))
    while left:
        cost = {a: domain.size({a} | near[a]) for a in left}
        if rng is None:
            pick = min(left, key=cost.__getitem__)
        else:
            pick = rng.choices(left, [min(cost.values()) / cost[a] for a in left])[0]
        for a in near[pick]:
            near[a] |= near[pick] - {a}
            near[a].discard(pick)
        del near[pick]
        left.remove(pick)
        order.append(pick)
    return order


def triangulate(domain: Domain, cliques: Iterable[Sequence[str]], order: Sequence[str]) -> tuple[list[Clique], int]:
    """The cliques that eliminating in ``order`` makes, without those inside another; and their total cells."""
    near, made, total = adjacency(domain, cliques), [], 0
    for a in order:
        bag = {a} | near[a]
        total += domain.size(bag)
        made.append(bag)
        for b in near[a]:
            near[b] |= near[a] - {b}
            near[b].discard(a)
        del near[a]
    maximal = [b for i, b in enumerate(made) if not any(b < c or (b == c and j < i) for j, c in enumerate(made) if j != i)]
    return [domain.canonical(b) for b in maximal], total


class JunctionTree:
    """A tree of maximal cliques in which the cliques of each attribute are connected."""

    def __init__(self, domain: Domain, cliques: Iterable[Sequence[str]], order: Sequence[str] | int | None = None, seed: int = 0) -> None:
        self.domain, self.given = domain, [tuple(c) for c in cliques]
        if order is None or isinstance(order, int):
            tried = [elimination_order(domain, self.given)]
            rng = random.Random(seed)
            tried += [elimination_order(domain, self.given, rng=rng) for _ in range(order or 0)]
            order = min(tried, key=lambda o: triangulate(domain, self.given, o)[1])
        self.order = list(order)
        self.cliques, self.cost = triangulate(domain, self.given, self.order)
        pairs = [(-len(set(a) & set(b)), i, j) for i, a in enumerate(self.cliques) for j, b in enumerate(self.cliques) if i < j]
        sets = DisjointSets()  # a spanning tree of greatest separators is a junction tree
        self.edges = [(self.cliques[i], self.cliques[j]) for _, i, j in sorted(pairs) if sets.union(i, j)]

    def size(self) -> int:
        """Cells of all cliques."""
        return sum(map(self.domain.size, self.cliques))

    @cached_property
    def neighbors(self) -> dict[Clique, list[Clique]]:
        out: dict[Clique, list[Clique]] = {c: [] for c in self.cliques}
        for a, b in self.edges:
            out[a].append(b)
            out[b].append(a)
        return out

    @cached_property
    def separators(self) -> dict[tuple[Clique, Clique], Clique]:
        """Shared attributes of each directed edge, in schema order."""
        return {e: self.domain.canonical(set(e[0]) & set(e[1])) for a, b in self.edges for e in ((a, b), (b, a))}

    @cached_property
    def message_order(self) -> list[tuple[Clique, Clique]]:
        """Directed edges, each after all messages into its sender from other neighbours: leaves to root, then back."""
        seen, up = {self.cliques[0]}, []
        stack = [self.cliques[0]]
        while stack:
            here = stack.pop()
            for c in self.neighbors[here]:
                if c not in seen:
                    seen.add(c)
                    up.append((c, here))
                    stack.append(c)
        return up[::-1] + [(b, a) for a, b in up]

    @cached_property
    def preorder(self) -> list[Clique]:
        """Depth-first from the first clique."""
        return [self.cliques[0]] + [a for a, _ in self.message_order[: len(self.edges)][::-1]]

    def path(self, start: Clique, end: Clique) -> list[Clique]:
        """The cliques from ``start`` to ``end`` along the tree."""
        before, stack = {start: start}, [start]
        while stack:
            here = stack.pop()
            for c in self.neighbors[here]:
                if c not in before:
                    before[c] = here
                    stack.append(c)
        out = [end]
        while out[-1] != start:
            out.append(before[out[-1]])
        return out[::-1]
