"""Discrete schemas and workloads of attribute sets."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, combinations
from math import prod

from pyspark.sql.types import IntegerType, StructField, StructType

Clique = tuple[str, ...]


@dataclass(frozen=True)
class Domain:
    """Ordered attributes with their numbers of codes; a code of attribute a lies in 0 .. size - 1."""

    attrs: tuple[str, ...]
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "attrs", tuple(self.attrs))
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if len(self.attrs) != len(self.shape):
            raise ValueError("each attribute needs one size")
        if len(set(self.attrs)) != len(self.attrs):
            raise ValueError("attributes must differ")

    @classmethod
    def fromdict(cls, config: dict[str, int]) -> Domain:
        return cls(tuple(config), tuple(config.values()))

    @property
    def config(self) -> dict[str, int]:
        return dict(zip(self.attrs, self.shape, strict=True))

    def project(self, attrs: str | Iterable[str]) -> Domain:
        """The schema of ``attrs``, in the order asked for."""
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        return Domain(attrs, tuple(self[a] for a in attrs))

    def marginalize(self, attrs: Iterable[str]) -> Domain:
        return self.project(self.invert(attrs))

    def invert(self, attrs: Iterable[str]) -> Clique:
        """Attributes that are not listed."""
        gone = {attrs} if isinstance(attrs, str) else set(attrs)
        return tuple(a for a in self.attrs if a not in gone)

    def axes(self, attrs: Iterable[str]) -> tuple[int, ...]:
        return tuple(self.attrs.index(a) for a in attrs)

    def transpose(self, attrs: Iterable[str]) -> Domain:
        return self.project(attrs)

    def merge(self, other: Domain) -> Domain:
        """Both schemas, this one's attributes first; shared attributes must agree in size."""
        for a in other.attrs:
            if a in self and self[a] != other[a]:
                raise ValueError(f"{a} has two sizes")
        return Domain(self.attrs + other.invert(self.attrs), self.shape + tuple(other[a] for a in other.invert(self.attrs)))

    def contains(self, other: Domain) -> bool:
        return set(other.attrs) <= set(self.attrs)

    def size(self, attrs: Iterable[str] | None = None) -> int:
        """Number of cells over ``attrs`` (all of them by default)."""
        return prod(self.shape if attrs is None else self.project(attrs).shape)

    def sort(self, how: str = "size") -> Domain:
        if how not in ("size", "name"):
            raise ValueError("sort by 'size' or 'name'")
        return self.project(sorted(self.attrs, key=self.__getitem__ if how == "size" else str))

    def canonical(self, attrs: Iterable[str]) -> Clique:
        """``attrs`` in this schema's order."""
        wanted = set(attrs)
        return tuple(a for a in self.attrs if a in wanted)

    def strides(self) -> tuple[int, ...]:
        """What a step of each attribute adds to the row-major cell number."""
        return tuple(prod(self.shape[i + 1 :]) for i in range(len(self.shape)))

    def struct(self) -> StructType:
        """Spark schema of coded rows; sizes are kept in the fields' metadata."""
        return StructType([StructField(a, IntegerType(), False, {"size": n}) for a, n in self.config.items()])

    @classmethod
    def from_struct(cls, schema: StructType) -> Domain:
        return cls.fromdict({f.name: f.metadata["size"] for f in schema if "size" in (f.metadata or {})})

    def __contains__(self, attr: object) -> bool:
        return attr in self.attrs

    def __getitem__(self, attr: str) -> int:
        try:
            return self.shape[self.attrs.index(attr)]
        except ValueError:
            raise KeyError(attr) from None

    def __iter__(self) -> Iterator[str]:
        return iter(self.attrs)

    def __len__(self) -> int:
        return len(self.attrs)

    def __str__(self) -> str:
        return f"Domain({', '.join(f'{a}: {n}' for a, n in self.config.items())})"


def powerset(items: Iterable[str]) -> list[Clique]:
    """All subsets but the empty one, small ones first."""
    items = list(items)
    return list(chain.from_iterable(combinations(items, k) for k in range(1, len(items) + 1)))


def downward_closure(workload: Iterable[Sequence[str]]) -> list[Clique]:
    """Every non-empty subset of every clique, once, by length and then by name."""
    found = {tuple(sorted(s)) for w in workload for s in powerset(w)}
    return sorted(found, key=lambda c: (len(c), c))


def all_kway(domain: Domain, degree: int, n_marginals: int | None = None, seed: int = 0) -> list[Clique]:
    """All cliques of ``degree`` attributes, or ``n_marginals`` of them drawn without replacement."""
    every = list(combinations(domain.attrs, degree))
    if n_marginals is None or n_marginals >= len(every):
        return every
    return sorted(random.Random(seed).sample(every, n_marginals), key=every.index)


def containing(cliques: Iterable[Sequence[str]], attrs: Iterable[str], domain: Domain) -> Clique | None:
    """The smallest clique (by cells, then in order) that holds all ``attrs``; None if there is none."""
    wanted = set(attrs)
    fits = [tuple(c) for c in cliques if wanted <= set(c)]
    return min(fits, key=domain.size) if fits else None


def workload_scores(workload: Iterable[Sequence[str]], weights: dict[Clique, float] | None = None) -> dict[Clique, float]:
    """For each clique of the closure: how many attributes it shares with the workload's cliques in total."""
    workload = [tuple(w) for w in workload]
    weights = weights or {}
    return {c: sum(weights.get(w, 1.0) * len(set(c) & set(w)) for w in workload) for c in downward_closure(workload)}
