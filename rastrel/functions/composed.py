"""Kernels that come with digital filters: what is reconstructed is first (or, when it shrinks, afterwards) filtered."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rastrel.functions.bands import filtered, inverted
from rastrel.functions.filters import sampled
from rastrel.functions.kernels import Kernel, kernel

Taps = tuple[tuple[int, float], ...]
DELTA: Taps = ((0, 1.0),)


@dataclass(frozen=True)
class Composed:
    """A generator with a filter (fir) and one whose inverse is applied (ifir)."""

    generator: Kernel
    fir: Taps = DELTA
    ifir: Taps = DELTA

    @property
    def name(self) -> str:
        parts = [self.generator.name, *("fir" for _ in (1,) if self.fir != DELTA), *("ifir^-1" for _ in (1,) if self.ifir != DELTA)]
        return "*".join(parts)

    @property
    def support(self) -> int:
        return self.generator.support

    @property
    def normalize(self) -> bool:
        return self.generator.normalize

    def cardinal(self, length: int = 100, eps: float = 1e-3) -> Cardinal:
        """The kernel that this is without its filters: their response to a single one, as far as it is over eps, laid
        over the generator."""
        line = np.zeros((1, length))
        line[0, length // 2] = 1.0
        answer = inverted(filtered(line, self.fir), self.ifir)[0]
        far = np.abs(np.flatnonzero(np.abs(answer) > eps) - length // 2).max(initial=0)
        return Cardinal(self.generator, tuple((k, float(answer[length // 2 + k])) for k in range(-far, far + 1)))


@dataclass(frozen=True)
class Cardinal:
    """A sum of shifted generators, to be used as a Kernel is where a kernel of wide support is no hindrance."""

    generator: Kernel
    weights: Taps

    @property
    def name(self) -> str:
        return f"cardinal {self.generator.name}"

    @cached_property
    def support(self) -> int:
        return self.generator.support + 2 * max(k for k, _ in self.weights)

    @property
    def normalize(self) -> bool:
        return self.generator.normalize

    def value(self, r: Column) -> Column:
        out = F.lit(0.0)
        for k, w in self.weights:
            out = out + F.lit(w) * self.generator.value(r - k)
        return out

    def at(self, r: np.ndarray) -> np.ndarray:
        r = np.asarray(r, float)
        return sum(w * self.generator.at(r - k) for k, w in self.weights)


def simple(name: str) -> Composed:
    """A kernel without filters."""
    return Composed(kernel(name))


def generalized(fir: list[tuple[int, float]], ifir: list[tuple[int, float]], name: str) -> Composed:
    return Composed(kernel(name), tuple(fir), tuple(ifir))


def interpolating(name: str) -> Composed:
    """The kernel with the inverse of its own samples: what it reconstructs goes through the values."""
    return Composed(kernel(name), DELTA, tuple(sampled(name)))
