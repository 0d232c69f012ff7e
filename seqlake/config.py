"""Which seeds are taken from a sequence."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

MODES = ("kmers", "modimizers", "minimizers", "findere")
SCHEMES = ("open-closed-mod", "hashed")


@dataclass(frozen=True)
class SeedConfig:
    """Seed extraction; the same for an index and for what searches it.

    kmers takes every window of ``k`` bases, modimizers those whose hash is
    divisible by ``divisor``, minimizers one window of ``m`` bases out of
    every ``k``, findere windows of ``k - z`` bases that z + 1 consecutive
    hits put together again.
    """

    mode: str = "kmers"
    k: int = 31
    m: int | None = None
    z: int = 10
    divisor: int = 16
    scheme: str = "open-closed-mod"
    seed: int = 69
    homopolymer: bool = False
    pattern: str | None = None
    strobes: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.mode in MODES, f"mode is one of {', '.join(MODES)}")
        need(self.scheme in SCHEMES, f"scheme is one of {', '.join(SCHEMES)}")
        need(self.k >= 1, "k is at least 1")
        need((self.m is not None) == (self.mode == "minimizers"), "m goes with minimizers, and only with them")
        if self.mode == "minimizers":
            need(1 <= self.m <= min(self.k, 31), "m is at most k and 31")
            need(self.scheme == "hashed" or self.k % 2 == 1 and self.k <= 255, "this scheme takes an odd k of at most 255")
            need(self.scheme == "open-closed-mod" or (self.k - self.m) % 2 == 0 or self.m % 2 == 1, "m or the window is odd")
        if self.mode == "modimizers":
            need(self.divisor >= 1 and self.k <= 32, "divisor is at least 1 and k at most 32")
        if self.mode == "findere":
            need(0 <= self.z < self.k, "z is less than k")
        if self.pattern is not None:
            need(self.mode in ("kmers", "minimizers"), "patterns go with kmers or minimizers")
            need(re.fullmatch("[#_]+", self.pattern) is not None and "#" in self.pattern, "a pattern is made of # and _")
            need(self.pattern == self.pattern[::-1], "a pattern is symmetric")
            need(len(self.pattern) == self.length <= 31, "a pattern is as wide as the seed, 31 at most")
        if self.strobes is not None:
            need(self.mode in ("kmers", "minimizers") and self.length <= 32, "strobes go with kmers or minimizers of up to 32 bases")
            need(1 <= self.strobes[0] <= self.strobes[1], "distances go from 1 up")

    @property
    def length(self) -> int:
        """Bases in an indexed window."""
        return self.m if self.mode == "minimizers" else self.k - self.z if self.mode == "findere" else self.k

    @property
    def kept(self) -> list[int]:
        """Places of the window that count."""
        return [i for i, c in enumerate(self.pattern) if c == "#"] if self.pattern else list(range(self.length))

    def with_strobes(self, least: int | None = None, most: int | None = None) -> SeedConfig:
        """Linked pairs; by default from one to three window lengths apart."""
        return replace(self, strobes=(least or self.length, most or 3 * self.length))
