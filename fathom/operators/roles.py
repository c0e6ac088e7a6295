"""Variable roles of a measurement frame, from its column names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

KEYS = {"architecture", "algorithm", "implementation", "graph", "iteration"}


@dataclass(frozen=True)
class Roles:
    all: list[str]
    index: list[str]
    data: list[str]
    platform: list[str]
    responses: list[str]
    predictors: list[str]
    loads: list[str]
    stores: list[str]
    stalls: list[str]
    has_cycles: bool

    @property
    def response(self) -> str:
        return next(c for c in self.data if c.lower() == ("cycles" if self.has_cycles else "time"))


def roles(columns: Iterable[str], common: Iterable[str] | None = None, drop_instructions: bool = False) -> Roles:
    """``common``: columns that every architecture has; the rest of the data columns are the platform's own."""
    cols = list(columns)
    pick = lambda pattern: [c for c in cols if re.match(pattern, c, re.I)]
    index = [c for c in cols if c.lower() in KEYS]
    data = [c for c in cols if c not in index]
    named = {c.lower() for c in cols}
    responses = [c for c in data if c.lower() in ("time", "cycles")]
    out = {"time", "cycles", "vertices", "iteration"} | ({"instructions"} if drop_instructions else set())
    return Roles(cols, index, data, [c for c in data if common is not None and c not in set(common)], responses, [c for c in data if c.lower() not in out], pick("loads"), pick("stores"), pick(r"stalls?[._]"), "cycles" in named)


def common_columns(frames: Iterable[Iterable[str]]) -> list[str]:
    """Names that all have, in the first one's order."""
    first, *rest = map(list, frames)
    return [c for c in first if all(c in r for r in rest)]


def all_columns(frames: Iterable[Iterable[str]]) -> list[str]:
    return list(dict.fromkeys(c for f in frames for c in f))
