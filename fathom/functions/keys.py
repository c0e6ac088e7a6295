"""Model keys ``arch--alg--code[--graph]`` and small lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "--"


def encode(*parts: Column) -> Column:
    return F.concat_ws(SEP, *parts)


def decode(key: Column, names: Sequence[str] = ("architecture", "algorithm", "implementation", "graph")) -> list[Column]:
    """One column per part; a part that the key lacks is null."""
    p = F.split(key, SEP)
    return [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names)]


def suffix(archs: Sequence[str], algs: Sequence[str], codes: Sequence[str], known: Mapping[str, Sequence[str]]) -> str:
    """File suffix; a set that covers everything known is written ``all_<kind>``."""
    tag = lambda kind, xs: f"all_{kind}" if set(xs) >= set(known[kind]) else "_".join(sorted(xs))
    return SEP.join(tag(k, xs) for k, xs in (("archs", archs), ("algs", algs), ("codes", codes)))


def recode(c: Column, table: Mapping[str, str]) -> Column:
    """Map lookup of a few fixed names; others stay."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else None
    return c if m is None else F.coalesce(F.try_element_at(m, c), c)


def rank_in(c: Column, order: Sequence[str]) -> Column:
    """Position in a fixed display order, null for other values."""
    p = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(p > 0, p)
