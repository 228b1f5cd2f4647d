"""Checks of parameters: on the driver for one call, as columns for tables of calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions import text as T
from tarnwick.functions import urls as U

TIME_RANGES = ("day", "week", "month", "year")
MOST = {"num_results": 10, "max_urls": 50, "max_pages": 20, "urls": 20}


def query(raw: Column) -> Column:
    """The trimmed query, or null where none is left (the call is refused)."""
    return F.nullif(F.btrim(raw, F.lit(" \t\r\n")), F.lit(""))


def positive(name: str, value: Column, most: int) -> Column:
    """What is wrong with a count, or null."""
    return F.when(value < 1, f"{name} must be >= 1").when(value > most, f"{name} must be <= {most}")


def url(raw: Column) -> Column:
    """The trimmed url if it may be fetched: http or https, a host, and no local or reserved target."""
    u = F.trim(raw)
    host = U.authority_host(u)
    return F.when(u.rlike(r"^https?://[^/?#]+") & (host != "") & ~U.ip_blocked(host), u)


def time_range(raw: Column) -> tuple[Column, Column]:
    """(value or null, whether the call is refused)."""
    v = F.lower(T.coerce_optional(raw))
    return F.when(v.isin(*TIME_RANGES), v), F.coalesce(~v.isin(*TIME_RANGES), F.lit(False))


def since(now: Column, value: Column) -> Column:
    """The first moment of a time range; null is no limit."""
    out = None
    for name in TIME_RANGES:
        at = now - F.expr(f"interval 1 {name}")
        out = F.when(value == name, at) if out is None else out.when(value == name, at)
    return out


def domains(raw: Column) -> tuple[Column, Column]:
    """(distinct canonical domains in order, whether one of them isn't bare)."""
    v = F.array_distinct(F.filter(F.transform(raw, U.canonical_host), lambda d: d.isNotNull() & (d != "")))
    return v, F.exists(v, lambda d: F.contains(d, F.lit("/")))


def globs(raw: Column) -> tuple[Column, Column]:
    """(trimmed patterns that aren't blank, whether all of some were blank)."""
    v = F.filter(F.transform(raw, lambda g: F.trim(g)), lambda g: g != "")
    return v, (F.size(raw) > 0) & (F.size(v) == 0)


def chunk_ids(raw: Column) -> Column:
    """Whether all ids are zero or more."""
    return F.forall(raw, lambda i: i >= 0)
