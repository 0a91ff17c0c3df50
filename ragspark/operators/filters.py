"""Predicates over metadata: filter specifications, clearance, vocabularies, floors, tenants, lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: clearance ladder and vocabularies
LEVELS = ("Public", "Internal", "Restricted", "Confidential")
DEPARTMENTS = ("HR", "Engineering", "Finance", "Legal", "Product")
OFFICES = ("Montreal", "Paris", "Casablanca")
SILOS = ("hr-policies", "technical-docs", "financial-reports", "legal-contracts", "product-catalog", "release-notes-tickets")
DOCUMENT_TYPES = ("Policy", "ADR", "Runbook", "Reference", "Report", "Contract", "Specification", "ReleaseNote", "Ticket")
YEARS = (2000, 2100)

_COMPARE = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v}


def compiled(spec: Mapping | bool) -> Column:
    """A filter specification as a Column, which Catalyst pushes into scans.

    {"and": [..]}, {"or": [..]}, {"eq"|"ne"|"lt"|"le"|"gt"|"ge": [column, value]}, {"in": [column, values]},
    {"null": column}, True for everything. eq and ne with None test for null; nulls in an IN list are ignored."""
    if spec is True:
        return F.lit(True)
    if not isinstance(spec, Mapping) or len(spec) != 1:
        raise ValueError(f"not a filter: {spec!r}")
    (kind, value), = spec.items()
    if kind in ("and", "or"):
        parts = [compiled(s) for s in value]
        out = F.lit(kind == "and")
        for p in parts:
            out = out & p if kind == "and" else out | p
        return out
    if kind == "null":
        return F.col(value).isNull()
    column, operand = F.col(value[0]), value[1]
    if kind == "in":
        return column.isin([v for v in operand if v is not None])
    if kind in ("eq", "ne") and operand is None:
        return column.isNull() if kind == "eq" else column.isNotNull()
    if kind in _COMPARE:
        return _COMPARE[kind](column, operand)
    raise ValueError(f"unknown filter {kind!r}")


def odata(spec: Mapping | bool) -> str | None:
    """A filter specification as OData text, or None where it has no such form (in), as the caller then filters hits itself."""
    if isinstance(spec, bool):
        return "true" if spec else "false"
    (kind, value), = spec.items()
    if kind in ("and", "or"):
        parts = [odata(s) for s in value]
        if None in parts or not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = f"({out} {kind} {p})"
        return out
    if kind == "null":
        return f"{value} eq null"
    if kind not in _COMPARE:
        return None
    field, v = value
    said = "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{field} {kind} {said}"


def within_clearance(clearance: str, office: str | None = None, silo: str | None = None) -> Column:
    """Rows up to a clearance; an unknown clearance sees Public only, an unknown label is never seen."""
    allowed = LEVELS[: LEVELS.index(clearance) + 1] if clearance in LEVELS else LEVELS[:1]
    out = F.col("confidentiality").isin(*allowed)
    if office is not None:
        out = out & (F.col("office") == office)
    return out if silo is None else out & (F.col("silo") == silo)


def level(label: Column) -> Column:
    """Place in the ladder of a label, trimmed and in any case; unknown labels count as Confidential."""
    known = F.lower(F.trim(label))
    out = F.lit(len(LEVELS) - 1)
    for i, name in reversed(list(enumerate(LEVELS))):
        out = F.when(known == name.lower(), i).otherwise(out)
    return out


def cleaned(column: Column, vocabulary) -> Column:
    return F.when(column.isin(*vocabulary), column)


def cleaned_year(column: Column) -> Column:
    return F.when(column.between(*YEARS), column)


def floored(hits: DataFrame, least: float) -> DataFrame:
    """Hits scoring ``least`` or more; no floor when it is 0 or less. Applied after a limit, so fewer may stay."""
    return hits.where(F.col("score") >= least) if least > 0 else hits


def guarded(hits: DataFrame, owners: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(kept, incidents): hits whose chunk the authoritative table gives to ``tenant``, and the others."""
    joined = hits.join(owners.select("chunk_id", F.col("tenant").alias("_owner")), "chunk_id", "left")
    own = F.coalesce(F.col("_owner") == tenant, F.lit(False))
    return joined.where(own).drop("_owner"), joined.where(~own).select("chunk_id", F.coalesce("_owner", F.lit("unknown")).alias("owner"))


def behind_boundary(hits: DataFrame, visible: Column, k: int) -> DataFrame:
    """Takes k (held to 1..25) hits a query, then drops what may not be seen: fewer than k may stay."""
    return hits.where(F.col("rank") <= max(1, min(25, k))).where(visible)


def by_id(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")
