"""The scope guard: a request sees its own scope and the global one, nothing else."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE_TYPES = ("GLOBAL", "VERTICAL", "ENTITY", "CLIENT", "PROJECT", "SANDBOX")
# Levels of sensitivity from the least.
TIERS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "CLIENT_CONFIDENTIAL", "SECRET")
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}\Z")


def parse_scope(text: str) -> tuple[str, str]:
    """'TYPE:id' -> (type, id); the global scope has the id GLOBAL and no other scope has."""
    kind, _, name = text.partition(":")
    kind, name = kind.upper(), name or ("GLOBAL" if kind.upper() == "GLOBAL" else "")
    if kind not in SCOPE_TYPES or not _ID.match(name) or (kind == "GLOBAL") != (name == "GLOBAL"):
        raise ValueError("not a scope")
    return kind, name


def valid_scope(kind: Column, name: Column) -> Column:
    return kind.isin(*SCOPE_TYPES) & name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}\z") & ((kind == "GLOBAL") == (name == "GLOBAL"))


def visible(spark: SparkSession, scope: str, include_global: bool = True) -> DataFrame:
    """(scope_type, scope_id): one or two rows."""
    own = parse_scope(scope)
    rows = {own} | ({("GLOBAL", "GLOBAL")} if include_global else set())
    return spark.createDataFrame(sorted(rows), "scope_type string, scope_id string")


def guard(rows: DataFrame, scope: str, include_global: bool = True) -> DataFrame:
    """The rows that the scope may see; a row whose scope cannot be read is not admitted. The filter is pushed to the scan."""
    own = parse_scope(scope)
    allowed = {own} | ({("GLOBAL", "GLOBAL")} if include_global else set())
    seen = F.lit(False)
    for kind, name in sorted(allowed):
        seen = seen | ((F.col("scope_type") == kind) & (F.col("scope_id") == name))
    return rows.where(F.coalesce(seen, F.lit(False)))


def guard_by(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """As guard, for a relation of visible scopes: a broadcast semi join of one or two rows."""
    return rows.join(F.broadcast(allowed), ["scope_type", "scope_id"], "left_semi")


def tier(nested: Column | None = None, flat: Column | None = None) -> Column:
    """A row's sensitivity, INTERNAL where it has no label."""
    return F.coalesce(*[c for c in (nested, flat) if c is not None], F.lit("INTERNAL"))


def not_secret(level: Column) -> Column:
    return F.coalesce(level, F.lit("INTERNAL")) != "SECRET"


def highest_tier(level: Column) -> Column:
    """Aggregate: the highest sensitivity tier."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), level)
    return F.max_by(level, rank)


def about_entity(rows: DataFrame, entity: str) -> DataFrame:
    """Rows about an entity, rows of the global scope and rows without a subject."""
    told = lambda c: F.coalesce(c, F.lit(False))
    keep = told(F.col("scope_type") == "GLOBAL") | F.col("subject_entity_id").isNull()
    for c in ("subject_entity_id", "object_entity_id"):
        if c in rows.columns:
            keep = keep | told(F.col(c) == entity)
    return rows.where(keep)
