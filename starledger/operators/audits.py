"""Audits of a whole schema: functional dependencies and foreign keys.

Both turn the rows of all tables into small key rows, reduce them on the map side and meet once, dependencies
by (rule, key), foreign keys edge by edge: no join, and a hot key collapses before it is sent.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dependency:
    """In ``table``, ``key`` determines ``carried``."""

    name: str
    table: DataFrame
    key: tuple[str, ...]
    carried: str


@dataclass(frozen=True)
class Edge:
    """Each ``columns`` of ``child`` occurs as ``parent_columns`` of ``parent`` (the same names by default)."""

    name: str
    child: DataFrame
    parent: DataFrame
    columns: tuple[str, ...]
    parent_columns: tuple[str, ...] | None = None


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def _stacked(table: DataFrame, structs: list[Column]) -> DataFrame:
    return table.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def dependency_violations(rules: Sequence[Dependency]) -> DataFrame:
    """(dependency, key_value, row_count): keys that carry more than one value, null being one.

    The least and the greatest hash of the carried values of a key differ exactly if the values do. Rows
    without a key are left to the null audit.
    """
    tables = {id(r.table): r.table for r in rules}
    parts = []
    for t, table in tables.items():  # each table is read once for all its rules
        mine = [r for r in rules if id(r.table) == t]
        structs = [
            F.struct(F.lit(r.name).alias("dependency"), _key(r.key).alias("key_value"), F.xxhash64(r.carried).alias("_h"), F.array_contains(F.array(*(F.col(c).isNull() for c in r.key)), True).alias("_none"))
            for r in mine
        ]
        parts.append(_stacked(table, structs).where(~F.col("_none")).drop("_none"))
    rows = functools.reduce(DataFrame.unionByName, parts)
    seen = rows.groupBy("dependency", "key_value").agg(F.min("_h").alias("_least"), F.max("_h").alias("_greatest"), F.count(F.lit(1)).alias("row_count"))
    return seen.where("_least <> _greatest").select("dependency", "key_value", "row_count")


def _edge_orphans(edge: Edge) -> DataFrame:
    """Columns of one type, or of integers, are compared as such: rows of a fixed width, as text only where a key
    is reported. Others are compared as text."""
    columns, parent_columns = edge.columns, edge.parent_columns or edge.columns
    kinds = [(edge.child.schema[c].dataType, edge.parent.schema[p].dataType) for c, p in zip(columns, parent_columns, strict=True)]
    typed = [a == b or isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType) for a, b in kinds]
    names = [f"_k{i}" for i in range(len(columns))]

    def keys(table: DataFrame, of: Sequence[str], parent: int) -> DataFrame:
        return table.select(*((F.col(c) if t else F.col(c).cast("string")).alias(n) for c, t, n in zip(of, typed, names)), F.lit(parent).alias("_parent"))

    rows = keys(edge.child, columns, 0).union(keys(edge.parent, parent_columns, 1).dropna(subset=names))
    met = rows.groupBy(*names).agg(F.max("_parent").alias("_parent"), F.count_if(F.col("_parent") == 0).alias("row_count"))
    return met.where("_parent = 0").select(F.lit(edge.name).alias("edge"), _key(names).alias("key_value"), "row_count")


def orphans(edges: Sequence[Edge]) -> DataFrame:
    """(edge, key_value, row_count): child keys without a parent, and the rows that an inner join drops.

    A null in a key joins nothing, so such a key is an orphan; its nulls show as empty.
    """
    return functools.reduce(DataFrame.unionByName, map(_edge_orphans, edges))
