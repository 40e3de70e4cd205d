"""Reads of the company graph: liveness, search, ordered lists, guards and envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(df: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.where(~F.col("deleted"))


def public(df: DataFrame) -> DataFrame:
    """Contributions that anyone may see: active and approved."""
    return active(df).where("status = 'Approved'")


def matching(df: DataFrame, term: str | None, *columns: str, contains: bool = False) -> DataFrame:
    """Case-blind search in any of the columns, by prefix or anywhere. A blank term filters nothing; % and _ act as wildcards."""
    if not term or not term.strip():
        return df
    pattern = ("%" if contains else "") + term.strip() + "%"
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(pattern), F.lit(False)) for c in columns)))


def year_or_name(df: DataFrame, term: str, year: str, name: str) -> DataFrame:
    """A whole number matches the year or the name, anything else the name."""
    by_name = F.col(name).ilike(f"%{term.strip()}%")
    return df.where((F.col(year) == int(term)) | by_name if term.strip().isdigit() else by_name)


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def unreferenced(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that no active child names: those that may be deleted."""
    return parents.join(active(children).select(F.col(key).alias("id")), "id", "left_anti")


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of null or blank fields, in the given order."""
    blank = [F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(n)) for n, c in fields.items()]
    return F.array_compact(F.array(*blank))


def nested(children: DataFrame, key: str, ident: str, name: str) -> DataFrame:
    """(key, refs): shallow references (id, name) to a parent's children, in order of id."""
    return children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ident).alias("id"), F.col(name).alias("name")))).alias("refs"))
