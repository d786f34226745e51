"""Upserts, priorities, latest rows and incremental work, without a table format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the order (an aggregate, so hot keys combine before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; columns that only one side has are NULL on the other."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """As upsert(), but the given columns keep the old value where the new one is NULL."""
    rest = [c for c in new.columns if c not in keys]
    o, n = old.select(*keys, F.struct(*rest).alias("o")), new.select(*keys, F.struct(*rest).alias("n"))
    both = n.join(o, keys, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in kept else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in rest))


def sync_status(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """added, changed, unchanged or missing for each key of two snapshots."""
    both = new.select(*keys, F.col(content).alias("_n"), F.lit(1).alias("_in")).join(old.select(*keys, F.col(content).alias("_o"), F.lit(1).alias("_io")), keys, "full")
    return both.select(*keys, F.when(F.col("_io").isNull(), "added").when(F.col("_in").isNull(), "missing").when(F.col("_n").eqNullSafe(F.col("_o")), "unchanged").otherwise("changed").alias("status"))


def priority_merge(rows: DataFrame, keys: list[str], rank: Column, first_even_null: list[str], first_known: list[str]) -> DataFrame:
    """One row for each key: some columns from the best source even if NULL, others from the best that has them."""
    ranked = rows.withColumn("_rank", rank)
    plain = [F.min_by(F.struct(*first_even_null), "_rank").alias("_p")] if first_even_null else []
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in first_known]
    out = ranked.groupBy(*keys).agg(*plain, *known)
    return out.select(*keys, *(F.col(f"_p.{c}").alias(c) for c in first_even_null), *first_known)


def not_done(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key was not tried yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def join_views(ranked: DataFrame, flights: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Full join of a ranked list with each key's latest row of another view, and how many rows that one supersedes."""
    rest = [c for c in flights.columns if c != key]
    newest = flights.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count("*") - 1).alias("superseded")).select(key, "r.*", "superseded")
    return ranked.join(newest, key, "full")


def one_per(rows: DataFrame, keys: list[str], priority: list[Column]) -> DataFrame:
    """The first row of each key by priority."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))).where("_rn = 1").drop("_rn")
