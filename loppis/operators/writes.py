"""Writes as table-to-table rewrites: upserts, inserts, updates, deletes, patches, cascades and exports.

Every rewrite is total and deterministic: ties are broken by the order that the caller gives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order. Null keys form one group."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def rest_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The rows that first_by does not keep."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn > 1").drop("_rn")


def dedup_rows(df: DataFrame, keys: list[str], order: list[Column], nulls_distinct: bool = True) -> DataFrame:
    """First row of each key; with nulls_distinct rows that have a null in the key never conflict and all stay."""
    if not nulls_distinct:
        return first_by(df, keys, order)
    has_null = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    return first_by(df.filter(~has_null), keys, order).unionByName(df.filter(has_null))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], nulls_distinct: bool = True) -> DataFrame:
    """Inserts new rows and updates the supplied columns of existing ones; columns that new lacks keep their value.

    new is reduced to one row a key by the order. Supplied nulls overwrite.
    """
    one = dedup_rows(new, keys, order, nulls_distinct)
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), one.withColumn("_new", F.lit(True)).alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") if nulls_distinct else F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.join(n, reduce(lambda x, y: x & y, same), "full_outer")
    cols = []
    for c in old.columns:
        if c in one.columns:
            cols.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return joined.select(*cols)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], nulls_distinct: bool = True) -> DataFrame:
    """old with those rows of new whose key is not there yet; the first of equal new ones."""
    one = dedup_rows(new, keys, order, nulls_distinct)
    return old.unionByName(_anti(one, old, keys, nulls_distinct), allowMissingColumns=True)


def _anti(rows: DataFrame, there: DataFrame, keys: list[str], nulls_distinct: bool) -> DataFrame:
    k = there.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
    test = reduce(lambda x, y: x & y, [(F.col(c) == F.col(f"_k_{c}")) if nulls_distinct else F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return rows.join(k, test, "left_anti")


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns where the predicate holds; null predicates change nothing."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def patch(df: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Three-state patches: patches has (key, <field>, <field>_op) with op keep, clear or set; only listed fields."""
    p = patches.select(key, *[F.col(f).alias(f"_v_{f}") for f in fields], *[F.col(f"{f}_op").alias(f"_o_{f}") for f in fields])
    out = df.join(p, key, "left")
    for f in fields:
        op = F.coalesce(F.col(f"_o_{f}"), F.lit("keep"))
        out = out.withColumn(f, F.when(op == "set", F.col(f"_v_{f}")).when(op == "keep", F.col(f)))
    return out.select(*df.columns)


def cascade_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there; children without a reference stay."""
    p = parents.select(F.col(parent_key).alias("_p")).distinct()
    kept = children.join(p, F.col(child_key) == F.col("_p"), "left_semi")
    return kept.unionByName(children.filter(F.col(child_key).isNull()))


def set_null_on_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children with references to lost parents set to null."""
    p = parents.select(F.col(parent_key).alias("_p")).distinct()
    joined = children.join(p, F.col(child_key) == F.col("_p"), "left")
    return joined.withColumn(child_key, F.col("_p")).select(*children.columns)


def with_default(df: DataFrame, column: str, default: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), default))


def append(df: DataFrame, path: str) -> None:
    """Append-only snapshots."""
    df.write.mode("append").parquet(path)


def replace_all(df: DataFrame, path: str) -> None:
    """Full replacement of a table."""
    df.write.mode("overwrite").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
