"""Tables against their model: typed and defaulted columns, broken rules, repeated keys, orphans, row security.

All checks are plans over whole tables: row rules are expressions, keys one aggregation, references one anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loppis.schemas import DISTINCT, NOT_DISTINCT, PARTIAL, Key, Reference, Table

from .writes import cascade_delete, set_null_on_delete


def conform(df: DataFrame, model: Table) -> DataFrame:
    """The model's columns in its order and types.

    A column that is missing gets its default, or null; a null that was given stays null. Values that don't fit the type
    become null. Further columns fall away.
    """

    def one(f) -> Column:
        if f.name not in df.columns:
            return F.lit(model.defaults.get(f.name)).cast(f.dataType).alias(f.name)
        have = df.schema[f.name].dataType
        return (F.col(f.name) if have == f.dataType else F.col(f.name).try_cast(f.dataType)).alias(f.name)

    return df.select(*map(one, model.schema.fields))


def row_rules(model: Table) -> dict[str, Column]:
    """Name and test of each rule that a single row can break; a test is true where the row breaks it.

    As in SQL, an enumeration or a range holds for null; only a missing value of a required column is broken by it.
    """
    rules = {f"{f.name} is missing": F.col(f.name).isNull() for f in model.schema.fields if not f.nullable}
    rules |= {f"{c} is none of its values": ~F.col(c).isin(*values) for c, values in model.enums.items()}
    rules |= {f"{c} is out of range": ~F.col(c).between(low, high) for c, (low, high) in model.ranges.items()}
    return rules


def with_broken(df: DataFrame, model: Table) -> DataFrame:
    """df with `broken`: the names of the rules that a row breaks, in the model's order."""
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in row_rules(model).items()])))


def valid(df: DataFrame, model: Table) -> DataFrame:
    """Rows that break no rule of their own."""
    broken = reduce(lambda x, y: x | y, [F.coalesce(t, F.lit(False)) for t in row_rules(model).values()], F.lit(False))
    return df.filter(~broken)


def repeated_keys(df: DataFrame, key: Key) -> DataFrame:
    """The key's columns and `n` of those values that more than one row has, as the key treats nulls."""
    rows = df
    if key.nulls == DISTINCT:
        rows = df.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in key.columns]))
    elif key.nulls == PARTIAL:
        # rows outside the partial index don't count; inside it a null never conflicts
        rows = df.filter(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in {*key.where, *key.columns}]))
    elif key.nulls != NOT_DISTINCT:
        raise ValueError(f"unknown treatment of nulls: {key.nulls}")
    return rows.groupBy(*key.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, ref: Reference) -> DataFrame:
    """Children whose reference leads nowhere; a null reference is none."""
    there = parents.select(F.col(ref.key).alias("_parent")).distinct()
    return children.filter(F.col(ref.column).isNotNull()).join(there, F.col(ref.column) == F.col("_parent"), "left_anti")


def report(tables: dict[str, DataFrame], models: dict[str, Table]) -> DataFrame:
    """(table, rule, n): how many rows break each row rule, how many values repeat under each key, and how many rows are
    orphans of each reference whose parent table is given. Rules that nothing breaks have no row.

    Row rules of a table take one pass over it.
    """
    found = []
    for name, df in tables.items():
        model = models[name]
        rules = with_broken(df, model).select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
        found.append(rules.select(F.lit(name).alias("table"), "rule", "n"))
        for key in model.keys:
            n = repeated_keys(df, key).agg(F.count(F.lit(1)).alias("n"))
            found.append(n.select(F.lit(name).alias("table"), F.lit(f"{', '.join(key.columns)} repeats").alias("rule"), "n"))
        for ref in model.references:
            if ref.table in tables:
                n = orphans(df, tables[ref.table], ref).agg(F.count(F.lit(1)).alias("n"))
                found.append(n.select(F.lit(name).alias("table"), F.lit(f"{ref.column} is in no {ref.table}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found).filter("n > 0")


def delete_parents(name: str, gone: DataFrame, tables: dict[str, DataFrame], models: dict[str, Table]) -> dict[str, DataFrame]:
    """All tables after the rows of `name` with the keys in `gone` are deleted: rows that refer to a deleted row go, in turn
    with their own children, or lose the reference, as their model says. A restricted reference keeps its parent.

    gone: the key column of `name`. Tables refer to each other without cycles, but for a table that refers to itself, whose
    rows lose the reference.
    """
    out = dict(tables)
    key = next(iter(gone.columns))
    going = gone.distinct()
    held = [(n, r) for n, m in models.items() if n in tables for r in m.references if r.table == name]
    for n, ref in held:
        if ref.on_delete == "restrict":
            going = going.join(tables[n].select(F.col(ref.column).alias(key)).distinct(), key, "left_anti")
    left = tables[name].join(going, key, "left_anti")
    out[name] = left
    for n, ref in held:
        if ref.on_delete == "set null":
            out[n] = set_null_on_delete(out[n], left, ref.column, ref.key)
        elif ref.on_delete == "cascade" and n != name:
            before = out[n]
            kept = cascade_delete(before, left, ref.column, ref.key)
            further = [r for m in models.values() for r in m.references if r.table == n]
            if further and "id" in before.columns:
                lost = before.select("id").join(kept.select("id"), "id", "left_anti")
                out = delete_parents(n, lost, out, models)
            else:
                out[n] = kept
    return out


# --- row security -----------------------------------------------------------------------------------------------------


def own_rows(df: DataFrame, user: Column, owner: str = "user_id") -> DataFrame:
    """Rows that the user owns; without a user there are none."""
    return df.filter(F.col(owner) == user)


def visible_pairs(rows: DataFrame, owners: DataFrame, column: str, key: str = "id", owner: str = "user_id") -> DataFrame:
    """rows with `viewer`: each user sees the rows that refer to a parent of theirs. A row without a parent is seen by none."""
    return rows.join(owners.select(F.col(key).alias("_key"), F.col(owner).alias("viewer")), F.col(column) == F.col("_key")).drop("_key")


def visible_to(rows: DataFrame, owners: DataFrame, column: str, user: Column, key: str = "id", owner: str = "user_id") -> DataFrame:
    """Rows that refer to a parent of the user's."""
    return rows.join(owners.filter(F.col(owner) == user).select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_semi")


def admin_pairs(rows: DataFrame, preferences: DataFrame) -> DataFrame:
    """rows with `viewer`: every administrator sees every row. Administrators are few; their number is checked before they
    are sent to all tasks, and beyond 10000 of them the call is refused."""
    admins = preferences.filter("is_admin").select(F.col("user_id").alias("viewer")).distinct()
    names = [r.viewer for r in admins.limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more administrators than rows can be repeated for")
    kind = preferences.schema["user_id"].dataType
    return rows.withColumn("viewer", F.explode(F.array(*map(F.lit, names)).cast(f"array<{kind.simpleString()}>")))
