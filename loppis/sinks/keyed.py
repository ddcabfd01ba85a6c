"""A keyed table in a folder of Parquet files, changed in place.

Rows are dealt to buckets, a folder each, by a hash of some key columns (`deal`, all of the key by default). A change first
writes its own rows, reduced to one a key, to the shared folder; then it reads only those buckets that these rows fall into
and overwrites only these. New keys alone are appended and nothing is rewritten. So a change costs what it touches, however
large the table is. What reaches the driver are numbers of buckets, at most `buckets` of them.

Rows of a large bucket are spread over tasks as they are written, so one hot value of `deal` does not make a large task.
Rows with a null in the key conflict with nothing if `nulls_distinct`; they are dealt by their other columns then.

Each change gives the same table when it is run again with the same rows, except that `append`, and rows with a null in a key
whose nulls are distinct, are added once more. Lost executors are Spark's to repeat, as nothing is in place before its
commit. There is one writer at a time; a driver that dies within a commit leaves some buckets new and some old, and running
the change again mends that.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StructField, StructType

from loppis.operators import writes
from loppis.session import shared_folder

BUCKET = "_bucket"


def write_once(rows: DataFrame, path: str) -> None:
    """Writes the rows unless a finished write is there; an unfinished one is written anew."""
    spark = rows.sparkSession
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        rows.write.mode("overwrite").parquet(path)


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    deal: tuple[str, ...]
    buckets: int
    nulls_distinct: bool

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], deal: list[str] | None = None, buckets: int = 64, nulls_distinct: bool = True) -> KeyedTable:
        """A new table without rows; its properties are kept beside the rows."""
        if not set(deal or keys) <= set(keys) or not set(keys) <= set(schema.names) or BUCKET in schema.names:
            raise ValueError("rows are dealt by columns of the key, and keys are columns of the table")
        schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
        about = {"schema": schema.jsonValue(), "keys": keys, "deal": deal or keys, "buckets": buckets, "nulls_distinct": nulls_distinct}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/_about")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        about = json.loads(spark.read.text(f"{path}/_about").first()[0])
        return cls(spark, path, StructType.fromJson(about["schema"]), tuple(about["keys"]), tuple(about["deal"]), about["buckets"], about["nulls_distinct"])

    # --- reading ----------------------------------------------------------------------------------------------------

    def read(self) -> DataFrame:
        return self._rows().select(*self.schema.names)

    def around(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the buckets of the given rows' values of `deal`; rows with a null there are not looked for."""
        typed = rows.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.deal]).dropna()
        dealt = typed.select(F.pmod(F.xxhash64(*self.deal), F.lit(self.buckets)).cast("int").alias(BUCKET))
        return self._rows(self._held(dealt)).select(*self.schema.names)

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        found = self.spark.read.schema(StructType([*self.schema, StructField(BUCKET, IntegerType())])).parquet(self.path)
        return found if buckets is None else found.filter(F.col(BUCKET).isin(buckets))

    # --- changes ----------------------------------------------------------------------------------------------------

    def append(self, new: DataFrame) -> None:
        """Adds rows; keys are not looked at."""
        self._write(self._dealt(self._typed(new)), "append")

    def replace_all(self, rows: DataFrame) -> None:
        """The given rows become the table. They are written apart first, as they may come from it."""
        staged = self._staged(self._dealt(self._typed(rows)))
        gone = set(self._held(self._rows())) - set(self._held(staged))
        self._write(staged, "overwrite")
        self._remove(gone)

    def insert_ignore(self, new: DataFrame, order: list[Column]) -> None:
        """Adds the first row of each key that is not there; only keys are read of the touched buckets."""
        staged = self._staged(writes.dedup_rows(self._dealt(self._typed(new)), list(self.keys), order, self.nulls_distinct))
        there = self._rows(self._held(staged))
        self._write(staged.join(there.select(*self._renamed()), self._same(), "left_anti"), "append")

    def upsert(self, new: DataFrame, order: list[Column]) -> None:
        """Inserts, and updates the columns that new has; the first row of each key counts. Supplied nulls overwrite."""
        given = [n for n in self.schema.names if n in new.columns]
        one = writes.dedup_rows(self._dealt(self._typed(new)), list(self.keys), order, self.nulls_distinct)
        staged = self._staged(one.select(*given, BUCKET))
        old = self._rows(self._held(staged))
        self._write(writes.upsert(old, staged, list(self.keys), [F.col(k) for k in self.keys], self.nulls_distinct), "overwrite")

    def delete(self, gone: DataFrame) -> None:
        """Removes the rows of the given keys; a null key is no row's key."""
        staged = self._staged(self._dealt(self._typed(gone.select(*self.keys))).dropna(subset=list(self.keys)).distinct())
        touched = self._held(staged)
        keys = staged.select(*self._renamed())
        match = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_k_{k}") for k in self.keys])
        self._write(self._rows(touched).join(keys, match, "left_anti"), "overwrite")
        # a bucket without a row left was not overwritten: it alone still has rows of these keys
        self._remove(self._held(self._rows(touched).join(keys, match, "left_semi")))

    def update_where(self, where: Column, values: dict[str, Column]) -> None:
        """Sets columns that are not of the key where the predicate holds; buckets without such rows stay as they are."""
        if set(values) & set(self.keys):
            raise ValueError("keys are not updated in place")
        touched = self._held(self._rows().filter(where))
        changed = writes.update_where(self._rows(touched), where, {n: v.cast(self.schema[n].dataType) for n, v in values.items()})
        self._write(changed, "overwrite")

    def rewrite(self, rows: DataFrame) -> None:
        """Whole new contents of those buckets that the rows fall into, for changes made of `around`."""
        self._write(self._staged(self._dealt(self._typed(rows))), "overwrite")

    # --- parts ------------------------------------------------------------------------------------------------------

    def _typed(self, rows: DataFrame) -> DataFrame:
        """The table's columns under its types, as a hash depends on the type; those that rows lack are null."""
        unknown = set(rows.columns) - set(self.schema.names)
        if unknown or not set(self.keys) <= set(rows.columns):
            raise ValueError(f"not columns of the table: {sorted(unknown)}; the key is {self.keys}")
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def _dealt(self, rows: DataFrame) -> DataFrame:
        by_key = F.xxhash64(*self.deal)
        if self.nulls_distinct:
            others = [f.name for f in self.schema if f.name not in self.keys and _hashable(f.dataType)]
            spread = F.xxhash64(*self.keys, *others)
            by_key = F.when(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in self.deal]), spread).otherwise(by_key)
        return rows.withColumn(BUCKET, F.pmod(by_key, F.lit(self.buckets)).cast("int"))

    def _staged(self, rows: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark)
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _held(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _renamed(self) -> list[Column]:
        return [F.col(k).alias(f"_k_{k}") for k in self.keys]

    def _same(self) -> Column:
        pairs = [(F.col(k), F.col(f"_k_{k}")) for k in self.keys]
        return reduce(lambda x, y: x & y, [a == b if self.nulls_distinct else a.eqNullSafe(b) for a, b in pairs])

    def _write(self, rows: DataFrame, mode: str) -> None:
        # one task a bucket, more where a bucket is large, as the sizes of the shuffle show
        spread = rows.hint("rebalance", F.col(BUCKET))
        spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def _remove(self, buckets: set[int] | list[int]) -> None:
        for b in buckets:  # at most `buckets` folders
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
