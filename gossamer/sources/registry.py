"""The registry: which surrogates a scope has issued. No clear value is in it, only HMACs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InjectivityError, RegistryError, SchemaVersionError
from ..schemas import REGISTRY_DDL, SCHEMA_VERSION
from .gazetteers import check_version


#: Up to so many scopes of a batch, their partitions are picked by name.
MANY_SCOPES = 1000


def default_path(root: str, scope: str) -> str:
    return f"{root.rstrip('/')}/registries/{re.sub(r'[^A-Za-z0-9_.-]', '_', scope)}"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_DDL)


class Registry:
    """A Parquet table partitioned by scope. Appends are anti-joined, so a replayed batch adds nothing."""

    def __init__(self, spark: SparkSession, path: str, gazetteer_version: str | None = None):
        self.spark, self.path, self.version = spark, path.rstrip("/"), gazetteer_version

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, scope: str | None = None) -> DataFrame:
        """All rows, or those of a scope; refuses later schemas and other gazetteers. Older schemas lack columns, which
        are read as null."""
        if not self.exists():
            return empty(self.spark)
        rows = self.spark.read.schema(REGISTRY_DDL).parquet(self.path)
        head = rows.agg(F.max("schema_version").alias("s"), F.max("gazetteer_version").alias("g")).first()
        if head["s"] and head["s"] > SCHEMA_VERSION:
            raise SchemaVersionError(f"schema version {head['s']} is later than {SCHEMA_VERSION}")
        if self.version:
            check_version(self.version, head["g"])
        return rows if scope is None else rows.where(F.col("scope") == scope)

    def append(self, issued: DataFrame) -> None:
        """Add rows whose (scope, entity_type, clear_hmac) is new; RegistryError if a surrogate is taken by another.

        Only the partitions of the batch's scopes are read. A registry has one writer at a time: two that append the same
        scope at once do not see each other's rows.
        """
        issued = issued.persist()
        try:
            scopes = [r[0] for r in issued.select("scope").distinct().limit(MANY_SCOPES + 1).collect()]
            known = self.read()
            if len(scopes) <= MANY_SCOPES:
                known = known.where(F.col("scope").isin(scopes))
            else:
                known = known.join(issued.select("scope").distinct(), "scope", "left_semi")
            new = issued.join(known.select("scope", "entity_type", "clear_hmac"), ["scope", "entity_type", "clear_hmac"], "left_anti").persist()
            try:
                clash = new.join(known.select("scope", "entity_type", "surrogate"), ["scope", "entity_type", "surrogate"], "left_semi").count()
                if clash:
                    raise RegistryError(f"{clash} surrogates are taken by other values")
                new.select(known.columns).repartition("scope").write.mode("append").partitionBy("scope").parquet(self.path)
            finally:
                new.unpersist()
        finally:
            issued.unpersist()


def contains(texts: DataFrame, registry: DataFrame, surrogate: str = "surrogate") -> DataFrame:
    """Rows of `texts` (scope, surrogate) that the registry has issued."""
    return texts.join(registry.select("scope", F.col("surrogate").alias(surrogate)).distinct(), ["scope", surrogate], "left_semi")


def reserve(values: DataFrame, size: int) -> DataFrame:
    """`values` (scope, home, clear_hmac), one row a value, with `slot`: its home, or the next free place behind it.

    Order is by home and HMAC, not by arrival: the i-th value of a scope takes i plus the largest home - i so far, one
    window. Values pushed past the end take the places that are left, in order.
    """
    order = Window.partitionBy("scope").orderBy("home", "clear_hmac")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(order) - 1
    ranked = values.withColumn("_i", i).withColumn("_n", F.count("*").over(Window.partitionBy("scope")))
    if ranked.where(F.col("_n") > size).count():
        raise RegistryError("a scope has more values than places")
    slots = ranked.withColumn("slot", F.col("_i") + F.max(F.col("home") - F.col("_i")).over(upto))
    fits = slots.where(F.col("slot") < size)
    late = slots.where(F.col("slot") >= size).withColumn("_k", F.row_number().over(order))
    free = late.select("scope").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).join(fits.select("scope", "slot"), ["scope", "slot"], "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy("scope").orderBy("slot")))
    moved = late.drop("slot").join(free, ["scope", "_k"]).select(*values.columns, "slot")
    return fits.select(*values.columns, "slot").unionByName(moved)


def assert_injective(registry: DataFrame) -> None:
    n = registry.groupBy("scope", "entity_type", "surrogate").agg(F.countDistinct("clear_hmac").alias("n")).where("n > 1").count()
    if n:
        raise InjectivityError(f"{n} surrogates stand for several values")
