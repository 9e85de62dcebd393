"""Postcodes of the department of the commune that stands beside them, reversibly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256, joined
from ..functions.text import fold_key
from ..sources.registry import reserve
from .places import nearest


def some_department(key: bytes, scope: Column, code: Column) -> Column:
    """A department drawn by an HMAC of the code, never the code's own."""
    n = F.conv(F.substring(hmac_sha256(key, joined(scope, "code_postal_dept", code)), 1, 4), 16, 10).cast("int") % 96 + 1
    own = F.substring(code, 1, 2)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(two(n) == own, two(n % 95 + 1)).otherwise(two(n))


def coupled_departments(found: DataFrame, issued: DataFrame, gazetteer: DataFrame, scope: str) -> DataFrame:
    """(scope, value, department): for each postcode the department of its nearest commune's surrogate, the first in
    order where documents differ; null without a commune."""
    of = lambda kind: F.filter("spans", lambda s: s["type"] == kind)
    rows = found.select(F.col(scope).cast("string").alias("scope"), F.explode(of("CODE_POSTAL")).alias("c"), of("COMMUNE").alias("near"))
    rows = rows.select("scope", F.col("c.value").alias("value"), fold_key(nearest(F.col("c"), F.col("near"))["value"]).alias("town")).distinct()
    towns = issued.where("entity_type = 'COMMUNE'").select("scope", F.col("value").alias("town"), fold_key(F.col("surrogate")).alias("key"))
    places = gazetteer.where("kind = 'commune'").select("key", "departement")
    return rows.join(towns.join(places, "key"), ["scope", "town"], "left").groupBy("scope", "value").agg(F.min("departement").alias("department"))


def coherent(found: DataFrame, issued: DataFrame, gazetteer: DataFrame, key: bytes, scope: str) -> DataFrame:
    """`issued` with postcodes of their coupled departments.

    A code's permuted index stays in `mode`, which is what restores it. The code itself is the department's prefix and
    the index's last digits, or the next free place behind (`registry.reserve`: the order is by HMAC, so the result is
    the same however rows arrive). A prefix with more codes than places raises RegistryError.
    """
    codes = issued.where("entity_type = 'CODE_POSTAL'").join(coupled_departments(found, issued, gazetteer, scope), ["scope", "value"], "left")
    department = F.coalesce("department", some_department(key, F.col("scope"), F.col("value")))
    prefix = F.when(department.isin("2A", "2B"), "20").otherwise(department)
    codes = codes.withColumn("mode", F.col("surrogate")).withColumn("prefix", prefix)
    size = F.pow(F.lit(10), 5 - F.length("prefix")).cast("long")
    home = F.col("mode").cast("long") % size
    same = F.concat("prefix", F.lpad(home.cast("string"), 5 - F.length("prefix"), F.lit("0"))) == F.col("value")
    codes = codes.withColumn("home", F.when(same, (home + 1) % size).otherwise(home)).withColumn("of", F.col("scope")).withColumn("scope", F.concat_ws("\0", "scope", "prefix"))
    placed = [reserve(codes.where(F.length("prefix") == n), 10 ** (5 - n)) for n in (2, 3)]
    done = placed[0].unionByName(placed[1])
    done = done.withColumn("surrogate", F.concat("prefix", F.lpad(F.col("slot").cast("string"), 5 - F.length("prefix"), F.lit("0")))).withColumn("scope", F.col("of"))
    return issued.where("entity_type <> 'CODE_POSTAL'").unionByName(done.select(issued.columns))
