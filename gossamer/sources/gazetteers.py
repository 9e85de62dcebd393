"""Gazetteers as tables: loaders for gzip CSV, a small seed of our own, versions and the build."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import GazetteerVersionMismatch
from ..functions.text import fold_key
from ..schemas import GAZETTEER_DDL

#: kind: (file, name column, attribute column or None)
FILES = {"prenom": ("prenoms.csv.gz", "prenom", "genre"), "nom": ("noms.csv.gz", "patronyme", None), "commune": ("communes.csv.gz", "nom", "departement"), "voie": ("voies.csv.gz", "nom_voie", None)}

SEED = {
    "prenom": "Jean:M Pierre:M Paul:M Louis:M Luc:M Marc:M Hugo:M Jules:M Simon:M Victor:M Marie:F Anne:F Claire:F Julie:F Sophie:F Alice:F Emma:F Louise:F Jeanne:F Lucie:F Camille:MF Dominique:MF Claude:MF Martin:M".split(),
    "nom": "Martin Bernard Dubois Durand Leroy Moreau Simon Laurent Lefebvre Michel Garcia Dupont Fontaine Rousseau Vincent Muller Girard Andre Mercier Blanc Guerin Boyer Garnier Chevalier Francois Legrand Gauthier Perrin Robin Clement".split(),
    "commune": ["Paris:75", "Lyon:69", "Marseille:13", "Toulouse:31", "Nice:06", "Nantes:44", "Angoulême:16", "Cognac:16", "Bordeaux:33", "Lille:59", "Rennes:35", "Reims:51", "Ajaccio:2A", "Bastia:2B", "Saint Denis:93", "La Rochelle:17", "Le Havre:76", "Dijon:21", "Angers:49", "Brest:29"],
    "voie": ["rue de la Paix", "rue des Lilas", "avenue de la République", "boulevard Victor Hugo", "place du Marché", "chemin des Vignes", "impasse du Moulin", "rue Pasteur", "allée des Tilleuls", "quai de la Gare", "rue de Paris", "cours Mirabeau"],
}


def _literal(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from a JSON literal: no Python rows, no RDD."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<{_struct(ddl)}>")).alias("r")).select("r.*")


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{p.split()[0]}: {p.split()[1]}" for p in ddl.split(", ")) + ">"


def seed(spark: SparkSession) -> DataFrame:
    """A small gazetteer to work and test with; production tables come from `load`."""
    rows = []
    for kind, names in SEED.items():
        for n in names:
            name, _, more = n.partition(":")
            rows.append({"kind": kind, "name": name, "genre": more if kind == "prenom" else "", "departement": more if kind == "commune" else "", "cnt": 1})
    out = _literal(spark, rows, "kind string, name string, genre string, departement string, cnt long")
    return out.select("kind", "name", fold_key(F.col("name")).alias("key"), "genre", "departement", "cnt")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The four gzip CSV files of a folder as one table; of equal keys the first row of a file wins. A file may also be a
    folder of such files, as `write` makes them, in the order of their names. ValueError if one is empty."""
    out = spark.createDataFrame([], GAZETTEER_DDL)
    for kind, (file, name, more) in FILES.items():
        raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(f"{folder.rstrip('/')}/{file}")
        if name not in raw.columns:
            raise ValueError(f"{file} is empty or lacks the column {name}")
        cols = dict.fromkeys(("genre", "departement"), F.lit(""))
        if more:
            cols[more] = F.coalesce(F.trim(more), F.lit(""))
        cnt = F.coalesce(F.expr("try_cast(count AS long)"), F.lit(0)) if "count" in raw.columns else F.lit(0)
        rows = raw.select(F.lit(kind).alias("kind"), F.trim(name).alias("name"), fold_key(F.col(name)).alias("key"), cols["genre"].alias("genre"), cols["departement"].alias("departement"), cnt.cast("long").alias("cnt"), F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
        first = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where("n = 1 and name <> ''")
        out = out.unionByName(first.drop("at", "n"))
    return out


def build(gazetteer: DataFrame) -> DataFrame:
    """A row a gazetteer: kind, cnt and a SHA-256 over the digests of its parts, in order. A part is the lines, sorted by
    key, of the keys with the same first two characters, so that no task holds a whole gazetteer."""
    line = F.concat_ws(",", "name", "genre", "departement", F.col("cnt").cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda s: s["line"]), "\n")
    parts = gazetteer.groupBy("kind", F.substring("key", 1, 2).alias("part")).agg(F.count("*").alias("n"), F.sha2(lines, 256).alias("sha"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda p: F.concat(p["part"], F.lit(":"), p["sha"])), "|")
    return parts.groupBy("kind").agg(F.sum("n").alias("cnt"), F.sha2(said, 256).alias("sha256"))


def write(gazetteer: DataFrame, folder: str) -> None:
    """Each kind as gzip CSV sorted by key, and a manifest of `build`: what `load` reads and `check` holds it against."""
    folder = folder.rstrip("/")
    for kind, (file, name, more) in FILES.items():
        rows = gazetteer.where(F.col("kind") == kind).orderBy("key").select(F.col("name").alias(name), *([more] if more else []), F.col("cnt").alias("count"))
        rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{folder}/{file}")
    build(gazetteer).write.mode("overwrite").json(f"{folder}/manifest.json")


def check(spark: SparkSession, folder: str) -> bool:
    """Whether the files of a folder give the digests of its manifest."""
    said = spark.read.schema("kind string, cnt long, sha256 string").json(f"{folder.rstrip('/')}/manifest.json")
    there = build(load(spark, folder))
    return said.exceptAll(there).isEmpty() and there.exceptAll(said).isEmpty()


def version(gazetteer: DataFrame) -> str:
    """One digest over the digests of all kinds, in order."""
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "sha256"))), "|")
    return build(gazetteer).agg(F.sha2(parts, 256).alias("v")).first()["v"]


def check_version(found: str, stored: str | None) -> None:
    if stored and stored != found:
        raise GazetteerVersionMismatch("the registry was made with other gazetteers")


def indexed(gazetteer: DataFrame) -> DataFrame:
    """The gazetteer with each name's place `idx` and the size `n` of its kind, by key.

    Places are ranks within ranges of keys plus the sizes of the ranges before: no kind is sorted in one task.
    """
    part = F.substring("key", 1, 2)
    rows = gazetteer.withColumn("part", part)
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("kind", "part").count().select("kind", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.sum("count").over(Window.partitionBy("kind")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind", "part").orderBy("key"))
    return rows.withColumn("rank", rank).join(sizes, ["kind", "part"]).select("kind", "name", "key", "genre", "departement", "cnt", (F.col("before") + F.col("rank") - 1).alias("idx"), "n")


#: Fewer names than this would hardly hide one another.
LEAST_POOL = 8


def pooled(gazetteer: DataFrame) -> DataFrame:
    """(key, pool, idx, n, names, name): each key's place in its pool; its names by kind, and one for other kinds.

    A name may be of several kinds. Keys of the same kinds are one pool, so that what stands for a first name is one,
    and no surrogate of one kind is that of another value of another kind. Pools of few names join the largest.
    """
    keys = gazetteer.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("kind", "name")))).alias("names"), F.min("name").alias("name"))
    sizes = keys.groupBy("kinds").agg(F.count("*").alias("size"))
    one = sizes.agg(F.collect_list(F.struct("size", "kinds")).alias("all"))  # a row for each combination of four kinds: 15 at most
    pools = one.select(F.explode("all").alias("x"), F.array_max("all")["kinds"].alias("largest")).select("x.kinds", F.when(F.col("x.size") >= LEAST_POOL, F.col("x.kinds")).otherwise(F.col("largest")).alias("pool"))
    rows = keys.join(F.broadcast(pools), "kinds")
    placed = indexed(rows.select(F.col("pool").alias("kind"), "name", "key", F.lit("").alias("genre"), F.lit("").alias("departement"), F.lit(1).cast("long").alias("cnt")))
    return placed.select("key", F.col("kind").alias("pool"), "idx", "n").join(keys.select("key", "names", "name"), "key")
