"""scan, mask and unmask of text files or Parquet tables: `python -m gossamer.cli scan --key-file k a.txt b.txt`."""

from __future__ import annotations

import argparse
import os
import stat
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import RegistryError, UnresolvedSpanError
from .operators.engine import Engine, audit, report
from .sources import gazetteers, texts
from .sources.registry import Registry, default_path

KEY_VARIABLE = "GOSSAMER_KEY"


def read_key(path: str | None) -> bytes:
    """32 hex digits from a file that only its owner reads, or from the environment. A key is never an argument."""
    if path:
        if os.stat(path).st_mode & (stat.S_IRWXG | stat.S_IRWXO):
            raise ValueError("the key file must be readable by its owner only")
        with open(path, encoding="ascii") as f:
            said = f.read().strip()
    else:
        said = os.environ.get(KEY_VARIABLE, "")
        if said:
            print(f"warning: the key of {KEY_VARIABLE} is visible to other processes of this user", file=sys.stderr)
    key = bytes.fromhex(said)
    if len(key) != 16:
        raise ValueError("the key must be 32 hexadecimal digits")
    return key


def read(spark: SparkSession, paths: list[str], scope: str) -> DataFrame:
    """Whole files as texts; a Parquet path is read as a table with doc_id and text."""
    if all(p.endswith(".parquet") for p in paths):
        return spark.read.parquet(*paths).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(scope).alias("scope"), "text")
    return texts.read_files(spark, paths).withColumn("scope", F.lit(scope))


def write(done: DataFrame, path: str) -> None:
    """Parquet with doc_id and text where the path ends so; else a folder with one text file an input."""
    if path.endswith(".parquet"):
        done.select("doc_id", "text").write.mode("overwrite").parquet(path)
    else:
        texts.write_files(done, path)


def registry_path(spark: SparkSession, said: str | None, scope: str) -> str:
    """A registry is shared by all executors, so only a local session may leave its place to the home folder."""
    if not said and not spark.sparkContext.master.startswith("local"):
        raise ValueError("--registry must name a folder that all executors share")
    return said or default_path(os.path.expanduser("~/.gossamer"), scope)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gossamer", description="Reversible pseudonyms for texts.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("scan", "report what would be masked; nothing is written but the report"), ("mask", "write masked texts"), ("unmask", "restore issued surrogates")):
        c = sub.add_parser(name, help=help_)
        c.add_argument("paths", nargs="+")
        c.add_argument("--scope", default="default")
        c.add_argument("--key-file")
        c.add_argument("--registry")
        c.add_argument("--gazetteers", help="folder of gzip CSV files; else the small seed")
        c.add_argument("--policy", choices=["permissive", "strict"], default="permissive")
        c.add_argument("--reference", action="append", default=[], help="a pattern of client references")
        c.add_argument("--out", required=name != "scan", help="a report, a .parquet path, or a folder of text files")
        c.add_argument("--audit", help="folder to append audit lines to, as JSON; they hold no value")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        key = read_key(args.key_file)
        spark = spark or SparkSession.builder.appName("gossamer").getOrCreate()
        table = gazetteers.load(spark, args.gazetteers) if args.gazetteers else gazetteers.seed(spark)
        docs = read(spark, args.paths, args.scope)
        with Engine(spark, key, table, args.reference, args.policy) as engine:
            if args.audit:
                texts.write_audit(audit(engine.detect(docs), key, "text", "scope"), args.audit)
            if args.command == "scan":
                said = report(engine.detect(docs), engine.version).first()["markdown"] + "\n"
                if args.out:
                    with open(args.out, "w", encoding="utf-8") as f:
                        f.write(said)
                else:
                    sys.stdout.write(said)
                return 0
            registry = Registry(spark, registry_path(spark, args.registry, args.scope), engine.version)
            if args.command == "mask":
                masked, issued = engine.mask(docs)
                registry.append(issued)
                write(masked, args.out)
                for r in engine.residue(docs).where("in_clear > 0 or fixed_points > 0").collect():
                    print(f"warning: {r['entity_type']}: {r['in_clear']} values left in clear, {r['fixed_points']} equal to their surrogate", file=sys.stderr)
            else:
                write(engine.unmask(docs, registry.read(args.scope)), args.out)
        return 0
    except (OSError, ValueError, RegistryError, UnresolvedSpanError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
