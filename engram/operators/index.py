"""A stored inverted index over facts, and places of rows in the order of their group, both without a task for one key.

Postings are a table bucketed by (key, part): a join on these two reads them without an exchange. A key of many facts is
dealt over parts by fact, so no bucket holds it whole; what is looked up is repeated for each of its parts.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.operators.graph import cut


class Index(NamedTuple):
    """postings (key, part, fact_id, tf, length), keys (key, df, parts), stats (n, mean): facts and their mean length."""

    postings: DataFrame
    keys: DataFrame
    stats: DataFrame


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/spark-{uuid.uuid4().hex[:8]}")
        at = spark.sparkContext.getCheckpointDir()
    return at


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """`df` as a table in the shared folder with one file for each of as many buckets by `keys` as a shuffle has partitions."""
    spark = df.sparkSession
    table, n = f"engram_{name}_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{shared_dir(spark)}/{table}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", at).saveAsTable(table)
    return spark.table(table)


def build(rows: DataFrame, part_rows: int = 1_000_000) -> Index:
    """rows: (fact_id, keys array<string>), each fact once. A key of more than `part_rows` facts has as many parts as it takes.

    Texts are split once: the postings of a fact are counted where it is read, and the facts without any key count too.
    """
    lengths = rows.select("fact_id", F.size("keys").alias("length"), "keys")
    each = lengths.select("fact_id", "length", F.explode_outer("keys").alias("key"))
    counted = cut(each.groupBy("key", "fact_id", "length").agg(F.count("*").alias("tf")))
    found = counted.where("key IS NOT NULL")
    keys = cut(found.groupBy("key").agg(F.count("*").alias("df")).withColumn("parts", F.ceil(F.col("df") / part_rows).cast("int")))
    many = keys.where("parts > 1").select("key", "parts")
    many = F.broadcast(many) if many.count() <= 100_000 else many
    part = F.coalesce(F.pmod(F.hash("fact_id"), F.col("parts")), F.lit(0))
    postings = found.join(many, "key", "left").select("key", part.alias("part"), "fact_id", "tf", "length")
    stats = cut(counted.select("fact_id", "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean")))
    return Index(bucketed(postings, "postings", ["key", "part"]), keys, stats)


_STORED: list[tuple[DataFrame, list[str], str, Index]] = []


def stored(facts: DataFrame, kind: str, keys: Column) -> Index:
    """The index of `keys` over `facts`, built once for each table of facts in a session and read from then on."""
    files = sorted(facts.inputFiles())
    for other, seen, what, index in _STORED:
        if what == kind and files and seen == files and other.sparkSession is facts.sparkSession and other.sameSemantics(facts):
            return index
    index = build(facts.select("fact_id", keys.alias("keys")))
    _STORED.append((facts, files, kind, index))
    del _STORED[:-8]
    return index


def look_up(asked: DataFrame, index: Index) -> DataFrame:
    """Postings of the column `key` of `asked`, beside all its columns and df; keys without facts go.

    `asked` is repeated for each part of its key, shuffled (or broadcast, if it is small) and met by the buckets.
    """
    parts = asked.join(index.keys, "key").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    return index.postings.join(parts, ["key", "part"])


def places(rows: DataFrame, group: str, order: list[str], counted: Column | None = None) -> DataFrame:
    """`rows` with `place`: how many rows of the group (of those `counted`) come before, by `order`, a total order.

    Rows are dealt in ranges of (group, order); a range counts for itself and starts from the sum of those before, so a
    large group is spread over many tasks.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    held = cut(rows.withColumn("_one", one).repartitionByRange(group, *order).withColumn("_pid", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("_one").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = held.withColumn("_local", before(W.partitionBy("_pid", group).orderBy(*order)))
    sums = held.groupBy("_pid", group).agg(F.sum("_one").alias("_one"))
    base = sums.select("_pid", group, before(W.partitionBy(group).orderBy("_pid")).alias("_base"))
    return local.join(base, ["_pid", group]).withColumn("place", F.col("_base") + F.col("_local")).drop("_pid", "_one", "_local", "_base")
