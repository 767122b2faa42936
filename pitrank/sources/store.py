"""Partitioned storage: discovery, skip-if-unchanged writes, append-only version stores, catalog reads, exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitrank.sources.normalise import row_hash


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir names. Only a local session without that setting gets a temporary one."""
    context = spark.sparkContext
    top = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="pitrank-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(top)
    return top


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint, so that what they were read from may be overwritten."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """The (season, round) partitions that are present, without reading a row's values."""
    return spark.read.parquet(folder).select(F.col("season").cast("long"), F.col("round").cast("long")).distinct()


def write_changed(rows: DataFrame, folder: str, keys: list[str], version: int, parts: list[str] | None = None) -> DataFrame:
    """Rewrites the partitions whose rows or schema version changed; the written keys come back.

    A partition's fingerprint is the sum of its rows' hashes; it is kept with their number and the schema version in a
    side table. Partitions that the input no longer has stay as they are, as a season's earlier ones do.

    Folders are made of ``parts``, some of the keys (all by default), as a folder for each of very many keys costs more
    than its rows. Every key has its fingerprint all the same. A folder in which a key changed is written anew, with
    what it holds of keys that the input doesn't have."""
    spark, parts = rows.sparkSession, parts or keys
    h = F.conv(F.substring(F.col("h"), 1, 8), 16, 10).cast("long")
    new = rows.withColumn("h", row_hash(rows)).groupBy(*keys).agg(F.sum(h).alias("fingerprint"), F.count("*").alias("n"), F.lit(version).alias("version"))
    changed, held = new, exists(spark, f"{folder}/fingerprints")
    if held:
        old = spark.read.parquet(f"{folder}/fingerprints").select(*keys, F.struct("fingerprint", "n", "version").alias("was"))
        changed = new.join(old, keys, "left").filter(~F.struct("fingerprint", "n", "version").eqNullSafe(F.col("was"))).drop("was")
    changed = settled(changed)
    out, written = rows.join(changed.select(*keys), keys, "left_semi"), changed.select(*keys, "fingerprint", "n", "version")
    if held and set(parts) != set(keys):
        touched = changed.select(*parts).distinct()
        rest = lambda d, name: settled(spark.read.schema(d.schema).parquet(f"{folder}/{name}").join(touched, parts, "left_semi").join(changed.select(*keys), keys, "left_anti").select(*d.columns))
        out, written = out.select(*rows.columns).unionByName(rest(rows, "rows")), written.unionByName(rest(written, "fingerprints"))
    for d, name in ((out, "rows"), (written, "fingerprints")):
        d = d if set(parts) == set(keys) else d.hint("rebalance", *[F.col(c) for c in parts])
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{folder}/{name}")
    return changed.select(*keys, "fingerprint", "n")


def append_versions(store: DataFrame | None, incoming: DataFrame, key: list[str], payload: str, at: str) -> DataFrame:
    """Versions to append: payloads whose hash their key doesn't have yet; the first retrieval is kept."""
    new = incoming.withColumn("hash", F.sha2(payload, 256)).groupBy(*key, "hash").agg(F.min(at).alias(at), F.first(payload).alias(payload))
    return new if store is None else new.join(store.select(*key, "hash"), [*key, "hash"], "left_anti")


def newest(store: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest version of each key."""
    return store.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), F.desc("hash")))).filter("k = 1").drop("k")


def catalog_read(spark: SparkSession, root: str, catalog: DataFrame) -> DataFrame:
    """Each catalogued file's status: outside (its path leaves the root), absent, mismatch or verified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("at"), F.sha2("content", 256).alias("found"))
    base = root.removeprefix("file:").rstrip("/")
    j = catalog.withColumn("at", F.concat(F.lit(base + "/"), "path")).join(files, "at", "left")
    outside = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    status = F.when(outside, "outside").when(F.col("found").isNull(), "absent").when(F.col("found") != F.col("sha256"), "mismatch").otherwise("verified")
    return j.select("path", status.alias("status"))


def export(rows: DataFrame, keys: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    """One JSON document per key with its rows as a sorted array."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))
    return g.select(*keys, F.to_json(F.struct(*keys, name)).alias("document"))
