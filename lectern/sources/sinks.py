"""Sinks that may run twice: insert if absent, replace by key, publish a version, upsert a catalogue.

Tables are folders of Parquet in a store that the driver and all executors see. A batch and a stream (``foreachBatch``)
use the same functions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session that names none, a folder under /tmp. A cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="lectern-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def _has_rows(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(f.getPath().getName()[0] not in "_." for f in fs.listStatus(p))


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows at ``path``; none if nothing has been written there."""
    return spark.read.schema(schema).parquet(path) if _has_rows(spark, path) else spark.createDataFrame([], schema)


def insert_absent(rows: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Appends the rows whose keys are not stored yet, of rows with equal keys the first by ``order``; returns what was new.

    What is new is written once to a folder of its own, which the table's reader covers, so a repeated call adds nothing.
    Rows with a null key are never equal to others and are left out.
    """
    spark = rows.sparkSession
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*(order or rows.columns))).alias("r")).select("r.*")
    fresh = least.join(stored(spark, path, rows.schema).select(*keys), keys, "left_anti").select(*rows.columns)
    staged = new_folder(spark, "fresh")
    fresh.write.parquet(staged)
    out = spark.read.schema(rows.schema).parquet(staged)
    out.write.mode("append").parquet(path)
    return out


def replace_by_key(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Stored rows of every key that ``rows`` holds are replaced by them; other keys stay.

    Keys are dealt over ``buckets`` folders by hash; only those touched are written anew, from what they hold of other keys
    and the new rows, and change by Spark's dynamic partition overwrite.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    new = rows.select("*", bucket)
    held = stored(spark, path, new.schema)
    rest = held.join(new.select("bucket").distinct(), "bucket", "left_semi").join(rows.select(key).distinct(), key, "left_anti")
    staged = new_folder(spark, "replaced")  # read in full before the folders it came from are written
    rest.select(*new.columns).unionByName(new).write.parquet(staged)
    spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def publish(rows: DataFrame, root: str, version: int, owner: str) -> None:
    """Writes ``rows`` as a version, then points their owners to it: readers see an owner's old version or the new one, whole.

    The pointer of an owner is the largest version appended for it, so a call that fails before the last step changes
    nothing, and at most one version of an owner is current.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/version={version}")
    spark.read.parquet(f"{root}/version={version}").select(owner).distinct().withColumn("current", F.lit(version)).write.mode("append").parquet(f"{root}-pointers")


def current(spark: SparkSession, root: str, owner: str) -> DataFrame:
    """The rows of each owner's current version."""
    pointer = spark.read.parquet(f"{root}-pointers").groupBy(owner).agg(F.max("current").alias("version"))
    return spark.read.parquet(root).join(pointer, [owner, "version"])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A catalogue after a walk: (keys, url, audience, title, published_at, state, lastmod).

    Address and audience follow the walk; title and date only fill what is missing; state and lastmod change while the
    stored state is "pending" alone. Rows that the walk didn't meet stay as they are.
    """
    both = old.alias("o").join(new.alias("n"), keys, "full")
    frozen = F.col("o.state").isNotNull() & (F.col("o.state") != "pending")
    take = {"url": F.coalesce("n.url", "o.url"), "audience": F.coalesce("n.audience", "o.audience"), "title": F.coalesce("o.title", "n.title"), "published_at": F.coalesce("o.published_at", "n.published_at")}
    take |= {c: F.when(frozen, F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")) for c in ("state", "lastmod")}
    return both.select(*keys, *[v.alias(k) for k, v in take.items()])
