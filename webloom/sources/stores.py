"""Tables that grow by versions: snapshots, appends, and upserts that rewrite only the buckets they touch.

A table is a folder with data/v=<n>/ for what a version wrote and manifests/v=<n> for
the parts it consists of.  A version exists once its manifest does, which is written
last and never changed; so a table may be read while it is written, and be written
from what was read of it.  Earlier versions stay readable until ``vacuum``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of the keys of a table that takes upserts; files of a bucket; rows of a manifest are at most buckets and appends.
BUCKETS, FILES = 64, 1
_MANIFEST = "path string, bucket int"


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_MANIFEST}, v int").parquet(f"{folder}/manifests")
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions there are, oldest first."""
    known = _manifests(spark, folder)
    return [] if known is None else sorted(r["v"] for r in known.select("v").distinct().collect())


def parts(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, int | None]:
    """path (below the folder) -> bucket of the parts of a version, the last by default."""
    known = versions(spark, folder)
    wanted = known[-1] if version is None and known else version
    if wanted not in known:
        raise ValueError(f"{folder} has no version {wanted}")
    return {r["path"]: r["bucket"] for r in _manifests(spark, folder).filter(F.col("v") == wanted).collect()}


def _read(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{folder}/{p}" for p in paths])


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the last by default."""
    return _read(spark, folder, list(parts(spark, folder, version)))


def _commit(spark: SparkSession, folder: str, version: int, found: dict[str, int | None]) -> int:
    spark.createDataFrame(list(found.items()), _MANIFEST).coalesce(1).write.mode("error").parquet(f"{folder}/manifests/v={version}")
    return version


def _next(spark: SparkSession, folder: str) -> int:
    return (versions(spark, folder) or [0])[-1] + 1


def replace(df: DataFrame, folder: str) -> int:
    """df as the next version, whole."""
    spark, version = df.sparkSession, _next(df.sparkSession, folder)
    df.write.mode("overwrite").parquet(f"{folder}/data/v={version}")  # what a writer that failed left
    return _commit(spark, folder, version, {f"data/v={version}": None})


def append(df: DataFrame, folder: str) -> int:
    """The next version: the last, and df's rows."""
    spark, version = df.sparkSession, _next(df.sparkSession, folder)
    before = parts(spark, folder) if version > 1 else {}
    df.write.mode("overwrite").parquet(f"{folder}/data/v={version}")
    return _commit(spark, folder, version, before | {f"data/v={version}": None})


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _last_of_key(df: DataFrame, key: list[str], order: Column | None) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0) if order is None else order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(df: DataFrame, folder: str, key: list[str], order: Column | None = None, buckets: int = BUCKETS) -> int:
    """The next version: df's rows (of one key the first in ``order``) in place of those of their keys.

    Keys are dealt over buckets by their hash.  Only buckets with a new row are read
    and written; the manifest takes the others over.
    """
    spark, version = df.sparkSession, _next(df.sparkSession, folder)
    before = parts(spark, folder) if version > 1 else {}
    if any(b is None for b in before.values()):
        raise ValueError(f"{folder} wasn't written by upserts")
    new = _last_of_key(df, key, order).withColumn("_bucket", _bucket(key, buckets))
    touched = {r["_bucket"] for r in new.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
    old = [p for p, b in before.items() if b in touched]
    if old:
        kept = _read(spark, folder, old).join(new.select(*key), key, "left_anti")
        new = new.unionByName(kept.withColumn("_bucket", _bucket(key, buckets)), allowMissingColumns=True)
    target = f"{folder}/data/v={version}"
    dealt = new.repartition(min(buckets, max(1, len(touched))) * FILES, "_bucket", *([_bucket(key, FILES)] if FILES > 1 else []))
    dealt.write.mode("overwrite").partitionBy("_bucket").parquet(target)
    rest = {p: b for p, b in before.items() if b not in touched}
    return _commit(spark, folder, version, rest | {f"data/v={version}/_bucket={b}": b for b in touched})


def compared(spark: SparkSession, folder: str, key: list[str], old: int, new: int, columns: list[str] | None = None) -> DataFrame:
    """key, change (added, removed, changed) and the names of what changed, of the rows that differ between two versions."""
    a, b = read(spark, folder, old), read(spark, folder, new)
    names = columns or [c for c in b.columns if c in a.columns and c not in key]
    side = lambda rows, name: rows.select(*key, F.struct(*names).alias(name))
    both = side(a, "_old").join(side(b, "_new"), key, "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col("_old")[c].eqNullSafe(F.col("_new")[c]), F.lit(c)) for c in names]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    found = both.select(*key, change.alias("change"), F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), differing).otherwise(F.array().cast("array<string>")).alias("columns"))
    return found.filter((F.col("change") != "changed") | (F.size("columns") > 0))


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes all but the last versions, with the parts that none of those has; what was deleted."""
    known = versions(spark, folder)
    gone = known[:-keep] if keep else known
    needed = {p for v in known[len(gone) :] for p in parts(spark, folder, v)}
    old = sorted({p for v in gone for p in parts(spark, folder, v)} - needed)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for p in [*(f"manifests/v={v}" for v in gone), *old]:
        at = path(f"{folder}/{p}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return old
