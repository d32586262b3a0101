"""Record exchange through a shared folder: ranges of 5000 sequences, and gzip JSON-line batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replication import by_origin

RANGE = 5000


def with_bundle(records: DataFrame) -> DataFrame:
    return records.withColumn("bundle", F.expr(f"(seq - 1) div {RANGE}"))


def ranges(records: DataFrame) -> DataFrame:
    """origin_id, bundle, first, last: what each range of an origin holds."""
    return with_bundle(records).groupBy("origin_id", "bundle").agg((F.first("bundle") * RANGE + 1).alias("first"), F.max("seq").alias("last"))


def unpublished(records: DataFrame, stored: DataFrame, self_origin: str) -> DataFrame:
    """Our own ranges that the folder lacks, or has to a lower sequence. stored: as ranges()."""
    own = ranges(records.filter(F.col("origin_id") == self_origin))
    held = stored.select("origin_id", "bundle", F.col("last").alias("held"))
    return own.join(held, ["origin_id", "bundle"], "left").filter(F.col("held").isNull() | (F.col("held") < F.col("last"))).drop("held")


def publish(records: DataFrame, folder: str, self_origin: str, stored: DataFrame | None = None) -> DataFrame:
    """Write our own new or longer ranges, replacing them whole; returns the ranges written."""
    own = records.filter(F.col("origin_id") == self_origin)
    todo = ranges(own) if stored is None else unpublished(records, stored, self_origin)
    rows = with_bundle(own).join(todo.select("bundle"), "bundle", "left_semi")
    rows.repartition("origin_id", "bundle").sortWithinPartitions("seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin_id", "bundle").parquet(folder)
    return todo


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored bundle; unreadable files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(folder).withColumn("origin_id", F.col("origin_id").cast("string"))


def wanted(spark: SparkSession, folder: str, vector: dict[str, int], self_origin: str) -> list[str]:
    """The folders of other origins' bundles that can hold something above the vector: from a listing of folders, no file is opened."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda p: [s.getPath() for s in fs.listStatus(p) if "=" in s.getPath().getName()] if fs.exists(p) else []
    out = []
    for o in names(at):
        origin = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(o.getName().split("=", 1)[1])
        if origin != self_origin:
            out += [b.toString() for b in names(o) if (int(b.getName().split("=")[1]) + 1) * RANGE > vector.get(origin, 0)]
    return sorted(out)


def _open(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """These bundles; files that cannot be read are skipped. The schema is that of the first that can be."""
    for skip in range(len(paths)):
        try:
            return spark.read.option("basePath", folder).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*paths[skip:], *paths[:skip]).withColumn("origin_id", F.col("origin_id").cast("string"))
        except AnalysisException:  # no schema in the first file
            continue
    raise ValueError(f"no bundle of {folder} can be read")


def fetch(stored: DataFrame, vector: DataFrame, self_origin: str) -> DataFrame:
    """Records of other origins above what we hold, of bundles that are read already. The vector has a row for each origin. fetch_listed() does not read what lies below it."""
    rows = by_origin(stored.filter(F.col("origin_id") != self_origin), vector.select("origin_id", F.col("seq").alias("__have")))
    return rows.filter(F.col("seq") > F.coalesce("__have", F.lit(0))).drop("__have", "bundle")


def fetch_listed(spark: SparkSession, folder: str, vector: dict[str, int], self_origin: str) -> DataFrame:
    """Records of other origins above the vector. Only the bundles that wanted() lists are read."""
    paths = wanted(spark, folder, vector, self_origin)
    if not paths:
        return read_folder(spark, folder).limit(0).drop("bundle")
    above = F.col("seq") > F.coalesce(*[F.when(F.col("origin_id") == o, n) for o, n in vector.items()], F.lit(0))
    return _open(spark, folder, paths).filter(above).drop("bundle")


def unreadable(spark: SparkSession, paths: list[str]) -> int:
    """How many files in these folders cannot be read: those whose footers executors cannot open."""
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+:)/+", "/")  # noqa: E731  Spark writes a local path with one slash or three
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).select(plain("path").alias("path"))
    seen = spark.read.option("ignoreCorruptFiles", "true").schema("seq long").parquet(*paths).select(plain("_metadata.file_path").alias("path")).distinct()
    return files.join(seen, "path", "left_anti").count()


def write_batch(bronze: DataFrame, path: str) -> None:
    """Gzip JSON lines of (source, path, byte_offset, content_hash, value)."""
    bronze.select("source", "path", "byte_offset", "content_hash", "value").write.mode("overwrite").option("compression", "gzip").json(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """The same; lines without a body (a header) are left out."""
    return spark.read.schema("source string, path string, byte_offset long, content_hash string, value string").json(path).filter(F.col("value").isNotNull())
