"""Reading and writing of chants, features, predictions, scores, models and settings."""

from __future__ import annotations

import hashlib
import logging
import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_BYTES, MOST_FILES = 32 << 20, 10_000
CHANT_COLUMNS = ("id", "incipit", "cantus_id", "mode", "finalis", "siglum", "position", "folio", "sequence", "marginalia", "cao_concordances", "feast_id", "genre_id", "office_id", "source_id", "melody_id", "drupal_path", "full_text", "full_text_manuscript", "volpiano", "notes")
CHANTS = T.StructType([T.StructField(c, T.StringType()) for c in CHANT_COLUMNS])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); on one machine alone a temporary folder will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="neumatic-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_chants(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Chants from CSV with a header; all columns are strings, and unknown ones pass through."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, key: str = "id") -> str:
    """CSV sorted by key, in files of FILE_BYTES of input or less and in their order, and the checksum of its rows."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # as Spark estimates it
    files = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / FILE_BYTES))
    df.repartitionByRange(min(files, MOST_FILES), key).sortWithinPartitions(key).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return checksum(df)


def checksum(df: DataFrame) -> str:
    """Checksum of a table's rows that does not depend on their order."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.md5(f"{row[0]}|{row[1]}".encode()).hexdigest()


def file_md5(path: str) -> str:
    digest = hashlib.md5()
    with open(path, "rb") as file:
        while chunk := file.read(4096):
            digest.update(chunk)
    return digest.hexdigest()


def write_dataset(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("genre", "subset", "split")) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_dataset(spark: SparkSession, path: str, columns: list[str], **where: str) -> DataFrame:
    """Chosen columns of the partitions asked for; both reach the scan."""
    df = spark.read.parquet(path)
    for name, value in where.items():
        df = df.where(F.col(name) == value)
    return df.select("id", *columns)


def write_predictions(pairs: DataFrame, path: str) -> None:
    """Predicted labels as text lines in key order, and keyed as Parquet beside them."""
    pairs.orderBy("id").select(F.col("p").cast("int").cast("string").alias("value")).write.mode("overwrite").text(path)
    pairs.write.mode("overwrite").parquet(path.rstrip("/") + ".parquet")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, p) of predictions in text lines, numbered in file order without gathering them anywhere.

    Lines of a split are numbered by where they stand in it, and splits of a
    file by where they begin; a table of split sizes gives each its first number.
    """
    at = "_metadata"
    lines = spark.read.text(path).select("value", F.col(f"{at}.file_name").alias("file"), F.col(f"{at}.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    first = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    first = first.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    numbered = lines.join(first, ["file", "block"])
    return numbered.select((F.col("begin") + F.col("place") - F.col("first")).alias("row_no"), F.col("value").cast("int").alias("p"))


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Tuning results or scores as CSV."""
    flat = [{k: str(v) if isinstance(v, dict) else v for k, v in row.items()} for row in rows]
    spark.createDataFrame(flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_runs(spark: SparkSession, pattern: str, runs: list[str]) -> DataFrame:
    """Score tables of several runs, tagged; missing runs are skipped with a message."""
    found = None
    for run in runs:
        path = pattern.format(run=run)
        try:
            df = spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("run", F.lit(run))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            logging.warning("run %s is missing: %s", run, path)
            continue
        found = df if found is None else found.unionByName(df, allowMissingColumns=True)
    if found is None:
        raise FileNotFoundError(pattern)
    return found


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table stands at the path, in whatever store it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def write_embedding(df: DataFrame, path: str, refresh: bool = False) -> None:
    """x, y and label by id; an existing result stays unless ``refresh``."""
    df.orderBy("id").coalesce(1).write.mode("overwrite" if refresh else "ignore").option("header", True).csv(path)


def read_settings(path: str) -> dict:
    """Experiment settings from YAML; experiment_type must be there."""
    import yaml

    with open(path, encoding="utf-8") as file:
        settings = yaml.safe_load(file)
    if "experiment_type" not in settings:
        raise ValueError(f"{path} has no experiment_type")
    return settings


def start_log(name: str, folder: str, **settings) -> logging.Logger:
    """A log file with a header and the settings; experiments add their results to it."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.handlers = [logging.FileHandler(os.path.join(folder, f"{name}.log"), mode="w")]
    log.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    log.info("experiment %s", name)
    for key, value in settings.items():
        log.info("> %s = %s", key, value)
    return log
