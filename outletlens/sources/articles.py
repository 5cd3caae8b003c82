"""Article files in, JSON and text reports out."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletlens.functions.text import strip


def _decoded(files: DataFrame) -> DataFrame:
    """path, article_id, text and error of binary files; text is null where the file can't be used."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), strip(F.decode("content", "UTF-8")))
    error = F.when(text.isNull(), F.concat(F.col("path"), F.lit(": not valid UTF-8"))).when(text == "", F.concat(F.col("path"), F.lit(": empty")))
    return files.select("path", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("article_id"), F.when(error.isNull(), text).alias("text"), error.alias("error"), name.alias("_name"))


def _usable(rows: DataFrame, where: str) -> DataFrame:
    for r in rows.where("error is not null").select("error").collect():  # files of one folder that can't be read
        warnings.warn(r["error"], stacklevel=3)
    good = rows.where("error is null").drop("error", "_name")
    if good.limit(2).count() < 2:
        raise ValueError(f"fewer than two usable articles in {where}")
    return good


def discover(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, article_id, text of the .txt files in a folder, ordered by path (``ordinal``).

    Hidden files are left out; files that are empty or not UTF-8 are warned
    about; fewer than two usable ones are an error, as is anything that is no folder.
    """
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(hconf)
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder if recursive else f"{folder.rstrip('/')}/*")
    rows = _decoded(files).where(F.col("_name").rlike(r"(?i)\.txt$") & ~F.col("_name").startswith("."))
    from pyspark.sql import Window as W

    return _usable(rows, folder).withColumn("ordinal", F.row_number().over(W.orderBy("path")) - 1)


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, article_id, text, ordinal of listed files in their order; other endings are skipped, unusable files an error."""
    kept = [p for p in paths if p.lower().endswith(".txt")]
    for p in set(paths) - set(kept):
        warnings.warn(f"{p}: not a .txt file", stacklevel=2)
    if len(kept) < 2:
        raise ValueError("fewer than two article files")
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def whole(p: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(hconf).makeQualified(path).toString()

    order = spark.createDataFrame([(k, whole(p)) for k, p in enumerate(kept)], "ordinal int, _file string")
    rows = _decoded(spark.read.format("binaryFile").load(sorted(set(kept))))
    bad = rows.where("error is not null").select("error").first()
    if bad:
        raise ValueError(bad["error"])
    return rows.drop("error").join(F.broadcast(order), F.col("path") == F.col("_file")).drop("_name", "_file").orderBy("ordinal")


def raw_pair(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Two files as they are, for a diff."""
    return spark.read.format("binaryFile").load([a, b]).select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("article_id"), F.decode("content", "UTF-8").alias("text"))


def to_json(report: DataFrame) -> DataFrame:
    """One indented JSON document (``json``) for each row."""
    return report.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def save_json(report: DataFrame, path: str) -> None:
    """The rows of a report as JSON lines under ``path``."""
    report.write.mode("overwrite").json(path)
