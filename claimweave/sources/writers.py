"""Writers: graph tables, JSON and CSV exports, keyed memo tables and assembled reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, spread over files as the rows are."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def memo_key(c: Column) -> Column:
    return F.substring(F.sha2(F.concat(c, F.lit("::v2")), 256), 1, 16)


def content_hash(*columns: str) -> Column:
    """The first 12 hex digits of the hash of a row as JSON with its fields in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 12)


def remember(memo: DataFrame, fresh: DataFrame) -> DataFrame:
    """A memo (level, key, response) with fresh rows over it; blank and refused responses are dropped, to be asked again."""
    good = lambda df: df.where("response IS NOT NULL AND trim(response) <> '' AND NOT coalesce(get_json_object(response, '$.refused') = 'true', false)")
    new = good(fresh)
    return new.unionByName(good(memo).join(new.select("level", "key"), ["level", "key"], "left_anti"))


def invalidated(memo: DataFrame, level: str) -> DataFrame:
    """A memo without the entries of one level."""
    return memo.where(F.col("level") != level)


def put_files(spark: SparkSession, folder: str, files: dict[str, str]) -> None:
    """Small text files under given names, such as a manifest or one artifact per source; for sets of fixed size only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    for name, text in files.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(root, name), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()


def report(sections: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(report_id, markdown) from (report_id, no, title, body): the sections of a report in order, and under a rule its note."""
    part = F.concat(F.lit("## "), F.col("no").cast("string"), F.lit(". "), "title", F.lit("\n\n"), "body")
    rows = sections.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("no", part.alias("part")))).alias("parts"))  # a report has a fixed set of sections
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    if notes is None:
        return rows.select("report_id", text.alias("markdown"))
    return rows.join(notes, "report_id", "left").select("report_id", F.concat(text, F.coalesce(F.concat(F.lit("\n\n---\n\n"), "note"), F.lit(""))).alias("markdown"))
