"""Documents and append-only logs as tables, and the sinks beside them: JSON, line logs with retention, texts a view, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields of a log line; others are left out.
LOG = "ts double, event string, tool string, counted boolean, run_id string, source string, tool_use_id string, action_id string, ok boolean, rate_limited boolean, error string"


def read_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Whole JSON documents by a schema. A path that is missing is empty where that is allowed, else an error; an invalid document is an error when it is read."""
    if missing_ok:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str, since: float | None = None) -> DataFrame:
    """Rows of LOG of JSON lines; torn lines and lines whose time is no number are skipped, and so are those before since, at the scan."""
    log = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("ts is not null")
    return log if since is None else log.where(F.col("ts") >= since)


def append_log(rows: DataFrame, path: str) -> None:
    """One more file beside the log's others: writers don't share files, so none needs a lock."""
    rows.write.mode("append").option("compression", "none").json(path)


def keep_recent(rows: DataFrame, now: float, days: float = 2) -> DataFrame:
    """Log rows of the last days; a compaction writes them to a new path and swaps it."""
    return rows.where(F.col("ts") >= now - 86_400 * days)


def swap_in(spark: SparkSession, rows: DataFrame, path: str, form: str = "json") -> None:
    """rows replace what is at path: written beside it as a whole, then renamed, so a reader sees the old or the new."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows.write.format(form).save(beside)
    jvm = spark.sparkContext._jvm
    new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def texts(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, text): each key's lines in order as one text; a key's lines are a view's, bounded by its limits."""
    x = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("l"))
    return x.select(key, F.array_join(F.transform("l", lambda r: r[line]), "\n").alias("text"))


def write_texts(rows: DataFrame, path: str, key: str = "view") -> None:
    """One folder a key; views that are gone are gone afterwards, as the whole is replaced."""
    rows.select(key, "text").repartition(key).write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def report(summary: DataFrame, key: str, value: Column, order: list[Column], title: str) -> DataFrame:
    """(text): a Markdown table of a small summary, in order."""
    row = F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), value.cast("string"), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order))
    lines = summary.select(place.alias("n"), row.alias("line")).groupBy().agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    head = F.lit(f"# {title}\n\n| {key} | value |\n| --- | --- |\n")
    return lines.select(F.concat(head, F.array_join(F.transform("l", lambda r: r["line"]), "\n")).alias("text"))


def changed_files(old: DataFrame, new: DataFrame, key: str = "path", content: str = "hash") -> DataFrame:
    """(path, change): added, modified or deleted between two listings."""
    a, b = old.select(key, F.col(content).alias("__a"), F.lit(1).alias("__old")), new.select(key, F.col(content).alias("__b"), F.lit(1).alias("__new"))
    x = a.join(b, key, "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return x.withColumn("change", change).where("change is not null").select(key, "change")


def estimated(log: DataFrame, estimates: DataFrame, within: float = 3600) -> DataFrame:
    """Rows of estimates (action_id, ts, calls) that no counted attempt of the action within the time around them makes needless."""
    seen = log.where("event = 'attempt' and action_id is not null").select("action_id", F.col("ts").alias("__t")).distinct()
    near = estimates.join(seen, "action_id").where(F.abs(F.col("ts") - F.col("__t")) <= within).select("action_id", "ts").distinct()
    return estimates.join(near, ["action_id", "ts"], "left_anti").select(estimates.columns)
