"""Admission of cited evidence: lines are parsed, every row gets a status and, where it is refused, the first reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses from strong to weak, and the endings of documentation.
STATUSES = ["confirmed", "dynamic_observed", "static_inferred", "documented_only", "unknown"]
DOCS = r"(?i)\.(md|rst|txt|adoc)$"
NEAR = 3  # lines around a cited range in which its symbol may stand


def line_range(spec: Column) -> tuple[Column, Column]:
    """(start, end) of N, N-M or N:M; nulls where it is none of these."""
    p = r"^\s*(\d+)\s*(?:[-:]\s*(\d+))?"
    start, end = (F.nullif(F.regexp_extract(spec, p, g), F.lit("")).cast("int") for g in (1, 2))
    return start, F.coalesce(end, start)


def relative(path: Column) -> Column:
    """A path without ./ in front; null where it leaves the folder."""
    p = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"), F.lit(None)).otherwise(p)


def admit(cited: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """cited (id, file, lines, symbol, status, detail, kind) with line_start, line_end, accepted status, and reason (null: accepted).

    files (path) is the inventory, lines (path, line_no, text) the texts. Only files and lines that some row cites are
    shuffled; a symbol is looked for line by line in the range and three lines around it. id must be unique. Order of
    reasons: status, missing observation, file outside, no file, not in the inventory, no text, no lines, range, symbol.
    """
    start, end = line_range(F.col("lines"))
    rel, doc = relative(F.col("file")), F.coalesce(F.col("file").rlike(DOCS), F.lit(False))
    said = F.coalesce("status", F.lit("static_inferred"))
    x = cited.withColumns({"line_start": start, "line_end": end, "path": rel, "doc": doc, "said": said})
    last = F.regexp_extract(F.regexp_replace(F.trim("symbol"), r"[.:/()\s>-]+$", ""), r"([^.:/()\s>]+)$", 1)
    x = x.withColumn("needle", F.coalesce(F.nullif(last, F.lit("")), F.trim("symbol"), F.lit("")))
    known = files.select("path").distinct().withColumn("known", F.lit(True))
    asked = x.select("path").where("path is not null").distinct()
    text = lines.join(asked, "path", "left_semi")
    length = text.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    # one row for each cited line keeps the join an equality
    spans = x.where("needle <> '' and line_start >= 1 and line_end >= line_start").join(length, "path").where("line_end <= n_lines")
    wanted = spans.select("id", "path", "needle", F.explode(F.sequence(F.greatest(F.col("line_start") - NEAR, F.lit(1)), F.least(F.col("line_end") + NEAR, F.col("n_lines")))).alias("line_no"))
    seen = wanted.join(text, ["path", "line_no"]).where(F.contains("text", "needle")).select("id").distinct().withColumn("seen", F.lit(True))
    y = x.join(known, "path", "left").join(length, "path", "left").join(seen, "id", "left")
    reason = (
        F.when(~F.col("said").isin(STATUSES), "invalid status")
        .when((F.col("said") == "dynamic_observed") & (F.coalesce("detail", F.lit("")) == ""), "observation without detail")
        .when(F.col("file").isNotNull() & F.col("path").isNull(), "file outside")
        .when(F.coalesce("path", F.lit("")) == "", "missing file")
        .when(F.col("known").isNull() & ~F.col("doc"), "not in inventory")
        .when(F.col("n_lines").isNull(), "not readable")
        .when(F.col("line_start").isNull() & (F.col("said") != "documented_only"), "missing lines")
        .when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")) | (F.col("line_end") > F.col("n_lines")), "lines out of range")
        .when(F.col("line_start").isNotNull() & (F.col("needle") != "") & F.col("seen").isNull(), "symbol not found")
    )
    weaker = (F.coalesce("kind", F.lit("")) == "calls") & (F.col("said") == "confirmed") & (F.coalesce("symbol", F.lit("")) == "")
    status = F.when(F.col("doc"), "documented_only").when(weaker, "static_inferred").otherwise(F.col("said"))
    return y.select("id", "path", "line_start", "line_end", "symbol", F.substring(F.coalesce("detail", F.lit("")), 1, 200).alias("detail"), F.when(F.col("doc"), "doc").otherwise("findings").alias("source"), status.alias("status"), reason.alias("reason"))


def evidence_id(file: Column, start: Column, end: Column, symbol: Column, source: Column, detail: Column) -> Column:
    """A stable id of an evidence row; a missing line reads None in it."""
    line = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit("ev:"), F.substring(F.sha1(F.concat_ws("|", file, line(start), line(end), symbol, source, detail)), 1, 12))


def keep_whole(parts: DataFrame, nodes: DataFrame, ends: list[str], key: str = "id") -> DataFrame:
    """Ordered parts of structures (steps, links, transitions) of which every end is a node; a null end counts as one."""
    for end in ends:
        ok = parts.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
        parts = ok.select(*parts.columns).union(parts.where(F.col(end).isNull()))
    return parts


def replace_later(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last one by order, whole."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
