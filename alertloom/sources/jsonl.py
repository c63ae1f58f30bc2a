"""Readers and writers of JSON lines, JSON arrays and label archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.functions.markers import LABEL_FIELDS
from alertloom.session import materialize


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, source_line (from 1, blank lines counted), line.

    A file's lines are numbered inside each split; the splits' line counts, one row each, give the
    starts. So large files are still read by many tasks.
    """
    text = spark.read.text(paths).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_path").alias("_path"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    split = Window.partitionBy("_path", "_block")
    counts = text.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(split.orderBy("_id"))
    return (
        text.withColumn("_at", at)
        .join(starts, ["_path", "_block"])
        .select("source_file", (F.col("_start") + F.col("_at")).cast("long").alias("source_line"), "line")
    )


def parse_objects(lines: DataFrame) -> DataFrame:
    """Adds raw, the line as a variant; blank lines go; a line that isn't a JSON object ends the job."""
    rows = once(lines.filter(F.trim("line") != "").withColumn("raw", F.try_parse_json("line")), "raw")
    raw = F.col("raw")
    where = F.concat_ws(":", "source_file", F.col("source_line").cast("string"))
    bad = F.raise_error(F.concat(F.lit("not a JSON object at "), where)).cast("variant")
    is_object = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
    return once(rows.withColumn("raw", F.when(is_object, raw).otherwise(bad)).drop("line"), "raw")


def once(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a column that is computed once a row, however often it is read: an expression that isn't deterministic is never
    copied into its readers. (The optimizer knows that rand() >= 0 is true and would take it away, so a sum is compared.)"""
    return rows.withColumn(column, F.when(F.rand() + 1 > 0, F.col(column)))


def read_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_objects(numbered_lines(spark, paths))


def reject_labels(records: DataFrame) -> DataFrame:
    """The records; one that already carries a label field ends the job."""
    taken = [F.try_variant_get("raw", f"$.{f}", "variant").isNotNull() for f in LABEL_FIELDS]
    where = F.concat_ws(":", "source_file", F.col("source_line").cast("string"))
    hit = taken[0]
    for t in taken[1:]:
        hit = hit | t
    bad = F.raise_error(F.concat(F.lit("label fields at "), where)).cast("variant")
    return once(records.withColumn("raw", F.when(hit, bad).otherwise(F.col("raw"))), "raw")


def _running(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of a value over all pieces of the file before a piece: inside each split by a window, behind the
    sums of the splits before, one row each."""
    split = Window.partitionBy("_path", "_block")
    valued = pieces.withColumn("_value", value.cast("long"))
    sums = valued.groupBy("_path", "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_path", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_value").over(split.orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return valued.withColumn("_inside", inside).join(starts, ["_path", "_block"]).withColumn(name, F.col("_start") + F.col("_inside")).drop(
        "_start", "_inside", "_value"
    )


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, source_line (item number from 1), raw: items of one top-level JSON array a file. A malformed file, one
    that isn't an array, or an item that isn't an object ends the job.

    The text is cut at closing braces and read by many tasks. Whether a brace stands in a text and how deep it is follows from running
    sums of quotes and braces, so no task holds more than a split, and no row more than an item.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("piece"),
    )
    # escaped characters aren't quotes; what stands between quotes is every other part
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"')
    outside = lambda first: F.aggregate(
        F.filter("_parts", lambda x, i: i % 2 == first), F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("{")))
    )
    pieces = text.withColumn("_parts", parts).select("_path", "_block", "_id", "piece", (F.size("_parts") - 1).alias("_quotes"), outside(0).alias("_o0"), outside(1).alias("_o1"))
    pieces = materialize(pieces, "array-pieces")
    quoted = _running(pieces, F.col("_quotes"), "_before")
    odd = F.col("_before") % 2 == 1
    levels = quoted.select(
        "_path", "_block", "_id", "piece",
        F.when(odd, F.col("_o1")).otherwise(F.col("_o0")).alias("_opens"),
        ((F.col("_before") + F.col("_quotes")) % 2 == 0).cast("int").alias("_closes"),
    )
    deep = _running(levels, F.col("_opens") - F.col("_closes"), "_depth")
    ends = F.col("_closes") * (F.col("_depth") + F.col("_opens") == 1).cast("int")
    items = _running(deep.withColumn("_ends", ends), F.col("_ends"), "_item")
    whole = items.groupBy("_path", "_item").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_id", "piece"))).alias("_pieces"), F.max("_ends").alias("_ended")
    )
    whole = whole.join(whole.groupBy("_path").agg(F.min("_ended").alias("_open")), "_path")
    joined = F.array_join(F.transform("_pieces", lambda x: x["piece"]), "}")
    file = F.element_at(F.split("_path", "/"), -1)
    item = whole.select(
        file.alias("source_file"), (F.col("_item") + 1).alias("source_line"), F.when(F.col("_ended") == 1, F.concat(joined, F.lit("}"))).otherwise(joined).alias("text"), "_ended", "_open"
    )
    # a file is [ object , object ... ] and its last piece the closing bracket
    open_mark = F.when(F.col("source_line") == 1, r"^\s*\[\s*").otherwise(r"^\s*,\s*")
    end_mark = F.when(F.col("source_line") == 1, r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")
    raw = F.try_parse_json(F.regexp_replace("text", open_mark, F.lit("")))
    good = (F.col("_open") == 0) & F.rlike("text", open_mark) & F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
    where = F.concat_ws(":", "source_file", F.col("source_line").cast("string"))
    checked = F.when(F.col("_ended") == 1, F.when(good, raw).otherwise(F.raise_error(F.concat(F.lit("not an object, or no end of the array: item "), where)).cast("variant"))).otherwise(
        F.when(F.rlike("text", end_mark), F.lit(None).cast("variant")).otherwise(F.raise_error(F.concat(F.lit("malformed array at item "), where)).cast("variant"))
    )
    return item.select("source_file", "source_line", checked.alias("raw")).filter("raw IS NOT NULL")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys sorted, nulls kept; the commit protocol publishes all or nothing."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode(mode).text(path)


def read_label_archives(spark: SparkSession, paths: str | list[str], columns: tuple[str, ...]) -> DataFrame:
    """Rows of the CSV files inside ZIP archives: archive, member, row number, and the columns as named.

    A header other than `columns` ends the job. A ZIP member can't be split, so a task reads one archive."""
    fields = ", ".join(f"{c} string" for c in columns)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(n for n in archive.namelist() if n.endswith(".csv")):
                        start = 0
                        with archive.open(member) as f:
                            for part in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=50_000):
                                if tuple(part.columns) != columns:
                                    raise ValueError(f"unexpected columns in {member}: {list(part.columns)}")
                                part.insert(0, "row", range(start + 1, start + 1 + len(part)))
                                part.insert(0, "member", member)
                                part.insert(0, "archive", path.rsplit("/", 1)[-1])
                                start += len(part)
                                yield part

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(unzip, f"archive string, member string, row long, {fields}")


def first_value(raw: Column, *paths: str) -> Column:
    """Text of the first path that holds something but null, an empty text or an empty array."""
    values = [F.nullif(F.nullif(F.try_variant_get(raw, p, "string"), F.lit("")), F.lit("[]")) for p in paths]
    return F.coalesce(*values)
