"""Operator 6: removal of repeated runs of lines by winnowing (native).

Each window is the shortest run of lines from a line on (or up to a line) that has LEAST_WORDS words.
The line with the least hash in a window is its fingerprint, kept with its position; neighbouring windows choose the same one, so few
positions remain. A run of that many words, wherever it is repeated, has the same windows and so the same fingerprints.
Positions are joined on the fingerprint; around those that occur again, windows forward and backward are matched by
their content and together extend each match to both ends of the run. Later runs go.
Matching goes by content, not from position to position: copies of a passage would be paired all with all, and its
first position alone does not show how far the later ones agree with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm.common import unused, words
from alertloom.session import materialize

LEAST_WORDS = 50


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash, pos: every line that stands in a later repeated run (pos from 0)."""
    # hashed and split in front of the explosion, so that no line carries its text
    lines = (
        docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.split(F.col(text), "\n").alias("lines"))
        .select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
        .select(
            "doc_id", "text_hash", "pos", F.xxhash64(F.trim("line")).alias("h"), F.size(words(F.col("line"))).alias("words")
        )
        .filter("words > 0")
        .dropDuplicates(["doc_id", "text_hash", "pos"])
    )
    own = Window.partitionBy("doc_id", "text_hash")
    upto = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(lines.withColumn("to", F.sum("words").over(upto)).withColumn("from", F.col("to") - F.col("words")), "lines")

    def window(frame: Window, backward: bool) -> DataFrame:
        rows = placed.select(
            "doc_id",
            "text_hash",
            F.min("pos").over(frame).alias("first"),
            F.max("pos").over(frame).alias("last"),
            F.sum("words").over(frame).alias("words"),
            F.min(F.struct("h", "pos")).over(frame).alias("least"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("content"),
        ).filter(F.col("words") >= least_words)
        return rows.select("doc_id", "text_hash", "first", "last", "least.*", "content", F.lit(backward).alias("backward"))

    forward = own.orderBy("from").rangeBetween(0, least_words - 1)
    backward = own.orderBy("to").rangeBetween(1 - least_words, 0)
    windows = materialize(window(forward, False).unionByName(window(backward, True)), "line-windows")
    # a fingerprint occurs again where its positions differ
    place = F.struct("doc_id", "text_hash", "pos")
    places = windows.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    again = windows.join(places.filter("a <> b").select("h"), "h", "left_semi")
    at = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("first"))
    origin = again.groupBy("content", "backward").agg(F.min(at).alias("origin"), F.max(at).alias("end")).filter("origin <> end")
    later = again.join(origin.drop("end"), ["content", "backward"]).filter(at != F.col("origin"))
    return later.select(
        "doc_id", "text_hash", F.explode(F.sequence("first", "last")).alias("pos")
    ).distinct()


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """All columns of the documents, the text without later repeated runs, and n_lines_removed.

    The first occurrence of a run, by key, then text hash, then line, stays. Blank lines and lines
    outside such runs stay as they are. Null texts stay null; empty texts stay empty; null keys come first;
    repeated rows (same key and text) are one document and stay alike; empty tables give no rows;
    n_lines_removed replaces a column of that name. The lines of one text are counted in one task, without the text.
    """
    k, h, marked = unused(docs, "_k", "_h", "_gone")
    gone = (
        repeated_lines(docs, key, text, least_words)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("pos").alias(marked))
        .select(F.col("doc_id").alias(k), F.col("text_hash").alias(h), marked)
    )

    def kept_of(lines: Column) -> Column:
        index = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(marked))
        return F.array_join(F.transform(index, lambda i: lines[i]), "\n")

    # the lines are split once, as what a function is applied to
    kept = F.element_at(F.transform(F.array(F.split(F.col(text), "\n")), kept_of), 1)
    joined = docs.drop("n_lines_removed").join(gone, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text)) == F.col(h)), "left")
    return joined.withColumns(
        {
            text: F.when(F.col(marked).isNull(), F.col(text)).otherwise(kept),
            "n_lines_removed": F.coalesce(F.size(marked), F.lit(0)).cast("long"),
        }
    ).drop(k, h, marked)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select(
        "doc_id",
        "n_lines_removed",
        F.length("text").cast("long").alias("kept_chars"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


#: String functions that take regular expressions need \s spelt out to match the words of the library.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
n AS (SELECT doc_id, pos, md5(trim(line, ' ')) AS h, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS words FROM l),
p AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS "to" FROM n WHERE words > 0),
q AS (SELECT *, "to" - words AS "from" FROM p),
w AS (
  SELECT doc_id, min(pos) OVER f AS first, max(pos) OVER f AS last, sum(words) OVER f AS words, string_agg(h, ',' ORDER BY pos) OVER f AS content, false AS backward
  FROM q WINDOW f AS (PARTITION BY doc_id ORDER BY "from" RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f, max(pos) OVER f, sum(words) OVER f, string_agg(h, ',' ORDER BY pos) OVER f, true
  FROM q WINDOW f AS (PARTITION BY doc_id ORDER BY "to" RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, row_number() OVER (PARTITION BY content, backward ORDER BY doc_id, first) AS k FROM w WHERE words >= 50),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM r WHERE k > 1),
t AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NULL OR l.pos IS NULL AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos),
o AS (SELECT doc_id, count(*) FILTER (WHERE NOT kept)::BIGINT AS n_lines_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS text FROM t GROUP BY doc_id)
SELECT doc_id, n_lines_removed, length(text)::BIGINT AS kept_chars, md5(text) AS kept_md5 FROM o
"""
