"""Operator 11: ranked lexical search, impact-ordered and score-at-a-time.

Postings are grouped by their exact impact. For each item the groups of its terms are taken in descending order of what they
add to a score, in rounds of growing size. After a round it is known how much the groups that are left could add at most: once that is less than the
score of the tenth document found, no document unseen can be among the ten, and of those seen only the ones whose
bound reaches that score. Their scores are completed from their own terms.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm.common import ascii_lower
from alertloom.session import discard, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Different terms of all items that go to every task, to drop others early. With more terms nothing is dropped there.
MOST_TERMS = 500_000
#: Postings that an item's first round takes, and by how much each round takes more.
FIRST, GROWTH = 4096, 16
K1_SCALE = 1_000_000_000


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term, qtf: how often an item has a term. Null texts have none; rows with one id are one item, rows without id are none."""
    terms = F.explode(F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({TERM})")))
    rows = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item_id"), terms.alias("term"))
    return rows.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def forward_index(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text", most_terms: int = MOST_TERMS) -> DataFrame:
    """One row a document, as a table: row (a number of its own), doc_id, n (all terms of the whole text) and arrays terms and tfs of the terms
    in `wanted` (column term). Null and empty texts have no terms; repeated rows stay apart."""
    names = wanted.select("term").distinct()
    few = names.limit(most_terms + 1).count() <= most_terms
    keep = frozenset(r[0] for r in names.collect()) if few else None  # at most most_terms strings
    ctx = docs.sparkSession.sparkContext
    told = ctx.broadcast(keep)
    upper = {ord(c): c.lower() for c in string.ascii_uppercase}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, have = re.compile(TERM).findall, told.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, ends, terms, tfs = [], [0], [], []
                for text_ in part.column(1).cast(pa.binary() if part.column(1).type == pa.string() else pa.large_binary()).to_pylist():
                    found = find(text_.decode(errors="replace").translate(upper)) if text_ else []
                    counts = Counter(found if have is None else filter(have.__contains__, found))
                    sizes.append(len(found))
                    terms += counts.keys()
                    tfs += counts.values()
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((terms, pa.string()), (tfs, pa.int64()))]
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    index = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, terms array<string>, tfs array<long>"
    )
    return materialize(index.withColumn("row", F.monotonically_increasing_id()), "forward-index")


def _impacts(index: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """row, term, impact: what one occurrence of the term in an item adds to the document's score."""
    postings = index.select("row", "n", F.inline(F.arrays_zip("terms", "tfs"))).withColumnsRenamed({"terms": "term", "tfs": "tf"})
    m = F.expr(f"25 + ((75 * n * {n_docs}L) div {n_terms}L)")
    told = postings.withColumn("m", m).join(weights, "term")
    return told.select("row", "term", F.expr(f"weight * (({K1_SCALE}L * tf) div (1000 * tf + 8 * m))").alias("impact"))


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    first: int = FIRST, most_terms: int = MOST_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with the highest scores above 0, equal scores by doc_id, nulls last.

    Every row of docs is a document, a repeated one ranks twice; a null id is kept. Documents without terms count for nothing; without any,
    or without items, there are no rows. Scores are exact. Texts are read whole, once."""
    spark = docs.sparkSession
    queries = materialize(item_terms(items, item, item_text), "item-terms")
    index = forward_index(docs, queries, key, text, most_terms)
    n_docs, n_terms = index.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = "item_id long, rank int, doc_id long, score long"
    if not n_docs:
        return spark.createDataFrame([], out)
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2)).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = df.join(queries.select("term").distinct(), "term").select("term", weight.alias("weight")).filter("weight > 0")
    weights = materialize(weights, "term-weights")
    # sorted, so that a round reads only the pages of the impacts that it takes
    impacts = _impacts(index, weights, n_docs, n_terms).filter("impact > 0").sortWithinPartitions(F.desc("impact"))
    impacts = materialize(impacts, "impacts")
    groups = materialize(impacts.groupBy("term", "impact").agg(F.count(F.lit(1)).alias("n")), "impact-groups")

    # each item's groups, the ones that add most first; `taken` counts postings with all before, `rest` is what the term's next group adds
    adds = queries.join(groups, "term").withColumn("adds", F.col("qtf") * F.col("impact"))
    order = Window.partitionBy("item_id").orderBy(F.desc("adds"), "term")
    ahead = Window.partitionBy("item_id", "term").orderBy(F.desc("adds"))
    ranked = adds.withColumn("taken", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", F.lead("adds", 1, 0).over(ahead))
    ranked = materialize(ranked.select("item_id", "term", "qtf", "impact", "adds", F.coalesce("taken", F.lit(0)).alias("taken"), "rest"), "item-groups")
    open_items = materialize(ranked.select("item_id").distinct(), "open-items")
    found, size = [], first
    while not open_items.isEmpty():
        done, open_items = _round(impacts, ranked, open_items, size, top)
        found.append(done)
        size *= GROWTH
    if not found:
        return spark.createDataFrame([], out)
    chosen = found[0]
    for more in found[1:]:
        chosen = chosen.unionByName(more)
    scores = _complete(index, impacts, queries, chosen)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranks = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranks.select("item_id", "rank", "doc_id", "score")


def _round(impacts: DataFrame, ranked: DataFrame, items: DataFrame, size: int, top: int) -> tuple[DataFrame, DataFrame]:
    """Takes the groups of each item that begin within its first `size` postings. Gives the candidates (item_id, row) of the items that are proven
    now, and the other items."""
    mine = ranked.join(items, "item_id", "left_semi")
    begun = mine.filter(F.col("taken") < size)
    # the least group taken of each term, and what is left of it
    cuts = begun.groupBy("item_id", "term").agg(F.max("qtf").alias("qtf"), F.min("impact").alias("cut"), F.min("rest").alias("rest"))
    heads = mine.groupBy("item_id", "term").agg(F.max("adds").alias("most"))
    cuts = materialize(cuts.join(heads, ["item_id", "term"], "right").withColumn("rest", F.coalesce("rest", "most")), "cuts")
    left = cuts.groupBy("item_id").agg(F.sum("rest").alias("left"))
    least = cuts.agg(F.min("cut")).first()[0]
    taken = impacts.filter(F.col("impact") >= least).join(cuts.filter("cut IS NOT NULL"), "term").filter("impact >= cut")
    seen = taken.groupBy("item_id", "row").agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"), F.sum("rest").alias("known"))
    seen = materialize(seen, "accumulators")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"))
    nth = seen.select("item_id", "score").withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= top)
    floor = nth.groupBy("item_id").agg(F.min(F.when(F.col("_k") == top, F.col("score"))).alias("floor"))
    state = left.join(floor, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    state = materialize(state.withColumn("proven", (F.col("left") < F.col("floor")) | (F.col("left") == 0)), "proofs")
    # a document's bound: its score, and of the terms that it was not seen with what is left
    reach = seen.join(state.filter("proven"), "item_id").filter(F.col("score") + F.col("left") - F.col("known") >= F.col("floor"))
    done = materialize(reach.select("item_id", "row"), "candidates")
    still = materialize(state.filter(~F.col("proven")).select("item_id"), "open-items")
    discard(seen)
    return done, still


def _complete(index: DataFrame, impacts: DataFrame, queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """item_id, row, doc_id and the whole score of each candidate."""
    rows = materialize(chosen.select("row").distinct(), "candidate-rows")
    own = impacts.join(rows, "row", "left_semi")
    whole = chosen.join(own, "row").join(queries, ["item_id", "term"]).groupBy("item_id", "row").agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"))
    return whole.join(index.select("row", "doc_id"), "row")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every score of every document.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*)::BIGINT AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
t AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, g GROUP BY term, n_docs),
s AS (SELECT q.item_id, t.r, t.doc_id, sum(q.qtf * w.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * t.n * g.n_docs) // g.n_terms))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
