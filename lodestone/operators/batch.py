"""Many queries in one plan.

The leaves of all queries are joined to the postings, matches are aggregated
by query and document, and a ranked window keeps the best of each query. The
window's limit works in every task before rows meet, so that a query with very
many hits sends no more than a few rows a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import average_length, factor_array, length_factors
from lodestone.reader import IndexReader

#: Leaves up to so many are broadcast (some tens of bytes each).
BROADCAST_LEAVES, PUSHED_LEAVES = 500_000, 100


def leaves(reader: IndexReader, queries: DataFrame, field: str, doc_count: int) -> DataFrame:
    """qid, kind, size, term, idf, slots (offsets in the phrase), n (occurrences in the query)."""
    each = queries.select("qid", "kind", F.size("terms").alias("size"), F.posexplode("terms").alias("slot", "term"))
    each = each.groupBy("qid", "kind", "size", "term").agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.count("*").alias("n"))
    terms = reader.terms().where(F.col("field") == field).select("term", "doc_freq")
    # Rounded to single precision, as a driver computing one query does.
    idf = F.log(1 + (F.lit(float(doc_count)) - F.col("doc_freq") + 0.5) / (F.col("doc_freq") + 0.5)).cast("float")
    return each.join(terms, "term").select("qid", "kind", "size", "term", "slots", "n", idf.alias("idf"))


def search_many(reader: IndexReader, queries: DataFrame, n: int = 10, field: str = "body") -> DataFrame:
    """qid, rank (from 1), doc, score, total of the best ``n`` hits of every query.

    ``queries``: qid, kind (TERM, AND, OR or PHRASE), terms (analysed). TERM is
    its first term. Queries without hits have no rows.
    """
    stats = reader.collection_stats(field)
    spark = queries.sparkSession
    if stats is None:
        return spark.createDataFrame([], "qid bigint, rank int, doc bigint, score float, total bigint")
    queries = queries.select("qid", "kind", F.when(F.col("kind") == "TERM", F.slice("terms", 1, 1)).otherwise(F.col("terms")).alias("terms"))
    found = leaves(reader, queries, field, stats.doc_count)
    count = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    phrases = queries.where("kind = 'PHRASE'").limit(1).count() > 0
    posted = reader.postings().where(F.col("field") == field)
    if count <= PUSHED_LEAVES:  # few terms reach the scan, which then reads no others
        posted = posted.where(F.col("term").isin([r["term"] for r in found.select("term").distinct().collect()]))
    if count <= BROADCAST_LEAVES:
        found = F.broadcast(found)
    factors = factor_array(length_factors(average_length(stats.sum_total_term_freq, stats.doc_count)))
    factor = F.get(factors, F.col("norm").cast("int"))
    one = F.lit(1).cast("float")
    # A term that a query repeats weighs so many times its rarity.
    weight = F.when(F.col("n") == 1, F.col("idf")).otherwise((F.col("idf").cast("double") * F.col("n")).cast("float"))
    score = weight - (weight / (one + F.col("tf").cast("float") * factor)).cast("float")
    # Keys and sums of fixed width, which are hashed in place; what a query is goes with its number.
    plain = posted.select("term", "doc", "tf", "norm").join(found.where("kind <> 'PHRASE'") if phrases else found, "term")
    plain = plain.groupBy("qid", "kind", "size", "doc").agg(F.sum("n").alias("slots"), F.sum(score.cast("double")).cast("float").alias("score"))
    rows = plain.where((F.col("kind") == "OR") | (F.col("slots") == F.col("size"))).select("qid", "doc", "score")
    if phrases:
        # Only phrases read positions; they move as the starts that each slot allows.
        starts = F.transform("slots", lambda o: F.when(o == 0, F.col("positions")).otherwise(F.transform("positions", lambda p: p - o)))
        placed = posted.select("term", "doc", "norm", "positions").join(found.where("kind = 'PHRASE'"), "term")
        placed = placed.select("qid", "doc", "size", "n", "idf", factor.alias("factor"), starts.alias("starts"))
        # Starts that all slots share are counted in the aggregation itself: above it, every use would count them again.
        each = F.flatten(F.collect_list("starts"))
        shared = F.aggregate(F.slice(each, 2, 1 << 30), F.element_at(each, 1), F.array_intersect)
        freq = F.when(F.sum("n") == F.col("size"), F.size(shared)).otherwise(0)
        aggs = [freq.alias("freq"), F.sum(F.col("idf").cast("double") * F.col("n")).cast("float").alias("idfs"), F.first("factor").alias("factor")]
        placed = placed.groupBy("qid", "size", "doc").agg(*aggs).where("freq > 0")
        phrase = F.col("idfs") - (F.col("idfs") / (one + F.col("freq").cast("float") * F.col("factor"))).cast("float")
        rows = rows.unionByName(placed.select("qid", "doc", phrase.alias("score")))
    rows = reader.live(rows.select("qid", "doc", "score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc"))
    top = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    # Counting scores keeps this branch like the other, so that both read one exchange.
    totals = rows.groupBy("qid").agg(F.count("score").alias("total"))
    return top.join(totals, "qid").select("qid", "rank", "doc", "score", "total")


def results(found: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each query with its hits, for ``write_dump``."""
    hits = found.groupBy("qid").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("hits"))
    out = queries.join(hits, "qid", "left")
    return out.select("qid", "kind", "terms", F.coalesce("total", F.lit(0)).alias("total"), F.lit("eq").alias("relation"), F.coalesce("hits", F.array().cast("array<struct<rank:int,doc:bigint,score:float>>")).alias("hits"))
