"""Registered queries of the search engine over the test tables, and their SQL.

The tables are indexed once a session, into the folder the cluster shares. The
SQL builds the same postings and scores from the tables in DuckDB. Scores are
single precision in both, shown as doubles, which is exact.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.analysis import ENGLISH, Analyzer, KeywordAnalyzer, PatternAnalyzer, PerFieldAnalyzer, SimpleAnalyzer, WhitespaceAnalyzer
from lodestone.operators.batch import search_many
from lodestone.operators.indexing import postings
from lodestone.plans.parser import Operator, QueryParser
from lodestone.plans.query import UNBOUNDED, BooleanQuery, F64Range, I64Range, MatchAll, MatchNone, PhraseQuery, Query, TermQuery, excluded, included
from lodestone.reader import IndexReader
from lodestone.schema import FieldSpec, IndexSchema
from lodestone.searcher import BY_SCORE, FieldDoc, IndexSearcher, Missing, Order, SortField
from lodestone.writer import IndexWriter, WriterConfig

#: A word pattern that Java and RE2 read alike; Java's is possessive.
WORD = r"[\p{L}\p{M}\p{Nd}_]++(?:['.][\p{L}\p{M}\p{Nd}_]++)*+"
WORD_SQL = r"[\p{L}\p{M}\p{Nd}_]+(?:[''.][\p{L}\p{M}\p{Nd}_]+)*"
ANALYZER = PerFieldAnalyzer(PatternAnalyzer(WORD), {"lang": KeywordAnalyzer(), "source": KeywordAnalyzer(), "role": KeywordAnalyzer(), "event_type": KeywordAnalyzer()})

SCHEMAS = {
    "documents": IndexSchema({"doc_id": FieldSpec.numeric_i64(True), "text": FieldSpec.text(), "lang": FieldSpec.sorted_keyword(True), "source": FieldSpec.string(True), "n_chars": FieldSpec.numeric_i64(True), "quality": FieldSpec.numeric_i64(True)}),
    "events": IndexSchema({"event_id": FieldSpec.numeric_i64(True), "event_type": FieldSpec.sorted_keyword(True), "value": FieldSpec.numeric_f64(True)}),
    "part": IndexSchema({"p_partkey": FieldSpec.numeric_i64(True), "p_name": FieldSpec.text(True), "p_brand": FieldSpec.sorted_keyword(True), "p_size": FieldSpec.numeric_i64(True), "p_retailprice": FieldSpec.numeric_f64(True)}),
    "conversations": IndexSchema({"conv_id": FieldSpec.numeric_i64(True), "turns": FieldSpec.text()}),
}
KEYS = {"documents": "doc_id", "events": "event_id", "part": "p_partkey", "conversations": "conv_id"}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The rows that are indexed."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if table == "documents":
        # Only some documents have a label, so the column has gaps.
        labels = read("labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
        return read("documents").join(labels, "doc_id", "left").select(*SCHEMAS[table].fields)
    if table == "conversations":
        turns = read(table).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
        return turns.select("conv_id", F.col("t.text").alias("turns"))
    df = read(table)
    return df.withColumns({c: F.col(c).cast("long") for c, k in df.dtypes if k == "int"}).select(*SCHEMAS[table].fields)


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all machines share; only a local session may name none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="lodestone-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_PLACES: dict[tuple[str, str, str], str] = {}


def index_path(spark: SparkSession, sf_dir: str, table: str = "documents", variant: str = "") -> str:
    """Where a table's index is; it is built when it is first asked for in a session."""
    key = spark.sparkContext.applicationId, sf_dir, table + variant
    if key not in _PLACES:
        path = scratch(spark, "index")
        with IndexWriter.open(spark, path, WriterConfig(analyzer=ANALYZER), SCHEMAS[table]) as w:
            docs = source(spark, sf_dir, table)
            if not variant:
                w.add_documents(docs, order_by=[KEYS[table]])
            else:  # two segments, then deletes or updates by language, then perhaps a merge
                w.add_documents(docs.where("doc_id % 2 = 0"), order_by=["doc_id"])
                w.add_documents(docs.where("doc_id % 2 = 1"), order_by=["doc_id"])
                if variant == "updated":
                    fresh = docs.where("lang = 'es'").withColumn("text", F.concat(F.lit("the "), F.col("text")))
                    w.update_documents(fresh, "lang", ["doc_id"])
                else:
                    w.delete_by(spark.createDataFrame([("lang", "fr")], "field string, term string"))
                if variant == "merged":
                    w.force_merge(1)
        _PLACES[key] = path
    return _PLACES[key]


_OPEN: dict[str, IndexSearcher] = {}


def searcher(spark: SparkSession, sf_dir: str, table: str = "documents", variant: str = "") -> IndexSearcher:
    """An open snapshot of a table's index, as a server would keep it."""
    path = index_path(spark, sf_dir, table, variant)
    if path not in _OPEN:
        _OPEN[path] = IndexSearcher(IndexReader.open(spark, path))
    return _OPEN[path]


def named(s: IndexSearcher, hits: DataFrame, key: str, at_most: int | None = None) -> DataFrame:
    """Hits by their table's key."""
    return s.fetch(hits, key, at_most=at_most).select(key, F.col("score").cast("double").alias("score"))


T = lambda t: TermQuery("text", t)
P = lambda *terms: PhraseQuery("text", tuple(terms))
PARSED = 'the^2 +of "to the" -lang:fr'
QUERIES_BY_NAME: dict[str, tuple[Query, int]] = {
    "term_bm25": (T("the"), 20),
    "keyword_term": (TermQuery("lang", "fr"), 20),
    "match_all": (MatchAll(), 15),
    "match_none": (MatchNone(), 15),
    "bool_or": (BooleanQuery().should(T("the")).should(T("of")).should(T("and")).should(T("to")).should(T("zzzz")), 20),
    "bool_and": (BooleanQuery().must(T("the")).must(T("of")).must(T("and")), 20),
    "bool_not": (BooleanQuery().must(T("the")).must_not(T("to")), 20),
    "bool_filter": (BooleanQuery().must(T("the")).filter(TermQuery("source", "src3")), 20),
    "bool_msm": (BooleanQuery().should(T("the")).should(T("of")).should(T("der")).should(T("que")).at_least(2), 20),
    "bool_mixed": (BooleanQuery().must(T("the")).should(T("of")).should(T("and")).must_not(T("inst")).filter(TermQuery("lang", "en")), 20),
    "bool_nested": (BooleanQuery().must(BooleanQuery().should(T("the")).should(T("der"))).should(BooleanQuery().must(T("of")).must(T("and")).boost(0.5)), 20),
    "boost": (BooleanQuery().should(T("the").boost(2.5)).should(T("of").boost(0.3)), 20),
    "constant_score": (BooleanQuery().should(T("the").constant_score().boost(3)).should(T("of")), 20),
    "rewrite_dedupe": (BooleanQuery().should(T("the")).should(T("the").boost(2)).should(T("of")).should(MatchNone()), 20),
    "phrase": (P(("of", 0), ("the", 1)), 20),
    "phrase_gap": (P(("of", 0), ("the", 2)), 20),
    "phrase_repeated": (P(("the", 0), ("the", 1)), 20),
    "parser_default_or": (QueryParser("text", ANALYZER).parse(PARSED), 20),
    "parser_default_and": (QueryParser("text", ANALYZER, Operator.AND).parse("the of OR and lang:en"), 20),
    "range_with_text": (BooleanQuery().must(T("the")).must(I64Range("n_chars", included(500), excluded(2000))), 20),
}

Run = Callable[[SparkSession, str], DataFrame]


def top(name: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query, n = QUERIES_BY_NAME[name]
        s = searcher(spark, sf_dir)
        return named(s, s.search_df(query, n), "doc_id", n)

    return run


def tokenized(analyzer: Analyzer) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs.select("doc_id", F.explode(analyzer.tokens(F.col("text"))).alias("t")).select("doc_id", "t.term", F.col("t.pos").cast("long").alias("pos"))

    return run


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few files would keep few cores busy
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = postings(docs, IndexSchema({"text": FieldSpec.text()}), ANALYZER)
    return p.select("term", F.col("doc").alias("doc_id"), F.col("tf").cast("long").alias("tf"), F.col("norm").cast("long").alias("norm"), F.array_join("positions", " ").alias("positions"))


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searcher(spark, sf_dir).reader.terms().where("field = 'text'").select("term", "doc_freq", "total_term_freq")


def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = searcher(spark, sf_dir).reader
    rows = [(f, s.doc_count, s.sum_total_term_freq, s.sum_doc_freq) for f in ("text", "lang", "source") if (s := r.collection_stats(f))]
    return spark.createDataFrame(rows, "field string, doc_count long, sum_total_term_freq long, sum_doc_freq long")


def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = searcher(spark, sf_dir).reader
    return r.docs().select("doc", "doc_id").join(r.segments[0].norms("text"), "doc").select("doc_id", F.col("norm").cast("long").alias("norm"))


def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir)
    return s.fetch(s.search_df(T("the"), 10), "doc_id", "lang", "source", "n_chars", at_most=10).select("doc_id", "lang", "source", "n_chars")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir)
    rows = [(n, s.count(QUERIES_BY_NAME[n][0])) for n in ("term_bm25", "bool_or", "bool_and", "phrase", "match_all", "match_none")]
    return spark.createDataFrame(rows, "name string, n long")


def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir)
    t = s.search(T("the"), 5).total_hits
    return spark.createDataFrame([(t.value, t.relation.value)], "n long, relation string")


def matches(table: str, query: Query) -> Run:
    """All matches of a query with their scores."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = searcher(spark, sf_dir, table)
        return s.plan(query, {"_key": KEYS[table]}).select(F.col("_key").alias(KEYS[table]), F.col("score").cast("double").alias("score"))

    return run


def page(table: str, query: Query, sort: list[SortField] | None, size: int, turns: int = 1) -> Run:
    """The last of some pages; each begins where the one before ended."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, after = searcher(spark, sf_dir, table), None
        for _ in range(turns - 1):
            after = s.search_after(query, sort, size, after)[-1]
        return named(s, s.page_df(query, sort, size, after), KEYS[table], size)

    return run


def changed(variant: str) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = searcher(spark, sf_dir, variant=variant)
        return named(s, s.search_df(T("the"), 20), "doc_id", 20)

    return run


def phrase_multivalued(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir, "conversations")
    return named(s, s.search_df(PhraseQuery("turns", (("of", 0), ("the", 1))), 20), "conv_id", 20)


BATCH = [("TERM", ["the"]), ("OR", ["the", "of", "and"]), ("AND", ["the", "of"]), ("PHRASE", ["of", "the"]), ("OR", ["der", "que"]), ("PHRASE", ["in", "the"])]


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir)
    queries = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(BATCH)], "qid long, kind string, terms array<string>")
    found = search_many(s.reader, queries, 10, "text")
    return s.fetch(found, "doc_id", at_most=10 * len(BATCH)).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("score").cast("double").alias("score"), "total")


PAGES = {
    "sort_asc_missing_last": ("documents", [SortField("quality"), SortField("n_chars", Order.DESC)]),
    "sort_desc_missing_first": ("documents", [SortField("quality", Order.DESC, Missing.FIRST), SortField("lang")]),
    "sort_multi": ("part", [SortField("p_brand", Order.DESC), SortField("p_size"), SortField("p_retailprice", Order.DESC)]),
}

REGISTERED: dict[str, Run] = {
    "tokenize_pattern": tokenized(PatternAnalyzer(WORD)),
    "tokenize_whitespace": tokenized(WhitespaceAnalyzer()),
    "tokenize_simple": tokenized(SimpleAnalyzer()),
    "stop_words_positions": tokenized(PatternAnalyzer(WORD, stop_words=ENGLISH)),
    "postings_build": postings_build,
    "term_stats": term_statistics,
    "collection_stats": collection_statistics,
    "norms": norms,
    **{n: top(n) for n in QUERIES_BY_NAME},
    "phrase_multivalued": phrase_multivalued,
    "i64_range": matches("documents", I64Range("n_chars", included(200), excluded(1000))),
    "f64_range": matches("events", F64Range("value", excluded(10.0), included(50.0)).boost(1.5)),
    "range_open": matches("documents", I64Range("quality", UNBOUNDED, UNBOUNDED)),
    **{n: page(t, MatchAll(), sort, 25) for n, (t, sort) in PAGES.items()},
    "search_after_field": page("events", MatchAll(), [SortField("event_type", Order.DESC), SortField("value")], 20, 3),
    "search_after_score": page("documents", QUERIES_BY_NAME["bool_or"][0], BY_SCORE, 15, 3),
    "stored_fields": stored_fields,
    "count_exact": counts,
    "total_hits": total_hits,
    "delete_then_search": changed("deleted"),
    "update_then_search": changed("updated"),
    "compact_then_search": changed("merged"),
    "batch_search": batch,
}


# The same in SQL

_QUOTED = ", ".join(f"'{w}'" for w in ENGLISH)


def _tokens(text: str, docs: str, key: str) -> str:
    """Tokens of a table with a column ``text``."""
    return f"""tok AS (SELECT {key} AS doc, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos
    FROM (SELECT {key}, regexp_extract_all(lower(translate({text}, 'İΣ', 'iσ')), '{WORD_SQL}') AS t FROM {docs})),
len AS (SELECT doc, count(*) AS n FROM tok GROUP BY doc),
dl AS (SELECT doc, n, CASE WHEN n < 32 THEN n ELSE 24 + (((n - 24) >> (length(bin(n - 24)) - 4)) << (length(bin(n - 24)) - 4)) END AS kept FROM len),
st AS (SELECT count(*) AS docs, sum(n) AS tokens FROM len),
post AS (SELECT term, doc, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY term, doc),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
inv AS (SELECT doc, CAST(1 AS FLOAT) / (CAST(1.2 AS FLOAT) * (CAST(0.25 AS FLOAT) + CAST(0.75 AS FLOAT) * CAST(kept AS FLOAT) / CAST(CAST(tokens AS DOUBLE) / docs AS FLOAT))) AS f FROM dl, st)"""


BASE = "WITH " + _tokens("text", "documents", "doc_id")
IDF = "CAST(ln(1 + (st.docs - df.n + 0.5::DOUBLE) / (df.n + 0.5::DOUBLE)) AS FLOAT)"


def _bm25(w: str, tf: str, f: str) -> str:
    return f"({w} - {w} / (CAST(1 AS FLOAT) + CAST({tf} AS FLOAT) * {f}))"


def _leaf(term: str, boost: float = 1.0) -> str:
    """doc, s of a term."""
    w = f"(CAST({boost} AS FLOAT) * {IDF})"
    return f"(SELECT post.doc, {_bm25(w, 'post.tf', 'inv.f')} AS s FROM post JOIN df USING (term) JOIN inv ON inv.doc = post.doc, st WHERE post.term = '{term}')"


def _keyword(column: str, value: str, boost: float = 1.0) -> str:
    """doc, s of an exact term: frequency and length are 1, and so is the average length."""
    f = "(CAST(1 AS FLOAT) / (CAST(1.2 AS FLOAT) * (CAST(0.25 AS FLOAT) + CAST(0.75 AS FLOAT))))"
    w = f"(CAST({boost} AS FLOAT) * CAST(ln(1 + ((SELECT count({column}) FROM documents) - k.n + 0.5::DOUBLE) / (k.n + 0.5::DOUBLE)) AS FLOAT))"
    return f"(SELECT doc_id AS doc, {_bm25(w, '1', f)} AS s FROM documents, (SELECT count(*) AS n FROM documents WHERE {column} = '{value}') k WHERE {column} = '{value}')"


def _phrase(first: str, second: str, gap: int, tok: str = "tok") -> str:
    """doc, s of two terms at a distance."""
    w = f"""(SELECT CAST(sum(CAST({IDF} AS DOUBLE)) AS FLOAT) FROM (VALUES ('{first}'), ('{second}')) v(term) JOIN df USING (term), st)"""
    return f"""(SELECT p.doc, {_bm25(w, 'p.tf', 'inv.f')} AS s FROM (SELECT a.doc, count(*) AS tf FROM {tok} a JOIN {tok} b ON a.doc = b.doc AND b.pos = a.pos + {gap}
    WHERE a.term = '{first}' AND b.term = '{second}' GROUP BY a.doc) p JOIN inv ON inv.doc = p.doc)"""


def _top(body: str, n: int, key: str = "doc_id", base: str = BASE) -> str:
    return f"{base}\nSELECT doc AS {key}, CAST(score AS DOUBLE) AS score FROM ({body}) ORDER BY score DESC, doc LIMIT {n}"


def _all(*leaves: str) -> str:
    """The leaves side by side: doc, s0, s1 ..."""
    names = [f"x{i}" for i in range(len(leaves))]
    docs = " UNION ".join(f"SELECT doc FROM {n}" for n in names)
    with_ = ", ".join(f"{n} AS {leaf}" for n, leaf in zip(names, leaves, strict=True))
    joins = " ".join(f"LEFT JOIN {n} ON {n}.doc = d.doc" for n in names)
    cols = ", ".join(f"{n}.s AS s{i}" for i, n in enumerate(names))
    return f"(WITH {with_} SELECT d.doc, {cols} FROM ({docs}) d {joins})"


def _sum(*names: str) -> str:
    return "CAST(" + " + ".join(f"coalesce(CAST({n} AS DOUBLE), 0)" for n in names) + " AS FLOAT)"


def _req_opt(req: str, opt: list[str]) -> str:
    some = " OR ".join(f"{o} IS NOT NULL" for o in opt)
    return f"CASE WHEN {some} THEN CAST(CAST({req} AS DOUBLE) + CAST({_sum(*opt)} AS DOUBLE) AS FLOAT) ELSE {req} END"


_OR4 = f"SELECT doc, {_sum('s0', 's1', 's2', 's3')} AS score FROM {_all(*map(_leaf, ('the', 'of', 'and', 'to')))}"
_AND3 = f"SELECT doc, {_sum('s0', 's1', 's2')} AS score FROM {_all(*map(_leaf, ('the', 'of', 'and')))} WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL"
_ZERO = "CASE WHEN value = 0 THEN signbit(value)::INT ELSE 0 END"

ORACLES: dict[str, str] = {
    "tokenize_pattern": f"{BASE} SELECT doc AS doc_id, term, pos FROM tok",
    "tokenize_whitespace": r"SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^\t-\r\x1c-\x1f \x{85}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]+') AS t FROM documents)",
    "tokenize_simple": r"SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(translate(text, 'İΣ', 'iσ')), '\p{L}+') AS t FROM documents)",
    "stop_words_positions": f"{BASE} SELECT doc AS doc_id, term, pos FROM tok WHERE term NOT IN ({_QUOTED})",
    "postings_build": f"""{BASE} SELECT term, doc AS doc_id, tf, CASE WHEN n < 32 THEN n ELSE 24 + ((((n - 24) >> (length(bin(n - 24)) - 4)) & 7) | ((length(bin(n - 24)) - 3) << 3)) END AS norm,
    array_to_string(positions, ' ') AS positions FROM post JOIN len USING (doc)""",
    "term_stats": f"{BASE} SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_term_freq FROM post GROUP BY term",
    "collection_stats": f"""{BASE} SELECT 'text' AS field, docs AS doc_count, CAST(tokens AS BIGINT) AS sum_total_term_freq, (SELECT count(*) FROM post) AS sum_doc_freq FROM st
    UNION ALL SELECT 'lang', count(lang), count(lang), count(lang) FROM documents UNION ALL SELECT 'source', count(source), count(source), count(source) FROM documents""",
    "norms": f"{BASE} SELECT doc AS doc_id, CASE WHEN n < 32 THEN n ELSE 24 + ((((n - 24) >> (length(bin(n - 24)) - 4)) & 7) | ((length(bin(n - 24)) - 3) << 3)) END AS norm FROM len",
    "term_bm25": _top(f"SELECT doc, s AS score FROM {_leaf('the')}", 20),
    "keyword_term": _top(f"SELECT doc, s AS score FROM {_keyword('lang', 'fr')}", 20),
    "match_all": "SELECT doc_id, 1::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 15",
    "match_none": "SELECT doc_id, 1::DOUBLE AS score FROM documents WHERE false",
    "bool_or": _top(_OR4, 20),
    "bool_and": _top(_AND3, 20),
    "bool_not": _top(f"SELECT doc, s0 AS score FROM {_all(_leaf('the'), _leaf('to'))} WHERE s0 IS NOT NULL AND s1 IS NULL", 20),
    "bool_filter": _top(f"SELECT doc, s0 AS score FROM {_all(_leaf('the'), _keyword('source', 'src3'))} WHERE s0 IS NOT NULL AND s1 IS NOT NULL", 20),
    "bool_msm": _top(f"SELECT doc, {_sum('s0', 's1', 's2', 's3')} AS score FROM {_all(*map(_leaf, ('the', 'of', 'der', 'que')))} WHERE (s0 IS NOT NULL)::INT + (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT >= 2", 20),
    "bool_mixed": _top(f"SELECT doc, {_req_opt(_sum('s0'), ['s1', 's2'])} AS score FROM {_all(_leaf('the'), _leaf('of'), _leaf('and'), _leaf('inst'), _keyword('lang', 'en'))} WHERE s0 IS NOT NULL AND s3 IS NULL AND s4 IS NOT NULL", 20),
    "bool_nested": _top(
        f"SELECT doc, CASE WHEN s2 IS NOT NULL AND s3 IS NOT NULL THEN CAST(CAST({_sum('s0', 's1')} AS DOUBLE) + CAST({_sum('s2', 's3')} AS DOUBLE) AS FLOAT) ELSE {_sum('s0', 's1')} END AS score FROM {_all(_leaf('the'), _leaf('der'), _leaf('of', 0.5), _leaf('and', 0.5))} WHERE s0 IS NOT NULL OR s1 IS NOT NULL", 20
    ),
    "boost": _top(f"SELECT doc, {_sum('s0', 's1')} AS score FROM {_all(_leaf('the', 2.5), _leaf('of', 0.3))}", 20),
    "constant_score": _top(f"SELECT doc, {_sum('(CASE WHEN s0 IS NOT NULL THEN 3.0 END)', 's1')} AS score FROM {_all(_leaf('the'), _leaf('of'))}", 20),
    "rewrite_dedupe": _top(f"SELECT doc, {_sum('s0', 's1')} AS score FROM {_all(_leaf('the', 3.0), _leaf('of'))}", 20),
    "phrase": _top(f"SELECT doc, s AS score FROM {_phrase('of', 'the', 1)}", 20),
    "phrase_gap": _top(f"SELECT doc, s AS score FROM {_phrase('of', 'the', 2)}", 20),
    "phrase_repeated": _top(f"SELECT doc, s AS score FROM {_phrase('the', 'the', 1)}", 20),
    "parser_default_or": _top(f"SELECT doc, {_req_opt(_sum('s1'), ['s0', 's2'])} AS score FROM {_all(_leaf('the', 2.0), _leaf('of'), _phrase('to', 'the', 1), _keyword('lang', 'fr'))} WHERE s1 IS NOT NULL AND s3 IS NULL", 20),
    "parser_default_and": _top(f"SELECT doc, {_req_opt(_sum('s0', 's3'), ['s1', 's2'])} AS score FROM {_all(_leaf('the'), _leaf('of'), _leaf('and'), _keyword('lang', 'en'))} WHERE s0 IS NOT NULL AND s3 IS NOT NULL", 20),
    "range_with_text": _top(f"SELECT x.doc, CAST(CAST(s AS DOUBLE) + 1 AS FLOAT) AS score FROM {_leaf('the')} x JOIN documents d ON d.doc_id = x.doc WHERE n_chars >= 500 AND n_chars < 2000", 20),
    "phrase_multivalued": _top(f"SELECT doc, s AS score FROM {_phrase('of', 'the', 1)}", 20, "conv_id", "WITH joined AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id), " + _tokens("text", "joined", "conv_id")),
    "i64_range": "SELECT doc_id, 1::DOUBLE AS score FROM documents WHERE n_chars >= 200 AND n_chars < 1000",
    "f64_range": "SELECT event_id, 1.5::DOUBLE AS score FROM events WHERE value > 10 AND value <= 50",
    "range_open": "SELECT doc_id, 1::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "sort_asc_missing_last": "SELECT doc_id, 1::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 25",
    "sort_desc_missing_first": "SELECT doc_id, 1::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, lang ASC NULLS LAST, doc_id LIMIT 25",
    "sort_multi": "SELECT p_partkey, 1::DOUBLE AS score FROM part ORDER BY p_brand DESC NULLS LAST, p_size ASC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 25",
    "search_after_field": f"SELECT event_id, 1::DOUBLE AS score FROM events ORDER BY event_type DESC NULLS LAST, value ASC NULLS LAST, {_ZERO} DESC, event_id LIMIT 20 OFFSET 40",
    "search_after_score": f"{BASE} SELECT doc AS doc_id, CAST(score AS DOUBLE) AS score FROM ({_OR4}) ORDER BY score DESC, doc LIMIT 15 OFFSET 30",
    "stored_fields": f"{BASE}, best AS (SELECT doc FROM {_leaf('the')} ORDER BY s DESC, doc LIMIT 10) SELECT doc_id, lang, source, n_chars FROM best JOIN documents ON doc_id = doc",
    "count_exact": f"""{BASE} SELECT 'term_bm25' AS name, count(*) AS n FROM {_leaf('the')} UNION ALL SELECT 'bool_or', count(*) FROM ({_OR4}) UNION ALL SELECT 'bool_and', count(*) FROM ({_AND3})
    UNION ALL SELECT 'phrase', count(*) FROM {_phrase('of', 'the', 1)} UNION ALL SELECT 'match_all', count(*) FROM documents UNION ALL SELECT 'match_none', 0""",
    "total_hits": f"{BASE} SELECT count(*) AS n, 'eq' AS relation FROM {_leaf('the')}",
    # Deleted documents still count in the statistics until segments are merged; numbers go by segment, so ties do, too.
    "delete_then_search": f"{BASE} SELECT doc AS doc_id, CAST(s AS DOUBLE) AS score FROM {_leaf('the')} x JOIN documents d ON d.doc_id = x.doc WHERE d.lang <> 'fr' ORDER BY s DESC, doc % 2, doc LIMIT 20",
    "compact_then_search": "WITH live AS (SELECT * FROM documents WHERE lang <> 'fr'), " + _tokens("text", "live", "doc_id") + f" SELECT doc AS doc_id, CAST(s AS DOUBLE) AS score FROM {_leaf('the')} ORDER BY s DESC, doc % 2, doc LIMIT 20",
    "update_then_search": "WITH kept AS (SELECT doc_id * 2 AS doc_id, text FROM documents UNION ALL SELECT doc_id * 2 + 1, 'the ' || text FROM documents WHERE lang = 'es'), "
    + _tokens("text", "kept", "doc_id")
    + f""" SELECT doc // 2 AS doc_id, CAST(s AS DOUBLE) AS score FROM {_leaf('the')} x JOIN documents d ON d.doc_id = x.doc // 2 WHERE d.lang <> 'es' OR x.doc % 2 = 1
    ORDER BY s DESC, CASE WHEN x.doc % 2 = 1 THEN 2 ELSE (doc // 2) % 2 END, doc // 2 LIMIT 20""",
}


def _batch_sql() -> str:
    parts = []
    for i, (kind, terms) in enumerate(BATCH):
        if kind == "TERM":
            body = f"SELECT doc, s AS score FROM {_leaf(terms[0])}"
        elif kind == "PHRASE":
            body = f"SELECT doc, s AS score FROM {_phrase(*terms, 1)}"
        else:
            all_ = " AND ".join(f"s{k} IS NOT NULL" for k in range(len(terms))) if kind == "AND" else "true"
            body = f"SELECT doc, {_sum(*(f's{k}' for k in range(len(terms))))} AS score FROM {_all(*map(_leaf, terms))} WHERE {all_}"
        parts.append(f"SELECT {i} AS qid, doc, score FROM ({body})")
    union = " UNION ALL ".join(parts)
    return f"""{BASE} SELECT CAST(qid AS BIGINT) AS qid, rank, doc AS doc_id, CAST(score AS DOUBLE) AS score, total FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank,
    count(*) OVER (PARTITION BY qid) AS total FROM ({union})) WHERE rank <= 10"""


ORACLES["batch_search"] = _batch_sql()
