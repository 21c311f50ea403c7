"""More registered queries: analyzers, query strings, rewriting, sources and sinks, the life of an index, and what is refused."""

from __future__ import annotations

import contextlib
import io
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.__main__ import arguments
from lodestone.__main__ import run as command
from lodestone.catalog import ANALYZER, BASE, IDF, SCHEMAS, P, Run, T, _all, _bm25, _leaf, _phrase, _req_opt, _sum, _top, named, scratch, searcher, source, tokenized
from lodestone.document import Document, Field, Term
from lodestone.errors import LodestoneError
from lodestone.functions.analysis import ENGLISH, FunctionAnalyzer, StandardAnalyzer
from lodestone.functions.similarity import Bm25, average_length, decode_length, encode_length, encoded_length, idf, idf_sum
from lodestone.operators.batch import results, search_many
from lodestone.plans.parser import Operator, QueryParser
from lodestone.plans.query import BooleanQuery, F64Range, I64Range, MatchAll, MatchNone, PhraseQuery, Query, TermQuery, included
from lodestone.reader import IndexReader
from lodestone.schema import FieldSpec, IndexSchema
from lodestone.searcher import FieldDoc, IndexSearcher, SortField
from lodestone.sources.files import hits_json, read_json_lines, read_lines, read_queries, write_dump, write_hits
from lodestone.writer import IndexWriter, MergePolicy, WriterConfig

# Query strings

STRINGS: dict[str, tuple[str, Operator]] = {
    "parser_escapes": (r'\the "of \the" o\f \AND and', Operator.OR),
    "parser_grouping": ("(the of)^2 AND (and OR to)", Operator.OR),
    "parser_precedence": ("the && of || and", Operator.OR),
    "parser_single_clause": ("+the", Operator.OR),
    "parser_lone_negative": ("-the", Operator.OR),
    "parser_multi_token": ("of,the", Operator.OR),
    "parser_multi_token_and": ("of,the", Operator.AND),
    "parser_or_under_and": ("the of || and", Operator.AND),
    "parser_field_group": ("lang : (fr de) the", Operator.OR),
    "parser_nothing_left": ("... the", Operator.OR),
    "parser_wifi": ("the of-the NOT to", Operator.OR),
}


def parsed(name: str, n: int = 20) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, operator = STRINGS[name]
        s = searcher(spark, sf_dir)
        return named(s, s.search_df(QueryParser("text", ANALYZER, operator).parse(text), n), "doc_id", n)

    return run


def stop_word_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quoted phrase whose stop word leaves a gap between the words around it."""
    s = searcher(spark, sf_dir)
    stopping = catalog.PatternAnalyzer(catalog.WORD, stop_words=["and"])
    return named(s, s.search_df(QueryParser("text", stopping).parse('"of and the"'), 20), "doc_id", 20)


BAD = ["the*", "t?he", "[a TO b]", "{a", "the~", '"of the"~2', '"of the', "(the", "the)", "the^", "the^x", "a:b:c", "lang:", "AND the", "the\\", "!", "the +"]
GOOD = ["", "...", "the", "of-the", "a : b", "the^2", "the^inf", r"\*", "+(the -of)"]


def parser_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def refused(text: str) -> bool:
        try:
            QueryParser("text", ANALYZER).parse(text)
        except LodestoneError as e:
            assert type(e).__name__ == "QueryParse"
            return True
        return False

    return spark.createDataFrame([(t, refused(t)) for t in [*BAD, *GOOD]], "query string, refused boolean")


# Rewriting: the query of each rule, with five hits at most

RULES: dict[str, Query] = {
    "R1": T("the").boost(1.0),
    "R2": MatchNone().boost(2.0),
    "R3": T("the").boost(1.5).boost(2.0),
    "R4": MatchNone().constant_score(),
    "R5": T("the").boost(3.0).constant_score().constant_score(),
    "R6": PhraseQuery("text", (("the", 0),)),
    "R6 empty": PhraseQuery("text", ()),
    "R7": BooleanQuery().should(T("the")).should(MatchNone()).must_not(MatchNone()),
    "R7 required": BooleanQuery().must(T("the")).must(MatchNone()),
    "R8": BooleanQuery().must_not(T("the")),
    "R9": BooleanQuery().must(T("of")).should(T("the")).at_least(2),
    "R10": BooleanQuery().filter(T("the")),
    "R10 must": BooleanQuery().must(T("the")).at_least(1),
    "R11": BooleanQuery().must(T("the")).must(T("the").boost(2)).must(T("of")),
    "R12": BooleanQuery().must(T("the")).filter(T("the")).filter(T("the")).must(T("of")),
    "R13": BooleanQuery().must(BooleanQuery().must(T("the")).must(T("of")).boost(2.0)).must(T("and")),
}


def rewrite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, out = searcher(spark, sf_dir), None
    for rule, q in RULES.items():
        one = s.plan(q, {"doc_id": "doc_id"}).orderBy(F.desc("score"), F.asc("doc")).limit(5).select(F.lit(rule).alias("rule"), "doc_id", F.col("score").cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


# Analyzers


def halves(text: str):
    """A word of small letters, and its first letter at the same place."""
    for w in re.findall("[a-z]+", text):
        yield w, 1
        yield w[0], 0


# Sources and sinks


def one_segment(spark: SparkSession, docs: DataFrame, schema: IndexSchema, order_by: list[str]) -> IndexSearcher:
    path = scratch(spark, "index")
    with IndexWriter.open(spark, path, WriterConfig(analyzer=ANALYZER), schema) as w:
        w.add_documents(docs, order_by=order_by)
    return IndexSearcher(IndexReader.open(spark, path))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON Lines, read again with their types, indexed and searched; hits as JSON with their stored fields."""
    path = scratch(spark, "json")
    docs = source(spark, sf_dir, "documents").withColumn("long", F.col("n_chars") > 1000)
    docs.write.json(path)
    df, schema = read_json_lines(spark, path, keywords=["lang", "source"])
    s = one_segment(spark, df, schema, ["doc_id"])
    hits = s.fetch(s.search_df(BooleanQuery().must(T("the")).filter(TermQuery("long", "true")), 20), "doc_id", "lang", "long", at_most=20)
    back = F.from_json("value", "score double, fields struct<doc_id:long,lang:string,long:string>")
    return hits_json(hits, ["doc_id", "lang", "long"]).select(back.alias("h")).select("h.fields.doc_id", "h.fields.lang", F.col("h.fields.long").alias("is_long"), F.col("h.score").cast("float").cast("double").alias("score"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the documents' texts as a document of its own."""
    path = scratch(spark, "lines")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "[\r\n]+")).alias("line"))
    lines.write.text(path)
    df, schema = read_lines(spark, path)
    s = one_segment(spark, df, schema, [])
    rows = [(t, s.count(TermQuery("body", t))) for t in ("the", "of", "der", "zzzz")] + [("", s.reader.num_docs)]
    return spark.createDataFrame(rows, "term string, n long")


def query_file_and_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from a file, answered in one plan, dumped as text and read again."""
    path, out = scratch(spark, "queries"), scratch(spark, "dump")
    spark.createDataFrame([(f"{k}\t{' '.join(t)}",) for k, t in catalog.BATCH], "value string").coalesce(1).write.text(path)
    s = searcher(spark, sf_dir)
    queries = read_queries(spark, path)
    write_dump(results(search_many(s.reader, queries, 10, "text"), queries), out)
    rows = spark.read.schema("kind string, terms string, total long, relation string, hits string").option("sep", "\t").csv(out)
    hits = rows.select("kind", "terms", "total", "relation", F.posexplode(F.split("hits", " ")).alias("k", "hit"))
    hits = hits.select("kind", "terms", "total", "relation", (F.col("k") + 1).cast("long").alias("rank"), F.split("hit", ":").alias("h"))
    hits = hits.select("kind", "terms", "total", "relation", "rank", F.col("h")[0].cast("long").alias("doc"), F.col("h")[1].cast("float").cast("double").alias("score"))
    return s.fetch(hits, "doc_id", at_most=10 * len(catalog.BATCH)).drop("doc")


def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written as JSON Lines and read again."""
    s, path = searcher(spark, sf_dir), scratch(spark, "hits")
    write_hits(s.fetch(s.search_df(T("the"), 20), "doc_id", "source", at_most=20), ["doc_id", "source"], path)
    rows = spark.read.schema("score double, fields struct<doc_id:long,source:string>").json(path)
    return rows.select("fields.doc_id", "fields.source", F.col("score").cast("float").cast("double").alias("score"))


# The life of an index


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of a writer leaves to see: documents, and matches of a term."""
    path, out = scratch(spark, "index"), []
    docs, config = source(spark, sf_dir, "documents"), WriterConfig(analyzer=ANALYZER, merge_policy=MergePolicy(merge_factor=2, min_merge_docs=1 << 40))

    def open_() -> IndexWriter:
        return IndexWriter.open(spark, path, config, SCHEMAS["documents"])

    def see(step: str) -> IndexReader:
        r = IndexReader.open(spark, path)
        out.append((step, r.num_docs, r.num_deleted_docs, len(r.segments), IndexSearcher(r).count(T("the"))))
        return r

    w = open_()
    w.add_documents(docs.where("doc_id % 2 = 0"), order_by=["doc_id"])
    w.commit()
    first = see("committed")
    try:
        open_()
    except LodestoneError as e:
        out.append((type(e).__name__, 0, 0, 0, 0))
    w.add_documents(docs.where("doc_id % 2 = 1"), order_by=["doc_id"])
    see("not committed yet")
    w.rollback()
    see("rolled back")
    with open_() as w:
        w.add_documents(docs.where("doc_id % 2 = 1"), order_by=["doc_id"])
    now = see("merged by policy")
    out.append(("a reader stays", first.num_docs, 0, len(first.segments), IndexSearcher(first).count(T("the"))))
    out.append(("reopened", first.reopen().num_docs, int(now.reopen() is now), 0, 0))
    with open_() as w:
        w.delete_documents(Term("lang", "fr"))
        w.flush()
    see("deleted")
    with open_() as w:
        w.force_merge(1)
    see("force merged")
    see("intact").check_integrity()
    with open_() as w:
        w.delete_by(docs.select(F.lit("lang").alias("field"), F.col("lang").alias("term")).distinct())
    see("all of a segment deleted")
    with open_() as w:
        w.add_documents(docs, order_by=["doc_id"])
        w.delete_all()
        w.add_documents(docs.where("lang = 'en'"), order_by=["doc_id"])
    see("deleted all, then added")
    with IndexWriter.open(spark, path, WriterConfig(analyzer=ANALYZER, create=True), SCHEMAS["documents"]) as w:
        w.add_documents(docs.where("lang = 'de'"), order_by=["doc_id"])
    see("created anew")
    return spark.createDataFrame(out, "step string, docs long, deleted long, segments long, hits long")


def documents_one_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as single documents: buffered, flushed every ten, updated and deleted in between, read by segment."""
    path = scratch(spark, "index")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    make = lambda r, name: Document([Field.string("name", name, True), Field.text("words", f"{name} in region {r.n_regionkey}", True), Field.numeric_i64("key", r.n_nationkey, True), Field.sorted_keyword("region", f"r{r.n_regionkey}")])
    with IndexWriter.open(spark, path, WriterConfig(max_buffered_docs=10)) as w:
        for r in rows:
            w.add_document(make(r, r.n_name))
            if r.n_nationkey % 7 == 3:  # the update finds its document in the buffer or in a segment
                w.update_document(Term.from_bytes("name", rows[r.n_nationkey // 2].n_name.encode()), make(r, "again"))
        w.delete_documents(Term("region", "r2"))
        w.delete_documents(Term("words", "2"))
    r = IndexReader.open(spark, path)
    out = []
    for k, s in enumerate(r.segments):
        for d in range(s.max_doc):
            assert r.locate(r.doc_bases[k] + d) == (k, d)
            if s.is_live(d):
                own = r.document(r.doc_bases[k] + d)
                out.append((k, own.name, own.key, s.doc_value("region", d)))
    return spark.createDataFrame(out, "segment long, name string, key long, region string")


def reader_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every field, as the report of a snapshot gives them."""
    r = searcher(spark, sf_dir, variant="deleted").reader
    rep = r.report()
    rows = [("max_doc", rep["max_doc"]), ("num_docs", rep["num_docs"]), ("deleted_docs", rep["deleted_docs"]), ("segments", len(rep["segments"]))]
    rows += [(f, rep["fields"][f]["doc_count"]) for f in ("text", "lang", "source")]
    rows += [(f"live {s.name}", s.live_docs().count()) for s in r.segments]
    return spark.createDataFrame(rows, "name string, n long")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, search, delete, merge, stats and check of the command line over regions and nations."""
    path, files = scratch(spark, "index"), scratch(spark, "json")
    for t, c in (("region", "r_name"), ("nation", "n_name")):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("kind"), F.concat(F.lower(c), F.lit(" of the "), F.lit(t)).alias("body")).coalesce(1).write.json(f"{files}/{t}")

    def call(*args: str) -> list[str]:
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
            command(spark, arguments().parse_args([args[0], path, *args[1:]]))
        return said.getvalue().splitlines()

    place = files if "://" in files else f"file://{files}"
    call("index", f"{place}/region", "--keyword", "kind", "--create")
    call("index", f"{place}/nation", "--keyword", "kind")
    rows = [("search", len(call("search", "nation", "-n", "100"))), ("search and", len(call("search", "africa nation", "--and"))), ("search field", len(call("search", "region", "--field", "kind", "-n", "100")))]
    rows.append(("first", len(json.loads(call("search", "africa")[0])["fields"]["body"])))
    call("delete", "kind", "region")
    stats = json.loads("".join(call("stats")))
    rows += [("deleted", stats["deleted_docs"]), ("segments", len(stats["segments"]))]
    call("merge")
    stats = json.loads("".join(call("stats")))
    rows += [("left", stats["num_docs"]), ("merged", len(stats["segments"])), ("check", len(call("check")))]
    return spark.createDataFrame(rows, "step string, n long")


# What is refused, and small functions


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = searcher(spark, sf_dir)
    by = [SortField("n_chars")]
    tries = {
        "size 0": lambda: s.page_df(MatchAll(), by, 0),
        "no sort field": lambda: s.page_df(MatchAll(), [], 5),
        "range upside down": lambda: s.plan(I64Range("n_chars", included(5), included(4))),
        "infinite bound": lambda: s.plan(F64Range("n_chars", included(float("inf")), included(float("inf")))),
        "range of another type": lambda: s.plan(F64Range("n_chars", included(1.0), included(2.0))),
        "range without values": lambda: s.plan(I64Range("source", included(1), included(2))),
        "negative boost": lambda: s.plan(T("the").boost(-1.0)),
        "boost without number": lambda: s.plan(T("the").boost(float("nan"))),
        "boundary of two values": lambda: s.page_df(MatchAll(), by, 5, FieldDoc(1, 1.0, (1, 2))),
        "boundary of another type": lambda: s.page_df(MatchAll(), by, 5, FieldDoc(1, 1.0, ("x",))),
        "boundary by score with values": lambda: s.page_df(MatchAll(), None, 5, FieldDoc(1, 1.0, (1,))),
        "boundary score infinite": lambda: s.page_df(MatchAll(), None, 5, FieldDoc(1, float("inf"))),
        "sort without values": lambda: s.page_df(MatchAll(), [SortField("source")], 5),
        "phrase without positions": lambda: s.plan(PhraseQuery("lang", (("fr", 0), ("de", 1)))),
        "score overflows": lambda: s.search_after(T("the").boost(3e38).boost(3e38), by, 5),
        "unknown sort field": lambda: s.page_df(MatchAll(), [SortField("nowhere")], 5),
        "unknown range field": lambda: s.plan(I64Range("nowhere", included(1), included(2))),
        "equal bounds": lambda: s.plan(I64Range("n_chars", included(5), included(5))),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
            rows.append((name, "fine"))
        except LodestoneError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "what string, outcome string")


def length_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte of each length up to 100,000, as a Column and in Python, and what it stands for."""
    numbers = spark.range(100_001).select(F.col("id").alias("n"), encoded_length(F.col("id").cast("int")).cast("long").alias("code"))
    back = spark.createDataFrame([(encode_length(decode_length(b)), decode_length(b)) for b in range(256) if decode_length(b) < 1 << 31], "code long, least long")
    return numbers.join(F.broadcast(back), "code")


def bm25_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from raw statistics."""
    rows = []
    for docs, df, tokens, tf, norm, boost in [(100, 1, 5000, 1, 30, 1.0), (100, 99, 5000, 7, 3, 2.5), (100, 40, 123, 2, 1, 0.3), (7, 7, 7, 1, 1, 1.0)]:
        one, two = Bm25.for_term(boost, df, docs, tokens), Bm25(boost, idf_sum([idf(df, docs), idf(1, docs)]), average_length(tokens, docs))
        rows.append((docs, df, tokens, tf, decode_length(norm), boost, one.score(tf, norm), two.score(tf, norm)))
    return spark.createDataFrame(rows, "docs long, df long, tokens long, tf long, len long, boost double, one double, two double")


def merge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {"nine": [10] * 9, "ten": [10] * 10, "many": [10] * 25, "large first": [1_000_000] + [500] * 10, "large between": [10] * 5 + [900_000] * 10 + [20] * 10, "none": []}
    rows = [(name, r.start, r.stop) for name, sizes in cases.items() for r in MergePolicy().find_merges(sizes)]
    rows += [("too large", r.start, r.stop) for r in MergePolicy(max_merge_docs=10).find_merges([10] * 10 + [9] * 10)]
    return spark.createDataFrame(rows, "name string, start long, stop long")


REGISTERED: dict[str, Run] = {
    **catalog.REGISTERED,
    "tokenize_standard": tokenized(StandardAnalyzer()),
    "tokenize_english": tokenized(StandardAnalyzer.english()),
    "tokenize_long_split": tokenized(StandardAnalyzer().with_stop_words(["the"]).with_max_token_length(4)),
    "tokenize_custom": tokenized(FunctionAnalyzer(halves)),
    **{n: parsed(n) for n in STRINGS},
    "parser_stop_word_gap": stop_word_gap,
    "parser_errors": parser_errors,
    "rewrite_rules": rewrite_rules,
    "json_lines": json_lines,
    "text_lines": text_lines,
    "query_file_and_dump": query_file_and_dump,
    "result_sink": result_sink,
    "lifecycle": lifecycle,
    "documents_one_by_one": documents_one_by_one,
    "reader_report": reader_report,
    "command_line": command_line,
    "refusals": refusals,
    "length_codes": length_codes,
    "bm25_by_hand": bm25_by_hand,
    "merge_selection": merge_selection,
}

# The same in SQL

_E = r"[\p{M}\p{Cf}]*"
_LETTER, _NUMBER = rf"\p{{L}}{_E}", rf"\p{{Nd}}{_E}"
_MID, _MID_NUMBER = r"[''.:\x{2018}\x{2019}\x{2024}\x{b7}\x{2027}]", r"[''.,;\x{2018}\x{2019}\x{2024}\x{2044}]"
#: Letters joined by marks that stand between letters, digits by those between digits, underscores, side by side.
_WORDS = rf"(?:{_LETTER}(?:{_MID}{_E}{_LETTER})*|{_NUMBER}(?:{_MID_NUMBER}{_E}{_NUMBER})*|\p{{Pc}}{_E})+|[\p{{No}}\p{{Nl}}]"
_KEPT = rf"list_filter(regexp_extract_all(lower(translate(text, 'İΣ', 'iσ')), '{_WORDS}'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))"
_UNICODE = f"SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_KEPT} AS t FROM documents)"
_QUOTED = ", ".join(f"'{w}'" for w in ENGLISH)
_OF_THE = f"SELECT doc, {_sum('s0', 's1')} AS score FROM {_all(_leaf('of'), _leaf('the'))}"
_TERM = f"SELECT doc, s AS score FROM {_leaf('the')}"


def _values(rows: list[tuple], *names: str) -> str:
    shown = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") v({', '.join(names)})"


def _rule(name: str, body: str, boost: str = "score") -> str:
    return f"(SELECT '{name}' AS rule, doc AS doc_id, CAST({boost} AS DOUBLE) AS score FROM ({body}) ORDER BY score DESC, doc LIMIT 5)"


_TWICE = f"CAST(CAST({_sum('s0', 's1')} AS DOUBLE) + CAST(s2 AS DOUBLE) AS FLOAT)"
_RULES = {
    "R1": _TERM,
    "R3": f"SELECT doc, s AS score FROM {_leaf('the', 3.0)}",
    "R5": f"SELECT doc, 1.0 AS score FROM {_leaf('the')}",
    "R6": _TERM,
    "R7": _TERM,
    "R10": f"SELECT doc, 0.0 AS score FROM {_leaf('the')}",
    "R11": f"SELECT doc, {_sum('s0', 's1')} AS score FROM {_all(_leaf('the', 3.0), _leaf('of'))} WHERE s0 IS NOT NULL AND s1 IS NOT NULL",
    "R12": f"SELECT doc, {_sum('s0', 's1')} AS score FROM {_all(_leaf('the'), _leaf('of'))} WHERE s0 IS NOT NULL AND s1 IS NOT NULL",
    "R13": f"SELECT doc, {_TWICE} AS score FROM {_all(_leaf('the', 2.0), _leaf('of', 2.0), _leaf('and'))} WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL",
}
_HITS = "(SELECT doc FROM tok WHERE term = 'the' GROUP BY doc)"


def _seen(step: str, where: str, deleted: str = "0", segments: int = 1) -> str:
    return f"SELECT '{step}' AS step, (SELECT count(*) FROM documents WHERE {where}) AS docs, {deleted} AS deleted, {segments} AS segments, (SELECT count(*) FROM {_HITS} h JOIN documents d ON d.doc_id = h.doc WHERE {where}) AS hits"


_LIFE = [
    _seen("committed", "doc_id % 2 = 0"),
    "SELECT 'LockObtainFailed', 0, 0, 0, 0",
    _seen("not committed yet", "doc_id % 2 = 0"),
    _seen("rolled back", "doc_id % 2 = 0"),
    _seen("merged by policy", "true"),
    _seen("a reader stays", "doc_id % 2 = 0"),
    "SELECT 'reopened', (SELECT count(*) FROM documents), 1, 0, 0",
    _seen("deleted", "lang <> 'fr'", "(SELECT count(*) FROM documents WHERE lang = 'fr')"),
    _seen("force merged", "lang <> 'fr'"),
    _seen("intact", "lang <> 'fr'"),
    _seen("all of a segment deleted", "false", segments=0),
    _seen("deleted all, then added", "lang = 'en'"),
    _seen("created anew", "lang = 'de'"),
]
_JSON = f"SELECT x.doc, s AS score FROM {_leaf('the')} x JOIN documents d ON d.doc_id = x.doc WHERE n_chars > 1000"
# A filter adds nothing to a score.
_NATIONS = """WITH a AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation), u AS (SELECT k, k // 2 AS gone FROM a WHERE k % 7 = 3),
added AS (SELECT k, name, r, k + (SELECT count(*) FROM u WHERE u.k < a.k) AS place FROM a UNION ALL SELECT a.k, 'again', r, a.k + 1 + (SELECT count(*) FROM u WHERE u.k < a.k) FROM a JOIN u ON u.k = a.k)"""

ORACLES: dict[str, str] = {
    **catalog.ORACLES,
    "tokenize_standard": _UNICODE,
    "tokenize_english": f"SELECT * FROM ({_UNICODE}) WHERE term NOT IN ({_QUOTED})",
    "tokenize_long_split": f"SELECT * FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, flatten(list_transform({_KEPT}, lambda w: regexp_extract_all(w, '(?s).{{1,4}}'))) AS t FROM documents)) WHERE term <> 'the'",
    "tokenize_custom": "SELECT doc_id, CASE WHEN k = 1 THEN term ELSE left(term, 1) END AS term, pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS t FROM documents)), (VALUES (1), (2)) v(k)",
    # The keyword test looks at unescaped text, so \AND is the operator.
    "parser_escapes": _top(f"SELECT doc, {_req_opt(_sum('s2', 's3'), ['s0', 's1'])} AS score FROM {_all(_leaf('the'), _phrase('of', 'the', 1), _leaf('of'), _leaf('and'))} WHERE s2 IS NOT NULL AND s3 IS NOT NULL", 20),
    "parser_grouping": _top(
        f"SELECT doc, CAST(CAST({_sum('s0', 's1')} AS DOUBLE) + CAST({_sum('s2', 's3')} AS DOUBLE) AS FLOAT) AS score FROM {_all(_leaf('the', 2.0), _leaf('of', 2.0), _leaf('and'), _leaf('to'))} WHERE (s0 IS NOT NULL OR s1 IS NOT NULL) AND (s2 IS NOT NULL OR s3 IS NOT NULL)", 20
    ),
    "parser_precedence": _top(f"SELECT doc, {_req_opt(_sum('s0', 's1'), ['s2'])} AS score FROM {_all(_leaf('the'), _leaf('of'), _leaf('and'))} WHERE s0 IS NOT NULL AND s1 IS NOT NULL", 20),
    "parser_single_clause": _top(_TERM, 20),
    "parser_lone_negative": "SELECT doc_id, 1::DOUBLE AS score FROM documents WHERE false",
    "parser_multi_token": _top(_OF_THE, 20),
    "parser_multi_token_and": _top(f"{_OF_THE} WHERE s0 IS NOT NULL AND s1 IS NOT NULL", 20),
    "parser_or_under_and": _top(f"SELECT doc, {_req_opt(_sum('s0'), ['s1', 's2'])} AS score FROM {_all(_leaf('the'), _leaf('of'), _leaf('and'))} WHERE s0 IS NOT NULL", 20),
    "parser_field_group": _top(f"SELECT doc, CAST(coalesce(CAST({_sum('s0', 's1')} AS DOUBLE), 0) + coalesce(CAST(s2 AS DOUBLE), 0) AS FLOAT) AS score FROM {_all(catalog._keyword('lang', 'fr'), catalog._keyword('lang', 'de'), _leaf('the'))}", 20),
    "parser_nothing_left": _top(_TERM, 20),
    "parser_wifi": _top(
        f"SELECT doc, CAST(coalesce(CAST(s0 AS DOUBLE), 0) + CAST({_sum('s1', 's2')} AS DOUBLE) AS FLOAT) AS score FROM {_all(_leaf('the'), _leaf('of'), _leaf('the'), _leaf('to'))} WHERE s3 IS NULL AND (s0 IS NOT NULL OR s1 IS NOT NULL)", 20
    ),
    "parser_stop_word_gap": _top(f"SELECT doc, s AS score FROM {_phrase('of', 'the', 2)}", 20),
    "parser_errors": _values([*((t, True) for t in BAD), *((t, False) for t in GOOD)], "query", "refused"),
    "rewrite_rules": BASE + " " + " UNION ALL ".join([_rule(n, b) for n, b in _RULES.items()] + [_rule("R10 must", "SELECT doc, 0.0 AS score FROM tok WHERE false")]),
    "json_lines": f"{BASE} SELECT doc_id, lang, 'true' AS is_long, CAST(score AS DOUBLE) AS score FROM ({_JSON} ORDER BY score DESC, x.doc LIMIT 20) b JOIN documents ON doc_id = b.doc",
    "text_lines": "WITH l AS (SELECT unnest(regexp_split_to_array(text, '[\r\n]+')) AS text FROM documents), n AS (SELECT row_number() OVER () AS doc_id, text FROM l), "
    + catalog._tokens("text", "n", "doc_id")
    + " SELECT t.term, (SELECT count(DISTINCT doc) FROM tok WHERE tok.term = t.term) AS n FROM (VALUES ('the'), ('of'), ('der'), ('zzzz')) t(term) UNION ALL SELECT '', count(*) FROM l",
    "query_file_and_dump": f"SELECT kind, terms, total, 'eq' AS relation, rank, doc_id, score FROM ({catalog.ORACLES['batch_search']}) b JOIN ({_values([(i, k, ' '.join(t)) for i, (k, t) in enumerate(catalog.BATCH)], 'qid', 'kind', 'terms')}) q USING (qid)",
    "result_sink": f"{BASE} SELECT doc_id, source, CAST(s AS DOUBLE) AS score FROM (SELECT doc, s FROM {_leaf('the')} ORDER BY s DESC, doc LIMIT 20) b JOIN documents ON doc_id = b.doc",
    "lifecycle": BASE + " " + " UNION ALL ".join(_LIFE),
    "documents_one_by_one": _NATIONS
    + """ SELECT CAST(dense_rank() OVER (ORDER BY place // 10) - 1 AS BIGINT) AS segment, name, CAST(k AS BIGINT) AS key, 'r' || r AS region FROM added
    WHERE r <> 2 AND NOT (name <> 'again' AND k IN (SELECT gone FROM u))""",
    "reader_report": """SELECT 'max_doc' AS name, count(*) AS n FROM documents UNION ALL SELECT 'num_docs', count(*) FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'deleted_docs', count(*) FROM documents WHERE lang = 'fr'
    UNION ALL SELECT 'segments', 2 UNION ALL SELECT 'text', count(*) FROM (SELECT DISTINCT doc FROM tok) UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents
    UNION ALL SELECT 'live s1', count(*) FROM documents WHERE lang <> 'fr' AND doc_id % 2 = 0 UNION ALL SELECT 'live s2', count(*) FROM documents WHERE lang <> 'fr' AND doc_id % 2 = 1""",
    "command_line": """SELECT 'search' AS step, count(*) AS n FROM nation UNION ALL SELECT 'search and', 0 UNION ALL SELECT 'search field', count(*) FROM region UNION ALL SELECT 'first', length('africa of the region')
    UNION ALL SELECT 'deleted', 0 UNION ALL SELECT 'segments', 1 UNION ALL SELECT 'left', count(*) FROM nation UNION ALL SELECT 'merged', 1 UNION ALL SELECT 'check', 1""",
    "refusals": _values(
        [(t, "IllegalArgument") for t in ("size 0", "no sort field", "range upside down", "infinite bound", "range of another type", "range without values", "negative boost", "boost without number", "boundary of two values")]
        + [(t, "IllegalArgument") for t in ("boundary of another type", "boundary by score with values", "boundary score infinite", "sort without values", "phrase without positions", "score overflows")]
        + [(t, "fine") for t in ("unknown sort field", "unknown range field", "equal bounds")],
        "what",
        "outcome",
    ),
    "length_codes": """SELECT n, CASE WHEN n < 32 THEN n ELSE 24 + ((((n - 24) >> (length(bin(n - 24)) - 4)) & 7) | ((length(bin(n - 24)) - 3) << 3)) END AS code,
    CASE WHEN n < 32 THEN n ELSE 24 + (((n - 24) >> (length(bin(n - 24)) - 4)) << (length(bin(n - 24)) - 4)) END AS least FROM generate_series(0, 100000) g(n)""",
    "bm25_by_hand": f"""WITH v AS (SELECT * FROM (VALUES (100, 1, 5000, 1, {decode_length(30)}, 1.0), (100, 99, 5000, 7, 3, 2.5), (100, 40, 123, 2, 1, 0.3), (7, 7, 7, 1, 1, 1.0)) v(docs, df, tokens, tf, len, boost)),
    w AS (SELECT *, CAST(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS FLOAT) AS i, CAST(ln(1 + (docs - 1 + 0.5::DOUBLE) / 1.5::DOUBLE) AS FLOAT) AS j,
    CAST(1 AS FLOAT) / (CAST(1.2 AS FLOAT) * (CAST(0.25 AS FLOAT) + CAST(0.75 AS FLOAT) * CAST(len AS FLOAT) / CAST(CAST(tokens AS DOUBLE) / docs AS FLOAT))) AS f FROM v)
    SELECT docs, df, tokens, tf, len, CAST(boost AS DOUBLE) AS boost, CAST({_bm25('(CAST(boost AS FLOAT) * i)', 'tf', 'f')} AS DOUBLE) AS one,
    CAST({_bm25('(CAST(boost AS FLOAT) * CAST(CAST(i AS DOUBLE) + CAST(j AS DOUBLE) AS FLOAT))', 'tf', 'f')} AS DOUBLE) AS two FROM w""",
    "merge_selection": _values([("ten", 0, 10), ("many", 0, 10), ("many", 10, 20), ("large first", 1, 11), ("large between", 0, 10), ("large between", 15, 25), ("too large", 10, 20)], "name", "start", "stop"),
}
ORACLES["reader_report"] = BASE + " " + ORACLES["reader_report"]
