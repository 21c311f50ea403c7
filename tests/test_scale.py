"""What bounds the memory and the time of larger tables."""

from __future__ import annotations

import random
import resource

from pyspark.sql import functions as F

from lodestone.functions.analysis import SPACE, UNICODE_WORD, FunctionAnalyzer, KeywordAnalyzer, PatternAnalyzer, PerFieldAnalyzer, StandardAnalyzer, WhitespaceAnalyzer
from lodestone.functions.similarity import encode_length
from lodestone.operators import indexing
from lodestone.schema import FieldSpec, IndexSchema


def test_function_analyzer_memory(spark):
    """A worker holds the tokens of a few texts as Python objects, not those of a batch."""

    def words(text):
        for w in text.split():
            yield w, 1
        yield f"={resource.getrusage(resource.RUSAGE_SELF).ru_maxrss}", 1

    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abc "), 1500).alias("text"))
    last = docs.select(F.element_at(FunctionAnalyzer(words).tokens(F.col("text")), -1).term.alias("m"), F.size(FunctionAnalyzer(words).tokens(F.col("text"))).alias("n"))
    got = last.agg(F.max(F.substring("m", 2, 20).cast("long")).alias("kb"), F.min("n"), F.max("n")).first()
    assert got[1:] == (1501, 1501)
    assert got["kb"] < 500_000


def test_function_analyzer_values(spark):
    """Positions go on from value to value; nothing and null have no tokens; packing cuts nowhere."""
    twice = FunctionAnalyzer(lambda t: ((w, s) for w in t.split() for s in (1, 0)))
    df = spark.createDataFrame([(0, ["a b", None, "", "c"]), (1, None), (2, []), (3, ["x " * 60_000])], "i long, t array<string>").coalesce(1)
    got = {r.i: [tuple(x) for x in r.t] for r in df.select("i", twice.tokens_of(F.col("t")).alias("t")).collect()}
    assert got[0] == [("a", 0), ("a", 0), ("b", 1), ("b", 1), ("c", 2), ("c", 2)]
    assert got[1] == got[2] == []
    assert got[3] == [("x", k // 2) for k in range(120_000)]


def test_postings_stay(spark, monkeypatch):
    """Postings come from where their documents are, and are those of a plain count, however batches are cut."""
    monkeypatch.setattr(indexing, "GROUPED", 50)
    r = random.Random(1)
    texts = [None, "", "the the a", *(" ".join(r.choice(["the", "and", "of", "zé", "𝄞x", "￮b", "b"]) for _ in range(r.randrange(120))) for _ in range(80))]
    rows = [(i + (1 << 40), t, None if i % 5 == 0 else f"k{i % 3}", [t, None, "of b"] if i % 2 else None) for i, t in enumerate(texts)]
    schema = IndexSchema({"text": FieldSpec.text(), "key": FieldSpec.string(), "many": FieldSpec.text()})
    stop = PatternAnalyzer(r"\S++", stop_words=["and"])
    analyzer = PerFieldAnalyzer(PatternAnalyzer(r"\S++"), {"key": KeywordAnalyzer(), "many": stop})
    p = indexing.postings(spark.createDataFrame(rows, "doc long, text string, key string, many array<string>"), schema, analyzer)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    want = {}
    for doc, text, key, many in rows:
        of_many, base = [], 0
        for v in many or []:
            own = stop.tokenize(v or "")
            of_many += [(w, q + base) for w, q in own]
            base += own[-1][1] + 1 if own else 0
        for field, tokens in (("text", analyzer.tokenize(text or "")), ("key", [(key, 0)] if key else []), ("many", of_many)):
            for k, (w, q) in enumerate(tokens):
                one = want.setdefault((field, w, doc), [len(tokens), False, []])
                one[1] |= k == 0
                one[2].append(q)
    spec = dict(schema)
    got = {(x.field, x.term, x.doc): (x.tf, x.norm, x.lead, x.positions) for x in p.collect()}
    assert len(got) == p.count()
    for (field, w, doc), (n, lead, places) in want.items():
        whole = field == "key"
        assert got.pop((field, w, doc)) == (len(places), encode_length(n) if spec[field].has_norms else 1, lead, None if whole else places)
    assert not got


def test_patterns_tell_ascii_first(spark):
    """The guards of the patterns change no match, and are there: without them a text took some three times as long."""
    assert UNICODE_WORD.startswith("(?!") and WhitespaceAnalyzer().pattern.startswith("(?:[!-~]++|(?!")
    r = random.Random(2)
    pool = [chr(c) for c in range(128)] + list("'.,;:\"_-’״׳") * 6 + [chr(c) for c in (0xDF, 0x130, 0x3A3, 0x5D0, 0x5F4, 0x300, 0x200D, 0x3042, 0x30AB, 0x4E2D, 0xE01, 0x660, 0x66B, 0xB2, 0x2160, 0x203F, 0x20000, 0x85, 0xA0, 0x2003, 0x3000)] * 4
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = PatternAnalyzer(f"[^{SPACE[1:-1]}]++", lowercase=False)
    assert not df.where(WhitespaceAnalyzer().words(t) != plain.words(t)).count()
    # Long words are cut as before, told by one pass over the text.
    for n in (1, 3, 255):
        cut = df.select("t", WhitespaceAnalyzer(max_token_length=n).pieces(t).alias("p"), StandardAnalyzer(max_token_length=n).pieces(t).alias("q")).collect()
        assert all(x.p == [w for w, _ in WhitespaceAnalyzer(max_token_length=n).tokenize(x.t)] and x.q == [w for w, _ in StandardAnalyzer(max_token_length=n).tokenize(x.t)] for x in cut)


def index_of(spark, path, parts, gone=(), merge=True):
    from lodestone.functions.analysis import PatternAnalyzer
    from lodestone.writer import IndexWriter, MergePolicy, WriterConfig

    schema = IndexSchema({"key": FieldSpec.string(stored=True), "body": FieldSpec.text()})
    config = WriterConfig(analyzer=PatternAnalyzer(r"\S++"), merge_policy=MergePolicy(merge_factor=1000), checksums=False)
    with IndexWriter.open(spark, path, config, schema) as w:
        for rows in parts:
            w.add_documents(spark.createDataFrame(rows, "key string, body string").coalesce(1))
        if gone:
            w.delete_by(spark.createDataFrame([("key", g) for g in gone] + [("key", None)], "field string, term string"))
        if merge:
            w.force_merge(1)
    return w


def test_merge_by_counting(spark, tmp_path, monkeypatch):
    """A merge numbers postings anew without moving them, and gives the index of the live documents."""
    from lodestone import writer
    from lodestone.reader import IndexReader

    r = random.Random(4)
    parts = [[(f"{k}-{i}", " ".join(r.choice("abcdef") for _ in range(r.randrange(9)))) for i in range(n)] for k, n in enumerate((200, 70, 64))]
    gone = {f"{k}-{i}" for k, i in [(0, 0), (0, 1), (0, 62), (0, 63), (0, 64), (0, 127), (0, 199), *((1, i) for i in range(60))]}
    live = [x for p in parts for x in p if x[0] not in gone]

    def seen(path):
        r = IndexReader.open(spark, path)
        return sorted(map(tuple, r.postings().select("field", "term", "doc", "tf", "norm", "lead", "positions").collect()), key=repr), sorted(r.docs().select("doc", "key").collect())

    index_of(spark, str(tmp_path / "live"), [live], merge=False)
    index_of(spark, str(tmp_path / "merged"), parts, gone)
    assert seen(str(tmp_path / "merged")) == seen(str(tmp_path / "live"))
    # Segments beyond the bound are joined, to the same end.
    monkeypatch.setattr(writer, "COUNTED_WORDS", 1)
    index_of(spark, str(tmp_path / "joined"), parts, gone)
    assert seen(str(tmp_path / "joined")) == seen(str(tmp_path / "live"))
    monkeypatch.undo()
    w = index_of(spark, str(tmp_path / "open"), parts, gone, merge=False)
    moved = w._moved(IndexReader.open(spark, str(tmp_path / "open")).segments[0], 0)
    shown = moved._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "hashpartitioning" not in shown


def test_few_deletes_reach_the_scan(spark, tmp_path, monkeypatch):
    """Up to a thousand terms of a DataFrame are a filter of the postings' scan."""
    from pyspark.sql import DataFrame

    from lodestone.reader import IndexReader
    from lodestone.writer import IndexWriter

    plans, write = [], IndexWriter._write

    def kept(self, df: DataFrame, folder: str):
        if folder.startswith("deletes/"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(self, df, folder)

    monkeypatch.setattr(IndexWriter, "_write", kept)
    index_of(spark, str(tmp_path / "i"), [[("x", "a"), ("y", "b"), (None, "c")]], ["x"], merge=False)
    assert IndexReader.open(spark, str(tmp_path / "i")).num_docs == 2
    assert plans and all("In(term, [x])" in p or "EqualTo(term,x)" in p for p in plans), plans


def test_postings_move_as_blocks(spark, tmp_path, monkeypatch):
    """A segment's postings are laid out in order through one exchange of blocks, however they are cut, and long words are cut as before."""
    from lodestone.functions.analysis import PatternAnalyzer
    from lodestone.reader import IndexReader
    from lodestone.writer import IndexWriter, WriterConfig

    r = random.Random(6)
    pool = ["the"] * 20 + ["of", "zé", "𝄞x", "￮b", "b", "𝄞" * 7, "x" * 31, "abcdefgh"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(60))) or None for _ in range(400)]
    schema = IndexSchema({"id": FieldSpec.numeric_i64(True), "key": FieldSpec.string(), "text": FieldSpec.text()})
    analyzer = PatternAnalyzer(r"\S++", max_token_length=5)
    docs = spark.createDataFrame([(i, f"k{i % 3}", t) for i, t in enumerate(texts)], "id long, key string, text string").repartition(7)
    plans, write = [], IndexWriter._write

    def kept(self, df, folder):
        plans.append((folder, df._jdf.queryExecution().executedPlan().toString()))
        write(self, df, folder)

    monkeypatch.setattr(IndexWriter, "_write", kept)
    monkeypatch.setattr(indexing, "MARKED", 64)
    monkeypatch.setattr(indexing, "LAID", 4096)
    with IndexWriter.open(spark, str(tmp_path / "i"), WriterConfig(analyzer=analyzer), schema) as w:
        w.add_documents(docs, order_by=["id"])
    (plan,) = [p for f, p in plans if f.endswith("/postings")]
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1 and "block" in plan and "rangepartitioning" not in plan
    assert not [f for f, _ in plans if f.endswith("/unsorted")]
    want = {}
    for i, t in enumerate(texts):
        for field, tokens in (("key", [(f"k{i % 3}", 0)]), ("text", analyzer.tokenize(t or ""))):
            for k, (term, q) in enumerate(tokens):
                one = want.setdefault((field, term.encode(), i), [len(tokens), False, []])
                one[1] |= k == 0
                one[2].append(q)
    posted = IndexReader.open(spark, str(tmp_path / "i")).postings().withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    whole = {"key": True, "text": False}
    assert {(x.field, x.term.encode(), x.doc): (x.tf, x.norm, x.lead, x.positions) for x in posted} == {
        (f, t, d): (len(q), 1 if whole[f] else encode_length(n), lead, None if whole[f] else q) for (f, t, d), (n, lead, q) in want.items()
    }
    assert len(posted) == len(want)
    # Files are sorted and don't overlap, and a common term spreads over several.
    files = {}
    for x in posted:
        files.setdefault(x.file, []).append((x.field, x.term.encode(), x.doc))
    assert all(own == sorted(own) for own in files.values())
    bounds = sorted((own[0], own[-1]) for own in files.values())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and len(bounds) > 10
    assert len({x.file for x in posted if x.term == "the"}) > 2


def test_many_queries_hash(spark, tmp_path):
    """Queries of many terms are summed by hash, without positions, which only phrases read."""
    from lodestone.operators.batch import search_many
    from lodestone.reader import IndexReader

    index_of(spark, str(tmp_path / "i"), [[(f"{i}", "a b a" if i % 2 else "b a c") for i in range(20)]], merge=False)
    queries = spark.createDataFrame([(0, "OR", ["a", "b"]), (1, "PHRASE", ["a", "b"]), (2, "AND", ["c", "b"]), (3, "PHRASE", ["b", "a"])], "qid long, kind string, terms array<string>")
    found = search_many(IndexReader.open(spark, str(tmp_path / "i")), queries, 3, "body")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ReadSchema: struct<field:string,term:string,doc:bigint,tf:int,norm:smallint>" in plan
    got = {}
    for x in found.collect():
        got.setdefault(x.qid, []).append((x["rank"], x.doc, x.total))
    assert {q: (len(v), {t for _, _, t in v}) for q, v in got.items()} == {0: (3, {20}), 1: (3, {10}), 2: (3, {10}), 3: (3, {20})}
    assert sorted(got[1]) == [(1, 1, 10), (2, 3, 10), (3, 5, 10)]
