"""Matching, scoring, ranges, sorts and pages, held against brute force."""

import math
import random
import struct

import pytest

from lodestone import (
    BY_SCORE,
    BooleanQuery,
    Document,
    F64Range,
    Field,
    FieldDoc,
    FieldSpec,
    I64Range,
    IllegalArgument,
    IndexReader,
    IndexSchema,
    IndexSearcher,
    IndexWriter,
    MatchAll,
    MatchNone,
    Missing,
    Order,
    PhraseQuery,
    SortField,
    Term,
    TermQuery,
    WhitespaceAnalyzer,
    WriterConfig,
)
from lodestone.plans.query import UNBOUNDED, Boost, ConstantScore, Occur, excluded, included

f32 = lambda x: struct.unpack("<f", struct.pack("<f", x))[0]
SPACES = WriterConfig(analyzer=WhitespaceAnalyzer())


class Brute:
    """Scores every document of a small corpus by the definitions."""

    def __init__(self, docs):
        self.docs = docs  # {field: [tokens]}, one dict a document
        self.stats = {}
        for f in ("body", "tags"):
            lists = [d[f] for d in docs if d[f]]
            total = sum(len(x) if f == "body" else len(set(x)) for x in lists)
            self.stats[f] = len(lists), total

    def weight(self, field, terms, boost):
        n = self.stats[field][0]
        total = 0.0
        for t in terms:
            df = sum(t in d[field] for d in self.docs)
            total += f32(math.log(1 + (n - df + 0.5) / (df + 0.5)))
        return f32(boost * f32(total))

    def bm25(self, field, terms, freq, tokens, boost):
        count, total = self.stats[field]
        average = f32(total / count)
        length = 1
        if field == "body":
            v = len(tokens) - 24
            shift = max(0, v.bit_length() - 4) if v > 0 else 0
            length = 24 + (v >> shift << shift) if v > 0 else len(tokens)
        inv = f32(1 / f32(f32(1.2) * f32(0.25 + f32(f32(0.75 * length) / average))))
        w = self.weight(field, terms, boost)
        return f32(w - f32(w / f32(1 + f32(freq * inv))))

    def score(self, q, d, boost=1.0):
        """None if the document doesn't match."""
        if isinstance(q, TermQuery):
            n = d[q.field].count(q.term)
            return self.bm25(q.field, [q.term], n if q.field == "body" else 1, d[q.field], boost) if n else None
        if isinstance(q, PhraseQuery):
            t = d[q.field]
            n = sum(all(p + o < len(t) and t[p + o] == w for w, o in q.terms) for p in range(len(t)))
            return self.bm25(q.field, [w for w, _ in q.terms], n, t, boost) if n else None
        if isinstance(q, MatchAll):
            return f32(boost)
        if isinstance(q, MatchNone):
            return None
        if isinstance(q, Boost):
            return self.score(q.query, d, f32(boost * q.factor))
        if isinstance(q, ConstantScore):
            return None if self.score(q.query, d) is None else f32(boost)
        by = {o: [self.score(c, d, boost) for c in q.of(o)] for o in Occur}
        required = by[Occur.MUST] + by[Occur.FILTER]
        should = [x for x in by[Occur.SHOULD] if x is not None]
        if None in required or any(x is not None for x in by[Occur.MUST_NOT]):
            return None
        if len(should) < (q.minimum_should_match if required else max(1, q.minimum_should_match)):
            return None
        opt = f32(sum(should))
        if not required:
            return opt
        if q.minimum_should_match:
            return f32(sum([*by[Occur.MUST], opt]))
        base = f32(sum(by[Occur.MUST]))
        return f32(base + opt) if should else base


def corpus(r, n=300):
    return [{"body": [f"w{int(40 * r.random() ** 3)}" for _ in range(r.randrange(40))], "tags": [f"t{r.randrange(8)}" for _ in range(r.randrange(3))]} for _ in range(n)]


def some_query(r, depth=0):
    word = lambda: TermQuery("body", f"w{int(42 * r.random() ** 3)}") if r.random() < 0.85 else TermQuery("tags", f"t{r.randrange(8)}")
    kind = r.randrange(9 if depth < 2 else 5)
    if kind == 0:
        return word()
    if kind == 1:
        p = PhraseQuery("body")
        for k in range(r.randrange(2, 4)):
            p = p.term_at(f"w{int(12 * r.random() ** 2)}", k if r.random() < 0.8 else k + 1)
        return p
    if kind == 2:
        return word().boost(r.choice([0.5, 2.0, 3.3]))
    if kind in (3, 4):
        q = BooleanQuery()
        for _ in range(r.randrange(2, 5)):
            q = q.clause(word(), Occur.SHOULD if kind == 3 else Occur.MUST)
        return q
    if kind == 5:
        return some_query(r, depth + 1).constant_score().boost(1.5)
    if kind == 6:
        return BooleanQuery().must(MatchAll()).must_not(word())
    q = BooleanQuery()
    for _ in range(r.randrange(1, 5)):
        q = q.clause(some_query(r, depth + 1), r.choice(list(Occur)))
    return q.at_least(r.choice([0, 0, 1, 2]))


def test_random_queries_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    docs = corpus(r)
    brute = Brute(docs)
    schema = IndexSchema({"id": FieldSpec.numeric_i64(True), "body": FieldSpec.text(), "tags": FieldSpec.string()})
    rows = [(i, " ".join(d["body"]), d["tags"]) for i, d in enumerate(docs)]
    with IndexWriter.open(spark, str(tmp_path), SPACES, schema) as w:
        for a in (0, 97, 194):  # three segments
            w.add_documents(spark.createDataFrame(rows[a : a + (106 if a == 194 else 97)], "id long, body string, tags array<string>"), order_by=["id"])
    reader = IndexReader.open(spark, str(tmp_path))
    assert len(reader.segments) == 3
    s = IndexSearcher(reader)
    for _ in range(40):
        q = some_query(r)
        k = r.randrange(1, 20)
        scored = ((brute.score(q.rewrite(), d), i) for i, d in enumerate(docs))
        want = sorted(((-x, i) for x, i in scored if x is not None))
        got = s.search(q, k)
        assert got.total_hits.value == len(want), q
        assert [h.doc for h in got.score_docs] == [i for _, i in want[:k]], q
        assert [h.score for h in got.score_docs] == pytest.approx([-x for x, _ in want[:k]], rel=1e-6), q


def test_many_queries_at_once_agree_with_one_by_one(spark, tmp_path):
    from lodestone.operators.batch import results, search_many
    from lodestone.sources.files import read_queries, write_dump

    r = random.Random(8)
    docs = corpus(r, 200)
    schema = IndexSchema({"id": FieldSpec.numeric_i64(True), "body": FieldSpec.text(), "tags": FieldSpec.string()})
    with IndexWriter.open(spark, str(tmp_path / "i"), SPACES, schema) as w:
        w.add_documents(spark.createDataFrame([(i, " ".join(d["body"]), d["tags"]) for i, d in enumerate(docs)], "id long, body string, tags array<string>"), order_by=["id"])
        w.add_document(Document([Field.numeric_i64("id", 900, True), Field.text("body", "w0 w1 w0 w1")]))
        w.flush()
        w.delete_documents(Term("body", "w7"))
    lines = ["TERM\tw3", "OR\tw1 w9 w30", "AND\tw0 w2", "PHRASE\tw0 w1", "PHRASE\tw0 w0", "PHRASE\tw0 w1 w0", "AND\tw0 w999", "OR\tw0 w0"]
    (tmp_path / "q.tsv").write_text("\n".join(lines))
    queries = read_queries(spark, str(tmp_path / "q.tsv"))
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path / "i")))
    found = search_many(s.reader, queries, 5)
    by = {}
    for row in found.orderBy("qid", "rank").collect():
        by.setdefault(row.qid, []).append(row)
    for q in queries.collect():
        t = [TermQuery("body", x) for x in q.terms]
        tree = {"TERM": lambda: t[0], "OR": lambda: BooleanQuery(tuple((x, Occur.SHOULD) for x in t)), "AND": lambda: BooleanQuery(tuple((x, Occur.MUST) for x in t)), "PHRASE": lambda: PhraseQuery("body", tuple((x, i) for i, x in enumerate(q.terms)))}[q.kind]()
        want, got = s.search(tree, 5), by.get(q.qid, [])
        assert [(h.doc, h.score) for h in want.score_docs] == [(g.doc, g.score) for g in got], q
        assert want.total_hits.value == (got[0].total if got else 0)
    write_dump(results(found, queries), str(tmp_path / "dump"))
    assert spark.read.text(str(tmp_path / "dump")).count() == len(lines)


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("numbers"))
    values = {"a": 9223372036854775807, "b": -5, "c": None, "d": 9007199254740993, "e": -5, "f": -9223372036854775808}
    with IndexWriter.open(spark, path) as w:
        for k, v in values.items():
            d = Document([Field.string("id", k, True), Field.text("body", "rust search")])
            w.add_document(d if v is None else d.add(Field.numeric_i64("n", v)))
    return path


def names(s, hits):
    return "".join(s.doc(h.doc).id for h in hits)


def test_long_columns(spark, numbers):
    s = IndexSearcher(IndexReader.open(spark, numbers))
    assert names(s, s.search_after(MatchAll(), [SortField("n")], 10)) == "fbedac"
    assert names(s, s.search_after(MatchAll(), [SortField("n", Order.DESC, Missing.FIRST)], 10)) == "cadbef"
    assert names(s, s.search(I64Range("n", excluded(-5), excluded(9223372036854775807)), 9).score_docs) == "d"
    assert s.count(I64Range("n", included(-5), included(-5))) == 2 and s.count(I64Range("n")) == 5 and s.count(I64Range("nowhere")) == 0
    text = TermQuery("body", "rust")
    both = s.search(BooleanQuery().must(text).filter(I64Range("n", included(0))), 9).score_docs
    alone = {h.doc: h.score for h in s.search(text, 9).score_docs}
    assert names(s, both) == "ad" and all(alone[h.doc] == h.score for h in both)


def test_pages_cover_everything_once(spark, numbers):
    s = IndexSearcher(IndexReader.open(spark, numbers))
    for sort in (BY_SCORE, [SortField("n")], [SortField("n", Order.DESC, Missing.FIRST)], [SortField("n", Order.DESC, Missing.LAST)], [SortField("n", Order.ASC, Missing.FIRST)]):
        whole = s.search_after(MatchAll(), sort, 10)
        got, last = [], None
        while page := s.search_after(MatchAll(), sort, 2, last):
            got, last = got + page, page[-1]
        assert got == whole and len(whole) == 6


def test_double_and_keyword_columns(spark, tmp_path):
    path = str(tmp_path)
    rows = [("a", 1.25, "z"), ("b", -2.5, "a"), ("c", 1.25, "b")]
    with IndexWriter.open(spark, path) as w:
        for i, price, tag in rows:
            w.add_document(Document([Field.string("id", i, True), Field.numeric_f64("price", price), Field.sorted_keyword("tag", tag)]))
        for bad in (Field.numeric_f64("price", math.nan), Field.numeric_i64("price", 3)):
            with pytest.raises(IllegalArgument):
                w.add_document(Document([bad]))
    s = IndexSearcher(IndexReader.open(spark, path))
    assert names(s, s.search_after(MatchAll(), [SortField("price"), SortField("tag")], 9)) == "bca"
    assert names(s, s.search_after(MatchAll(), [SortField("tag", Order.DESC)], 9, FieldDoc(0, 1.0, ("z",)))) == "cb"
    assert names(s, s.search_after(F64Range("price", excluded(-2.5), included(1.25)), [SortField("price"), SortField("tag")], 9)) == "ca"
    assert s.count(TermQuery("tag", "z")) == 1
    for q in (F64Range("price", included(math.inf)), I64Range("price"), F64Range("price", included(2.0), included(1.0)), F64Range("id")):
        with pytest.raises(IllegalArgument):
            s.count(q)
    for sort, size, after in (
        (BY_SCORE, 0, None),
        ([], 1, None),
        ([SortField("id")], 1, None),
        ([SortField("price")], 1, FieldDoc(0, 1.0, ("x",))),
        ([SortField("price")], 1, FieldDoc(0, 1.0, (math.nan,))),
        ([SortField("price")], 1, FieldDoc(0, 1.0)),
        (BY_SCORE, 1, FieldDoc(0, 1.0, (1.0,))),
        (BY_SCORE, 1, FieldDoc(0, math.nan)),
    ):
        with pytest.raises(IllegalArgument):
            s.search_after(MatchAll(), sort, size, after)


def test_signed_zeros(spark, tmp_path):
    with IndexWriter.open(spark, str(tmp_path)) as w:
        for i, x in (("m", -0.0), ("p", 0.0), ("one", 1.0), ("minus", -1.0)):
            w.add_document(Document([Field.string("id", i, True), Field.numeric_f64("x", x)]))
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path)))
    got = lambda *b: {s.doc(h.doc).id for h in s.search(F64Range("x", *b), 9).score_docs}
    assert got(included(-0.0)) == {"m", "p", "one"} and got(included(0.0)) == {"p", "one"}
    assert got(excluded(-0.0)) == {"p", "one"} and got(excluded(0.0)) == {"one"}
    assert got(UNBOUNDED, included(-0.0)) == {"minus", "m"} and got(UNBOUNDED, included(0.0)) == {"minus", "m", "p"}
    assert got(UNBOUNDED, excluded(-0.0)) == {"minus"} and got(UNBOUNDED, excluded(0.0)) == {"minus", "m"}
    assert got(included(0.0), included(-0.0)) == set()
    both = BooleanQuery().must(F64Range("x", included(-0.0))).must(F64Range("x", included(0.0)))
    assert s.count(both) == 2
    for order, want in ((Order.ASC, [-1.0, -0.0, 0.0, 1.0]), (Order.DESC, [1.0, 0.0, -0.0, -1.0])):
        seen, last = [], None
        while page := s.search_after(MatchAll(), [SortField("x", order)], 1, last):
            last = page[0]
            seen.append(last.sort_values[0])
        assert list(map(str, seen)) == list(map(str, want))


def test_columns_agree_with_python(spark):
    from pyspark.sql import functions as F

    from lodestone.functions.analysis import SimpleAnalyzer, StandardAnalyzer
    from lodestone.functions.similarity import encode_length, encoded_length

    texts = ["The U.S.A. can't wi-fi 3.14 Ünïcode İstanbul, 東京", "x" * 600, "ΑΣ a.b.c 1,000.5 x.5 x''y ___ foo_bar", "", "a.a." * 3000, "カタカナ ひら กข é́ ½ Ⅷ", "a b\u0085c　d e", "y" * 200_000, "‘quoted’ don’t 12:30 a:b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for a in (StandardAnalyzer(), StandardAnalyzer.english(), WhitespaceAnalyzer(), SimpleAnalyzer()):
        for row in df.select("i", a.tokens(F.col("t")).alias("k")).collect():
            assert [(t.term, t.pos) for t in row.k] == a.tokenize(texts[row.i]), (a, texts[row.i][:40])
    got = spark.range(6000).select("id", encoded_length(F.col("id")).alias("b")).collect()
    assert all(r.b == encode_length(r.id) for r in got)
    assert spark.createDataFrame([((1 << 31) - 1,)], "n long").select(encoded_length(F.col("n"))).first()[0] == 255


def plan_of(df):
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_leave_documents_where_they_are(spark, monkeypatch):
    from lodestone import catalog, searcher
    from lodestone.plans import compile
    from lodestone.plans.query import BooleanQuery, I64Range, MatchAll, TermQuery, included
    from lodestone.searcher import SortField

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at scale: what is broadcast is broadcast for a proven size
    try:
        s = catalog.searcher(spark, "/root/testdata/sf0.001")
        the = TermQuery("text", "the")
        page = plan_of(s.page_df(MatchAll(), [SortField("n_chars"), SortField("lang")], 5))
        assert "Exchange" not in page and "Join" not in page and "TakeOrderedAndProject" in page
        page = plan_of(s.page_df(BooleanQuery().must(the).filter(I64Range("n_chars", included(5), included(5000))), [SortField("n_chars")], 5))
        assert page.count("BroadcastExchange") >= 1 and "SortMergeJoin" not in page and "hashpartitioning" not in page
        monkeypatch.setattr(compile, "DRIVES_FROM", 0)
        small = s.fetch(s.search_df(the, 10), "doc_id", at_most=10)
        assert "hashpartitioning" not in plan_of(small) and "SortMergeJoin" not in plan_of(small)
        monkeypatch.setattr(searcher, "MANY_DOCS", 0)  # as in a large index
        few = s.fetch(s.search_df(the, 10), "doc_id", at_most=10)
        assert sorted(few.collect()) == sorted(small.collect()) and few.columns == small.columns
        few = plan_of(few)
        assert "_doc IN" in few.replace("_doc#", "_doc IN #") or "In(_doc" in few
        assert "hashpartitioning" not in few and "SortMergeJoin" not in few
        many = plan_of(s.fetch(s.search_df(the, 5000), "doc_id", at_most=5000))
        assert "hashpartitioning" not in many and "SortMergeJoin" not in many and "BroadcastHashJoin" in many
        # The rare term drives: postings of the common one are cut before they are shuffled.
        rare = s.reader.terms().where("field = 'text' and doc_freq = 2").orderBy("term").first()["term"]
        both = plan_of(s.plan(BooleanQuery().must(the).must(TermQuery("text", rare))))
        assert "LeftSemi" in both and "BroadcastHashJoin" in both and "SortMergeJoin" not in both
        assert s.count(BooleanQuery().must(the).must(TermQuery("text", rare))) == s.plan(the).join(s.plan(TermQuery("text", rare)), "doc").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
