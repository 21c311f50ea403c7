"""The life of an index: adding, deleting, merging, committing, and reading it meanwhile."""

import json
import os

import pytest

from lodestone import (
    BooleanQuery,
    Corrupt,
    Document,
    Field,
    FieldSpec,
    FunctionAnalyzer,
    IllegalArgument,
    IndexNotFound,
    IndexReader,
    IndexSchema,
    IndexSearcher,
    IndexWriter,
    LockObtainFailed,
    MatchAll,
    MergePolicy,
    PhraseQuery,
    QueryParser,
    StandardAnalyzer,
    Term,
    TermQuery,
    WriterConfig,
)


def doc(i, title, body):
    return Document([Field.string("id", str(i), True), Field.text("title", title, True), Field.text("body", body)])


def ids(searcher, query, n=100):
    return [searcher.doc(h.doc).id for h in searcher.search(query, n).score_docs]


def test_stored_fields_come_back(spark, tmp_path):
    d = Document([Field.text("title", "A Title", True), Field.stored_only("blob", b"\x00\xff\x07"), Field.stored_only("n", -42), Field.stored_only("x", 2.5), Field.text("tag", "a", True), Field.text("tag", "b", True), Field.text("hidden", "secret words")])
    with IndexWriter.open(spark, str(tmp_path)) as w:
        w.add_document(d)
    r = IndexReader.open(spark, str(tmp_path))
    row = r.document(0)
    assert (row.title, bytes(row.blob), row.n, row.x, row.tag) == ("A Title", b"\x00\xff\x07", -42, 2.5, ["a", "b"]) and "hidden" not in row
    assert IndexSearcher(r).count(TermQuery("hidden", "secret")) == 1
    # Positions go on from value to value, so a phrase may reach across.
    assert IndexSearcher(r).count(PhraseQuery("tag").term("a").term("b")) == 1


def test_parsed_queries(spark, tmp_path):
    rows = [(1, "The Rust Programming Language", "systems programming without fear"), (2, "Programming Pearls", "classic essays on programming"), (3, "Rust in Action", "systems programming in rust")]
    with IndexWriter.open(spark, str(tmp_path)) as w:
        for r in rows:
            w.add_document(doc(*r))
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path)))
    p = QueryParser("body", StandardAnalyzer())
    expected = {"programming": "123", "+programming -rust": "12", "title:rust": "13", '"systems programming"': "13", '"programming systems"': "", "title:(pearls OR action)": "23", "essays AND classic": "2"}
    for text, want in expected.items():
        assert "".join(sorted(ids(s, p.parse(text)))) == want, text
    assert ids(s, p.parse("rust^3 essays"))[0] == "3"


def test_updates_deletes_and_merges(spark, tmp_path):
    w = IndexWriter.open(spark, str(tmp_path), WriterConfig(max_buffered_docs=7, merge_policy=MergePolicy(merge_factor=3, min_merge_docs=1000)))
    for i in range(20):
        w.add_document(doc(i, "t", f"common n{i}"))
    w.delete_documents(Term("id", "5"))
    w.add_document(doc(5, "t", "common again"))
    w.update_document(Term("id", "7"), doc(7, "t", "common changed"))
    w.delete_documents(Term("body", "n3"))
    assert w.num_docs == 21  # the last two deletes still wait
    w.commit()
    r = IndexReader.open(spark, str(tmp_path))
    s = IndexSearcher(r)
    assert r.num_docs == 19 and s.count(TermQuery("body", "common")) == 19
    assert s.count(TermQuery("body", "n5")) == 0 and s.count(TermQuery("body", "again")) == 1 and s.count(TermQuery("body", "n7")) == 0
    before = sorted(ids(s, TermQuery("body", "common")))
    w.force_merge(1)
    w.close()
    after = r.reopen()
    assert after is not r and (after.max_doc, after.num_docs, len(after.segments)) == (19, 19, 1)
    assert sorted(ids(IndexSearcher(after), TermQuery("body", "common"))) == before == sorted(ids(s, TermQuery("body", "common")))
    assert r.collection_stats("body").doc_count > after.collection_stats("body").doc_count == 19
    after.check_integrity()


def test_visibility_lock_rollback_and_create(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(IndexNotFound):
        IndexReader.open(spark, path)
    w = IndexWriter.open(spark, path)
    w.add_document(doc(0, "a", "x"))
    w.commit()
    r = IndexReader.open(spark, path)
    w.add_document(doc(1, "a", "x"))
    w.flush()
    assert r.reopen() is r and r.num_docs == 1
    with pytest.raises(LockObtainFailed):
        IndexWriter.open(spark, path)
    w.rollback()
    w = IndexWriter.open(spark, path)
    assert w.num_docs == 1 and w.commit() is False
    w.add_document(doc(2, "a", "x"))
    w.close()
    assert r.reopen().num_docs == 2 and r.num_docs == 1
    with IndexWriter.open(spark, path, WriterConfig(create=True)) as w:
        w.add_document(doc(9, "new", "y"))
    s = IndexSearcher(r.reopen())
    assert s.count(MatchAll()) == 1 and s.count(TermQuery("title", "a")) == 0 and s.count(TermQuery("body", "y")) == 1
    with IndexWriter.open(spark, path) as w:
        w.delete_all()
    assert IndexReader.open(spark, path).num_docs == 0
    assert IndexSearcher(IndexReader.open(spark, path)).search(MatchAll(), 5).total_hits.value == 0


def test_refusals(spark, tmp_path):
    with IndexWriter.open(spark, str(tmp_path)) as w:
        w.add_document(Document([Field.string("k", "v")]))
        with pytest.raises(IllegalArgument):
            w.add_document(Document([Field.text("k", "v")]))
        with pytest.raises(IllegalArgument):
            w.update_document(Term("k", "v"), Document([Field.text("k", "v")]))
        with pytest.raises(IllegalArgument):
            w.force_merge(0)
        assert w.num_docs == 1
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path)))
    assert s.count(TermQuery("k", "v")) == 1
    with pytest.raises(IllegalArgument):
        s.count(PhraseQuery("k").term("a").term("b"))
    with pytest.raises(IllegalArgument):
        s.search(TermQuery("k", "v").boost(float("inf")), 1)
    with pytest.raises(IllegalArgument):
        s.search(BooleanQuery().must(TermQuery("k", "v").boost(-1)), 1)


def test_damage_is_found(spark, tmp_path):
    with IndexWriter.open(spark, str(tmp_path)) as w:
        for i in range(50):
            w.add_document(doc(i, "t", f"some words {i}"))
    r = IndexReader.open(spark, str(tmp_path))
    r.check_integrity()
    name = next(n for n in r.commit.segments[0].files if "/postings/" in n)
    whole = open(tmp_path / name, "rb").read()
    folder, base = os.path.split(tmp_path / name)
    os.remove(f"{folder}/.{base}.crc")
    open(tmp_path / name, "wb").write(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:])
    with pytest.raises(Corrupt, match="part-"):
        r.check_integrity()
    open(tmp_path / name, "wb").write(whole[:-5])
    with pytest.raises(Corrupt):
        IndexReader.open(spark, str(tmp_path))


def test_dataframes_in_and_keys_replaced(spark, tmp_path):
    schema = IndexSchema({"id": FieldSpec.string(True), "body": FieldSpec.text(), "tags": FieldSpec.string(True), "n": FieldSpec.numeric_i64(True)})
    df = spark.createDataFrame([(str(i), f"w{i % 3} all", ["x", f"t{i % 2}"], i) for i in range(30)], "id string, body string, tags array<string>, n long")
    with IndexWriter.open(spark, str(tmp_path), schema=schema) as w:
        w.add_documents(df.repartition(5), order_by=["n"])
        with pytest.raises(IllegalArgument):
            w.add_documents(df.withColumn("more", df.n))
        w.update_documents(df.where("n < 3").withColumn("body", df.id), "id", order_by=["n"])
        w.delete_by(spark.createDataFrame([("tags", "t1"), ("body", "nothing")], "field string, term string"))
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path)))
    assert s.count(MatchAll()) == 15 and s.count(TermQuery("tags", "t1")) == 0
    assert [s.doc(h.doc).n for h in s.search(TermQuery("tags", "x"), 3).score_docs] == [4, 6, 8]
    assert s.count(TermQuery("body", "all")) == 13 and s.reader.locate(29)[0] == 0
    w = IndexWriter.open(spark, str(tmp_path))
    w.force_merge(1)
    w.commit()
    w.vacuum()
    w.close()
    assert len(os.listdir(tmp_path / "segments")) == 1
    assert [s2.doc(h.doc).n for s2 in [IndexSearcher(w.reader())] for h in s2.search(TermQuery("tags", "x"), 20).score_docs] == [*range(4, 30, 2), 0, 2]


def test_an_analyzer_of_ones_own(spark, tmp_path):
    def halves(text):
        """A word, and its first half at the same place."""
        for w in text.split():
            yield w, 1
            yield w[: len(w) // 2], 0

    analyzer = FunctionAnalyzer(halves)
    schema = IndexSchema({"one": FieldSpec.text(), "many": FieldSpec.text(True)})
    df = spark.createDataFrame([("lodestone search", ["first value", None, "second"]), (None, None)], "one string, many array<string>")
    with IndexWriter.open(spark, str(tmp_path), WriterConfig(analyzer=analyzer), schema) as w:
        w.add_documents(df)
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path)))
    assert s.count(TermQuery("one", "lode")) == s.count(TermQuery("many", "sec")) == 1
    assert s.count(PhraseQuery("one").term("lodestone").term("sea")) == 1 and s.count(PhraseQuery("many").term("value").term("second")) == 1
    assert s.count(QueryParser("one", analyzer).parse("nothing search")) == 1


def test_lines_in_and_hits_out(spark, tmp_path):
    from lodestone.sources.files import read_lines, write_hits

    (tmp_path / "in.txt").write_text("one fish\ntwo fish\nred hen\n")
    docs, schema = read_lines(spark, str(tmp_path / "in.txt"))
    with IndexWriter.open(spark, str(tmp_path / "i"), schema=IndexSchema({"body": schema.get("body").with_stored()})) as w:
        w.add_documents(docs)
    s = IndexSearcher(IndexReader.open(spark, str(tmp_path / "i")))
    write_hits(s.fetch(s.search_df(TermQuery("body", "fish"), 5), "body"), ["body"], str(tmp_path / "out"))
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(h["fields"]["body"] for h in got) == ["one fish", "two fish"] and all(set(h) == {"doc", "score", "fields"} for h in got)


def test_streams_fill_an_index(spark, tmp_path):
    from lodestone.streaming.ingest import ingest

    source, path = tmp_path / "in", str(tmp_path / "index")
    schema = IndexSchema({"id": FieldSpec.string(True), "body": FieldSpec.text(True)})
    kinds = "id string, body string"
    for round_, rows in enumerate([[("a", "one"), ("b", "two")], [("a", "three")]]):
        spark.createDataFrame(rows, kinds).write.mode("append").json(str(source))
        q = ingest(spark.readStream.schema(kinds).json(str(source)), path, schema, str(tmp_path / "cp"), key="id", order_by=["id"])
        q.awaitTermination(120)
        s = IndexSearcher(IndexReader.open(spark, path))
        assert s.count(MatchAll()) == 2 and s.count(TermQuery("body", "three")) == round_


def test_command_line(spark, tmp_path, capsys):
    from lodestone.__main__ import arguments, run

    lines = [{"id": "A1", "body": "red fox", "n": 3, "ok": True, "tags": ["u", "v"], "skip": None}, {"id": "B2", "body": "red hen", "n": 4, "ok": False, "tags": []}]
    (tmp_path / "in.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    path = str(tmp_path / "index")

    def call(*args):
        run(spark, arguments().parse_args([str(a) for a in args]))
        return capsys.readouterr().out

    call("index", path, tmp_path / "in.jsonl", "--keyword", "id", "--create")
    hits = [json.loads(x) for x in call("search", path, "red fox").splitlines()]
    assert hits[0]["fields"] == {"id": "A1", "body": "red fox", "n": 3, "ok": "true", "tags": ["u", "v"]} and len(hits) == 2
    assert len(call("search", path, "red fox", "--and").splitlines()) == 1 and len(call("search", path, "ok:true").splitlines()) == 1
    call("delete", path, "id", "A1")
    assert json.loads(call("stats", path))["deleted_docs"] == 1
    call("merge", path)
    assert json.loads(call("stats", path))["max_doc"] == 1 and call("check", path).startswith("intact: segments 1, documents 1")
