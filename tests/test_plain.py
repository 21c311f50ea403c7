"""What needs no Spark: scoring, analysis, query strings, simplification, merges."""

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone import BooleanQuery, ConstantScore, F64Range, FieldSpec, IllegalArgument, IndexSchema, MatchNone, MergePolicy, Operator, PhraseQuery, QueryParse, QueryParser, TermQuery
from lodestone.document import Document, Field
from lodestone.functions import similarity as sim
from lodestone.functions.analysis import FunctionAnalyzer, KeywordAnalyzer, PerFieldAnalyzer, SimpleAnalyzer, StandardAnalyzer, WhitespaceAnalyzer
from lodestone.plans.query import Boost, Occur, included

bits = lambda x: struct.unpack("<I", struct.pack("<f", x))[0]
T = lambda t: TermQuery("body", t)


def test_scores_bit_for_bit():
    assert bits(sim.idf(54505, 54505)) == 0x3719E736
    assert bits(sim.Bm25.for_term(1.0, 54505, 54505, 54505).score(1.0, 1)) == 0x368BE976


def test_length_bytes():
    assert [sim.encode_length(n) for n in range(24)] == list(range(24))
    codes = [sim.encode_length(n) for n in range(5000)]
    assert codes == sorted(codes) and all(sim.decode_length(b) <= n for n, b in enumerate(codes))
    assert sim.encode_length((1 << 31) - 1) == 255
    assert [sim.encode_length(sim.decode_length(b)) for b in range(256)] == list(range(256))


def test_standard_analyzer():
    words = [t for t, _ in StandardAnalyzer().tokenize("The U.S.A. can't wi-fi 3.14 Ünïcode İstanbul, 東京")]
    assert words == ["the", "u.s.a", "can't", "wi", "fi", "3.14", "ünïcode", "istanbul", "東", "京"]
    assert StandardAnalyzer.english().tokenize("the quick and the dead") == [("quick", 1), ("dead", 4)]
    assert [(len(t), p) for t, p in StandardAnalyzer().tokenize("x" * 600)] == [(255, 0), (255, 1), (90, 2)]
    with pytest.raises(IllegalArgument):
        StandardAnalyzer(max_token_length=0)


def test_other_analyzers():
    assert WhitespaceAnalyzer().tokenize("a b c\td") == [("a b", 0), ("c", 1), ("d", 2)]
    assert [t for t, _ in SimpleAnalyzer().tokenize("Hello, World42x")] == ["hello", "world", "x"]
    assert KeywordAnalyzer().tokenize("New York") == [("New York", 0)] and KeywordAnalyzer().tokenize("") == []
    per = PerFieldAnalyzer(StandardAnalyzer(), {"id": KeywordAnalyzer()})
    assert per.for_field("id").tokenize("A b") == [("A b", 0)] and per.for_field("x").tokenize("A b") == [("a", 0), ("b", 1)]


@pytest.mark.parametrize("text", ["foo*", "fo?", "foo~", '"a b"~2', "[a TO b]", "(a", '"open', "a:b:c", "a\\", '"a\\', "a^", "a^x", ")", "AND"])
def test_refused_query_strings(text):
    with pytest.raises(QueryParse):
        QueryParser("body", StandardAnalyzer()).parse(text)


def test_query_strings():
    p = QueryParser("body", StandardAnalyzer())
    assert p.parse("a && b || c") == BooleanQuery().must(T("a")).must(T("b")).should(T("c"))
    assert p.parse("+a -b !c d") == BooleanQuery().must(T("a")).must_not(T("b")).must_not(T("c")).should(T("d"))
    assert p.parse("title : (x OR y)^2") == BooleanQuery().should(TermQuery("title", "x")).should(TermQuery("title", "y")).boost(2)
    assert p.parse('"a b"') == PhraseQuery("body").term("a").term("b")
    assert p.parse("wi-fi") == BooleanQuery().should(T("wi")).should(T("fi"))
    assert p.parse("a\\:b") == BooleanQuery(((T("a:b"), Occur.SHOULD),)).clauses[0][0]
    assert p.parse("...") == MatchNone() and p.parse("") == MatchNone()
    assert p.parse("-a").rewrite() == MatchNone()
    both = p.default_operator(Operator.AND)
    assert both.parse("a b OR c") == BooleanQuery().must(T("a")).should(T("b")).should(T("c"))
    stop = QueryParser("body", StandardAnalyzer.english())
    assert stop.parse('"quick and the dead"') == PhraseQuery("body", (("quick", 0), ("dead", 3)))
    assert stop.parse("x AND the") == T("x")
    same = QueryParser("body", FunctionAnalyzer(lambda t: [(w, 1) for w in t.split("/")][:1] + [(w, 0) for w in t.split("/")[1:]]))
    assert same.parse("x/y") == BooleanQuery().should(BooleanQuery().should(T("x")).should(T("y")))


def test_simplification():
    assert BooleanQuery().should(T("a")).should(T("a").boost(2)).should(T("b")).rewrite() == BooleanQuery().should(T("a").boost(3)).should(T("b"))
    assert T("a").boost(2).boost(3).rewrite() == Boost(T("a"), 6.0)
    assert T("a").boost(1).rewrite() == T("a")
    assert ConstantScore(ConstantScore(T("a")).boost(2)).rewrite() == ConstantScore(ConstantScore(T("a"))).rewrite() == ConstantScore(T("a"))
    assert PhraseQuery("body").rewrite() == MatchNone() and PhraseQuery("body").term("a").rewrite() == T("a")
    assert BooleanQuery().must(T("a")).filter(MatchNone()).rewrite() == MatchNone()
    assert BooleanQuery().must(T("a")).at_least(1).rewrite() == MatchNone()
    assert BooleanQuery().filter(T("a")).rewrite() == Boost(ConstantScore(T("a")), 0.0)
    assert BooleanQuery().must(T("a")).filter(T("a")).rewrite() == T("a")
    assert BooleanQuery().must(T("a")).filter(T("a")).filter(T("b")).filter(T("b")).rewrite() == BooleanQuery().must(T("a")).filter(T("b"))
    assert BooleanQuery().must_not(T("a")).rewrite() == BooleanQuery().rewrite() == MatchNone()
    assert BooleanQuery().should(T("a")).should(T("a")).at_least(2).rewrite() == MatchNone()


def test_bits_decide_equality():
    assert F64Range("x", included(-0.0)) != F64Range("x", included(0.0))
    assert Boost(T("a"), 0.0) != Boost(T("a"), -0.0)


def test_merge_policy():
    p = MergePolicy()
    assert p.find_merges([10] * 9) == [] and p.find_merges([10] * 10) == [range(10)]
    assert p.find_merges([10] * 25) == [range(10), range(10, 20)]
    assert p.find_merges([1_000_000] + [500] * 10) == [range(1, 11)]
    assert MergePolicy(max_merge_docs=10).find_merges([10] * 10) == []


def test_schema_rules():
    a = IndexSchema({"k": FieldSpec.string(True)})
    with pytest.raises(IllegalArgument):
        a.merged(IndexSchema({"k": FieldSpec.text()}))
    assert a.merged(IndexSchema({"k": FieldSpec.stored_only()})).get("k") == FieldSpec.string(True)
    with pytest.raises(IllegalArgument):
        IndexSchema({"x": FieldSpec.numeric_i64()}).merged(IndexSchema({"x": FieldSpec.numeric_f64()}))
    with pytest.raises(IllegalArgument):
        IndexSchema({"x": FieldSpec(stored=False)})
    for bad in ([Field.numeric_f64("x", float("nan"))], [Field.numeric_f64("x", 1)], [Field.numeric_i64("x", 1), Field.numeric_i64("x", 2)], [Field("x", 3, FieldSpec.text())]):
        with pytest.raises(IllegalArgument):
            Document(bad).schema(IndexSchema())
    assert IndexSchema.from_json(a.to_json()) == a


@given(st.text())
def test_lexing_never_hangs(text):
    try:
        QueryParser("body", StandardAnalyzer()).parse(text)
    except QueryParse:
        pass


def test_the_engine_stands_alone():
    import pathlib

    import lodestone

    top = pathlib.Path(lodestone.__file__).parent
    users = [p for p in top.rglob("*.py") if "llm" not in p.parts and "lodestone.llm" in p.read_text()]
    assert users == []
