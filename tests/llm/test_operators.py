"""The operators against plain Python, libraries and awkward rows."""

import random
import re
import string
import struct

import pytest
from pyspark.sql import functions as F

import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Texts that break things: nothing, blanks, other scripts, surrogate pairs, special tokens, long runs.
ODD = [None, "", " \t\n", "a", "İstanbul ΑΣ ﬁ é́", "<|endoftext|> x <s> </s> <unk>", "▁▁ ▁a  b", " x y　z", "𝔘𝔫𝔦 👩‍👩‍👧 \x00\x01", "x" * 3000, "ab " * 4000, "\n\n\r\n a\n a\n", "don't I'LL we've 123 12,5 !?!?", "日本語テキスト 中文 ไทย", "﻿a​b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with repeated rows, null ids, and columns whose names operators use themselves."""
    rows = [(i, t, None, None, None, i) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 1, 9), (None, "no id here", "en", "s", 1, 9), (None, None, None, None, None, None)]
    kinds = DOCS + ", n long, p string, h string, fp string, _m string, _k string, copies long"
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", 1) for r in rows], kinds)


def texts(df):
    return {r.doc_id: r.text for r in df.where("doc_id is not null").collect()}


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts(spark, docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.tokens import count_tokens

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        want = texts(df)
        got = count_tokens(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None:
                t = want[r.doc_id] or ""
                assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)), r.doc_id
                assert r.over_limit == (r.n_tokens > 1024)
    assert count_tokens(empty(spark)).count() == 0


def test_random_strings_count_as_in_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.tokens import count_tokens

    r = random.Random(3)
    alphabet = string.printable + "äéßñçİΣ  日本👍́"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(200)))) for i in range(300)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {x.doc_id: x.n_tokens for x in count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_long_words_count_as_in_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.common import tokenizer_bytes
    from lodestone.llm.tokens import LONG, Merger

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    m, r = Merger(tokenizer_bytes("byte_bpe_50k.json")), random.Random(8)
    for letters in ("a", "ab", "étaoin", string.ascii_lowercase):
        for n in (1, 2, 3, LONG - 1, LONG + 1, 30_000):
            word = "".join(r.choice(letters) for _ in range(n))
            want = len(library.encode(word, add_special_tokens=False).ids)
            assert m.counts([b"a", word.encode(), b"bc"]).tolist()[1] == m.count_long(word.encode()) == want


def test_sentencepiece(spark, docs, odd):
    import public_tokenizers
    import sentencepiece

    from lodestone.llm.pieces import encode_pieces, piece_digests

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for df in (docs, odd):
        want = {i: library.encode(t or "") for i, t in texts(df).items()}
        for r in encode_pieces(df).collect():
            if r.doc_id is not None:
                assert r.ids == want[r.doc_id] and r.decoded == library.decode(want[r.doc_id])
        for r in piece_digests(df).collect():
            if r.doc_id is not None:
                ids = want[r.doc_id]
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids)))
    assert piece_digests(empty(spark)).count() == 0


def test_agenda_gives_up_the_best_pair_first():
    from lodestone.llm.common import tokenizer_bytes
    from lodestone.llm.pieces import Pieces

    p, r = Pieces(tokenizer_bytes("piece_bpe_32k.model"), check=False), random.Random(4)

    def by_hand(unit):
        s = list(unit)
        while True:
            pairs = [(-p.pieces[p.known[a + b]][1], i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in p.known]
            if not pairs:
                return s
            i = min(pairs)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    for n in [*range(1, 60), 97, 300, 1000]:
        unit = "▁" + "".join(r.choice("abeinorst▁日é\x00") for _ in range(n))
        assert p.merge(unit) == by_hand(unit)
        assert p.merge("e" * n) == by_hand("e" * n)


def near_copies(r, n=60):
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(400)]
    rows = []
    for k in range(n):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 5, 60, 400]))]
        for _ in range(r.randrange(1, 5)):
            own = list(base)
            if len(own) > 100 and r.random() < 0.7:
                own[r.randrange(len(own))] = "changed"
            rows.append((len(rows) + 1, " ".join(own) if r.random() < 0.8 else "  ".join(own).upper()))
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash(spark, docs, odd, hot):
    from lodestone.llm.simhash import simhash_components

    rows = near_copies(random.Random(6)) + [(1000, None), (1001, ""), (1002, "\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.simhash(rows)
    assert len({c for _, c in want.values()}) < len(want)
    got = simhash_components(df, hot=hot)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == want
    if hot > 3:
        got = simhash_components(docs).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute.simhash(texts(docs).items())
        found = simhash_components(odd).collect()
        assert len(found) == odd.count() and [r.component_id for r in found if r.fingerprint == "0" * 16 and r.doc_id is None] == [0]
        assert simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 20])
def test_distances_by_bit_planes(radius):
    import numpy as np

    from lodestone.llm.simhash import neighbours

    r = np.random.default_rng(radius)
    sizes = np.r_[r.integers(1, 9, 40), 200, 1, 3]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    x = r.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    for _ in range(radius + 1):  # some are copies of one before, but for a few bits
        near = np.maximum(0, np.arange(x.size) - r.integers(1, 5, x.size))
        x = np.where(r.random(x.size) < 0.6, x[near] ^ (np.uint64(1) << r.integers(0, 64, x.size, dtype=np.uint64)), x)
    got = [p for i, j in neighbours(starts, x, 64, radius) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(i, j) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) for i in range(s, s + n) for j in range(i + 1, s + n) if int(x[i] ^ x[j]).bit_count() <= radius}
    assert len(got) == len(want) and set(got) == want and (radius == 0 or want)


def test_words_of_distant_pairs_are_abandoned():
    import numpy as np

    from lodestone.llm.simhash import Planes

    x = np.zeros(6400, np.uint64)
    x[1::2] = ~np.uint64(0)  # each is far from the next one, and the same as the second next
    lanes, words = np.full(100, ~np.uint64(0)), np.arange(100)
    p = Planes(x, 64)
    assert not p.near(1, words, lanes, 2)[:-1].size and p.read <= 8 * 100 + 64
    p = Planes(x, 64)
    assert p.near(2, words, lanes, 2).size >= 6398 and p.read == 64 * 100


@pytest.mark.parametrize("hot", [4096, 4])
def test_one_of_each_group_stays(spark, docs, odd, hot):
    from lodestone.llm.simhash import keep_one

    r = random.Random(12)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(400)]
    rows = []
    for _ in range(40):  # texts, copies of them, chains of changed copies, and texts that only share a passage
        own = [r.choice(words) for _ in range(r.choice([3, 60, 200]))]
        for _ in range(r.randrange(1, 6)):
            rows.append((len(rows), " ".join(own)))
            for _ in range(r.choice([0, 1, 2, 9])):
                own[r.randrange(len(own))] = r.choice(words)
        rows.append((len(rows), " ".join(own[: len(own) // 2] + [r.choice(words) for _ in own])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, c in brute.near_copies(rows).items() if i == c}
    assert 40 < len(want) < len(rows) and {x.doc_id for x in keep_one(df, hot=hot).collect()} == want
    if hot == 4:
        return
    want = {i for i, c in brute.near_copies(texts(docs).items()).items() if i == c}
    kept = keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    got = keep_one(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and ids.count(None) == 1 and keep_one(empty(spark)).count() == 0


def test_embeddings(spark):
    from lodestone.llm.gridorder import embedding_groups

    r = random.Random(9)
    rows = []
    for k in range(120):
        base = [r.gauss(0, 1) for _ in range(16)]
        for _ in range(r.randrange(1, 5)):
            noise = r.choice([0, 0.01, 0.05, 0.12])
            rows.append((len(rows) + 1, [x * 3 + r.gauss(0, noise) for x in base] if noise else base, k % 3 if r.random() < 0.95 else None))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [nan] + [1.0] * 15, 1), (904, [inf] * 16, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1.0], 2), (909, [-1.0], 2)]
    single = lambda v: v and [x if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]
    floats = [(i, single(v), label) for i, v, label in rows]
    df = spark.createDataFrame([(*x, "clash", 5) for x in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    want = brute.cosine_groups(floats, 0.98)
    assert sum(n for n, _, _ in want.values()) > 50
    found = lambda df, **o: {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_groups(df, **o).collect()}
    assert found(df) == want and found(df, block=150) == want
    # Doubles stay doubles, and neither very large nor very small ones leave their range.
    rows += [(950 + k, v, 7) for k, v in enumerate([[1e50, 1e50], [2e50, 2e50], [1e-60, 1e-60], [1.0, 1.0], [1e308, 1e308], [5e-324, 5e-324], [1.0, -1.0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(df) == brute.cosine_groups(rows, 0.98) and found(df)[953][:2] == (5, 950)
    assert embedding_groups(df.limit(0)).count() == 0 and embedding_groups(df.where("vec_id = 902")).first().kept
    copies = spark.createDataFrame([(i, [0.5, 0.25], 1) for i in range(1, 400)], "vec_id long, embedding array<float>, label int")
    assert {(x.n_links, x.component_id) for x in embedding_groups(copies).collect()} == {(398, 1)}
    # An id on two vectors, and none.
    twice = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.0], 1), (7, [0.0, 2.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embedding_groups(twice).where("vec_id is not null").collect())) == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]
    assert [(x.n_links, x.component_id, x.kept) for x in embedding_groups(twice).where("vec_id is null").collect()] == [(0, None, True)]


def test_boxes_prove_dense_groups():
    import numpy as np

    from lodestone.llm.gridorder import AXES, Block, BlockJoin, placed

    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(4, AXES)), 500, axis=0) + r.normal(size=(2000, AXES)) * 1e-4
    b = Block(np.arange(2000).tobytes(), np.arange(2000).tobytes(), np.full(2000, 2).tobytes(), x.tobytes(), placed(x, None).tobytes(), "f8")
    got = BlockJoin(b, None, 0.98, 0.2)
    assert got.proven > 4 * got.computed and set(got.more_a.tolist()) == {998} and set(got.forest.roots().tolist()) == {0, 500, 1000, 1500}


def test_chain_of_links_is_one_group(spark):
    import math

    from lodestone.llm.gridorder import embedding_groups

    rows = [(i, [math.cos(0.15 * i), math.sin(0.15 * i), 0.0], 1) for i in range(1, 16)]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.component_id for r in got} == {1} and max(r.n_links for r in got) == 2


def test_quality(spark, docs, odd):
    from lodestone.llm.quality import keep_good, quality

    for df in (docs, odd):
        want = {i: brute.measures(t) for i, t in texts(df).items()}
        got = quality(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r.doc_id
                assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in quality(docs).where("kept").collect()}
    good = keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    failed = {r.doc_id for r in quality(docs).where("base_failed").collect()}
    judged = [(labels[i], i in kept) for i in labels if i not in failed]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)
    assert quality(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0 and keep_good(odd).columns == odd.columns


def test_quality_stays_in_the_jvm(docs):
    from lodestone.llm.quality import keep_good, quality

    for df in (quality(docs), keep_good(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_expectation_maximisation_finds_the_noisy_rule():
    from lodestone.llm.quality import RULES, estimate

    r, counts = random.Random(1), {}
    for _ in range(4000):
        good = r.random() < 0.8
        votes = tuple((1 if good else -1) if r.random() < (0.55 if k == 0 else 0.9) else (-1 if good else 1) for k in range(len(RULES)))
        counts[votes] = counts.get(votes, 0) + 1
    share, chance = estimate(sorted(counts.items()))
    assert abs(share - 0.8) < 0.03 and chance[0][1][0] < 0.65 and all(c[1][0] > 0.85 for c in chance[1:])


def test_language(spark, docs, odd):
    from lodestone.llm.langid import identify, keep_identified

    got = identify(docs).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    both = identify(docs.unionByName(odd.select(*docs.columns))).collect()
    assert {r.lang_pred for r in both if r.doc_id is None} <= {"und", "en", "fr", "de", "es"}
    nothing = {r.doc_id: (r.lang_pred, r.score) for r in identify(odd.where("lang is null")).collect()}
    assert set(nothing.values()) == {("und", 0.0)}
    assert identify(empty(spark)).count() == 0
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np

    from lodestone.llm.langid import FLOOR, PieceModel

    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    prob = np.array([[0.05, 0.2], [0.1, 0.05], [0.2, 0.1], [0.15, 0.1], [0.2, 0.3], [0.1, 0.1], [0.1, 0.1], [0.1, 0.05]])
    m = PieceModel(["x", "y"], pieces, prob)

    def by_hand(word, lang):
        text, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            p = 1.0
            for a, b in zip(at, at[1:], strict=False):
                own = prob[pieces.index(text[a:b]), lang] if text[a:b] in pieces else 0.0
                p *= own + (FLOOR if b - a == 1 else 0)
            total += p
        return np.log(total)

    for word in ("ab", "aba", "abab", "bca"):
        assert m.word_scores([word])[0] == pytest.approx([by_hand(word, k) for k in (0, 1)])
        assert m.long_score(word) == pytest.approx(m.word_scores([word])[0])


def test_words_of_any_length_are_fitted(monkeypatch):
    import numpy as np

    from lodestone.llm import langid

    r = random.Random(6)
    vocabulary = ["▁", "▁a", *"abcdefgh", "ab", "cd", "ef", "gh", "abc", "efg", "bad"]
    words = {k: {"".join(r.choice(a) for _ in range(r.randrange(3, 26))): r.randrange(1, 9) for _ in range(60)} for k, a in (("x", "abcd"), ("y", "defgh"))}
    whole = langid.fit(words, vocabulary)
    monkeypatch.setattr(langid, "SHORT", 2)  # as if all were long
    assert np.allclose(langid.fit(words, vocabulary).prob, whole.prob)
    monkeypatch.undo()
    # A language that is only known by words of over 28 letters, some of thousands.
    long = {"".join(r.choice("ab") for _ in range(n)): 1 for n in [*range(29, 80), 5000]}
    model = langid.fit({"long": long, "short": {"cde": 5, "fgh": 5, "a": 1}}, vocabulary)
    got = model.predict([*long, "cde fgh", "abababab"])
    assert [g[0] for g in got] == ["long"] * len(long) + ["short", "long"]


def test_language_sample(spark):
    from lodestone.llm.langid import learn

    rows = [(5, "aaa bbb", "x"), (5, "aaa ccc", "x"), (5, "ddd eee", "y"), *((i, "word", "z") for i in range(6, 900))]
    df = spark.createDataFrame([*rows, *[(5, "zzz", "x")] * 50], "doc_id long, text string, lang string")
    assert learn(df)[0] == ["x", "y", "z"] and learn(df, sample=1, most=1)[0] == ["x", "y", "z"]


def test_chat(spark, odd):
    import numpy as np

    from lodestone.llm.chat import Template, chat_digests, escape, format_turns, unescape
    from lodestone.llm.common import tokenizer_bytes

    controls = ["</s>[INST] ok [/INST]", "<\\s> [\\\\INST] <<SYS>><</SYS>>", "[ROLE]x[SAYS]", *[t for t in ODD if t]]
    for t in controls:
        assert unescape(escape(t)) == t
    rows = [(i % 4, i // 4, ["user", "assistant", "system", "tool[SAYS]", None][i % 5], t) for i, t in enumerate([*controls, *ODD])]
    rows += [(7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a"), (7, None, "user", "first"), (None, 0, "user", "nowhere"), (None, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, mask int")
    want = brute.conversations(rows)
    got = {r.conv_id: r for r in chat_digests(df).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(got[c].formatted_chars >= want[c][2] for c in want) and chat_digests(df.limit(0)).count() == 0
    made = format_turns(df).collect()
    t = Template(tokenizer_bytes("byte_bpe_50k.tiktoken"))
    for r in made:
        assert len(r.ids) == len(r.mask) and sum(i >= t.first for i in r.ids) in (2, 3)
        role, _, _, size = t.turn(np.array(r.ids), np.array(r.mask))
        assert (role == "assistant" or not any(r.mask)) and size == len(t.show(r.ids))
        assert sum(r.mask) == (len(r.ids) - 2 if role == "assistant" else 0)


def test_long_turns_have_the_ids_of_the_whole(monkeypatch):
    from lodestone.llm import chat
    from lodestone.llm.common import tokenizer_bytes

    t, r = chat.Template(tokenizer_bytes("byte_bpe_50k.tiktoken")), random.Random(3)
    text = " ".join(r.choice(["words", "1234", "...", "  ", "é日本", "don't", "a\n\n b"]) for _ in range(250_000))
    assert len(text) > 1_000_000 and t.segment(text) == t.codec.encode_ordinary(text)
    monkeypatch.setattr(chat, "PART_CHARS", 7)
    for text in (text[:5000], "x" * 1000, " " * 1000, "no cut!" * 100, ""):
        assert t.segment(text) == t.codec.encode_ordinary(text)


def test_toxicity(spark, docs, odd):
    from lodestone.llm.toxicity import toxic_scores

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rude = ["zogword", "zogling", "vexfoo", "vexbar"]
    rows, labels = [], []
    for i in range(1200):
        w = [r.choice(words) for _ in range(r.randrange(20, 60))]
        bad = r.random() < 0.3
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(rude))
        rows.append((i, " ".join(w), "xx" if i % 2 else "yy"))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxic_scores(df, marks, epochs=6).collect()}
    assert all(x.held_out == (brute.fold(i, 3) == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for i, x in got.items())
    held = [(dict(labels)[i], x.predicted) for i, x in got.items() if x.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    # What is held out changes nothing.
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxic_scores(df, other, epochs=6).collect()} == {i: x.score for i, x in got.items()}
    assert {x.score for x in toxic_scores(odd, marks.where("toxic = 0")).collect()} == {0.0}
    # Of rows with one id one is learned from; null and empty texts have the score of a text without words.
    again = df.unionByName(spark.createDataFrame([(0, "~ last by name", "xx")] * 30, df.schema))
    assert {x.doc_id: x.score for x in toxic_scores(again, marks, epochs=6).collect() if x.doc_id} == {i: x.score for i, x in got.items() if i}
    blank = spark.createDataFrame([(5000, None, None), (5001, "", None), (5002, " 12 ", "xx"), (None, "zogword", None)], df.schema)
    blank = toxic_scores(df.unionByName(blank), marks, epochs=6).where("doc_id >= 5000 or doc_id is null").collect()
    assert len({x.score for x in blank if x.doc_id}) == 1 and not any(x.predicted for x in blank if x.doc_id) and [x.held_out for x in blank if x.doc_id is None] == [False]
    mixed = toxic_scores(df.unionByName(odd.select("doc_id", "text", "lang")), marks, epochs=1)
    assert mixed.count() == df.count() + odd.count() and toxic_scores(empty(spark), marks).count() == 0


def test_long_texts_score_as_whole():
    import numpy as np

    from lodestone.llm import toxicity as x

    c = x.Classifier(x.Net(), np.zeros((x.BUCKETS + 1, 2), np.float32), [0.0] * 3, 1.0)
    text = " ".join(random.Random(2).choices(["alpha", "beta", "gamma", "delta", "eps"], k=1000))
    whole = c.logit(text)[0]
    old, x.CHUNK_WORDS = x.CHUNK_WORDS, 7
    try:
        assert c.logit(text)[0] == pytest.approx(whole, rel=1e-5)
    finally:
        x.CHUNK_WORDS = old


def test_mixture(spark, docs, odd):
    import math

    from lodestone.llm.mixing import exponent, mix, mixture

    sizes = {"a": 6000, "b": 2500, "c": 900, "d": 100, None: 400}
    r, rows = random.Random(7), []
    for s, total in sizes.items():
        while total > 0:
            n = min(total, r.randrange(1, 12))
            rows.append((len(rows), " ".join("w" for _ in range(n)), s))
            total -= n
    rows += [(9000, "", "none"), (9001, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    all_ = sum(sizes.values())
    p = {s: n / all_ for s, n in sizes.items()}
    for entropy, repeats in ((0.95, 100.0), (0.95, 3.0), (1.0, 100.0), (0.2, 4.0)):
        totals = spark.createDataFrame([(str(s), n) for s, n in sizes.items()], "_k string, tokens long")
        a, z = exponent(totals, all_, entropy, repeats)
        w = {s: x**a / z for s, x in p.items()}
        h = -sum(x * math.log(x) for x in w.values()) / math.log(5)
        most = max(w[s] / p[s] for s in p)
        natural = -sum(x * math.log(x) for x in p.values()) / math.log(5)
        assert sum(w.values()) == pytest.approx(1) and most <= repeats * (1 + 1e-9)
        assert h == pytest.approx(max(entropy, natural), abs=1e-6) or most == pytest.approx(repeats, abs=1e-6)
        got = mixture(df, entropy=entropy, repeats=repeats).collect()
        assert len(got) == len(rows)
        drawn = {s: sum(x.copies * x.n_tokens for x in got if x.source == s) for s in sizes}
        for s in sizes:
            largest = max(sum(x.n_tokens for x in got if x.source == s and x.block == b) for b in {x.block for x in got if x.source == s})
            assert abs(drawn[s] - w[s] * all_) <= largest, s
            assert next(x.weight for x in got if x.source == s) == pytest.approx(w[s])
            assert len({x.copies for x in got if x.source == s}) <= 2
        assert {x.copies for x in got if x.source == "none"} == {0}
    out = mix(df, entropy=1.0)
    copies = {x.doc_id: x.copies for x in mixture(df, entropy=1.0).collect()}
    assert out.columns == df.columns and {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert mixture(df.limit(0)).count() == 0 and mix(odd).columns == odd.columns and mixture(odd).count() == odd.count()


def test_mixture_by_hand(spark):
    """Budgets below and above the corpus, repeated rows, null ids: copies as one window over all blocks of a source gives them."""
    from pyspark.sql import Window

    from lodestone.llm import mixing

    r, rows = random.Random(17), []
    for i in range(900):
        rows.append((i if r.random() < 0.95 else None, " ".join("w" for _ in range(r.randrange(0, 15))), r.choice("aaaaaaabbc")))
    rows += [(5, "same row again", "b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for budget, blocks in ((500, 64), (6000, 256), (40_000, 4096), (0, 16)):
        got = mixing.mixture(df, budget=budget, blocks=blocks, repeats=100.0)
        each = got.groupBy("source", "block").agg(F.sum("n_tokens").alias("b"), F.min("copies").alias("copies"), F.max("copies").alias("most"))
        tokens = got.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("weight").alias("weight"))
        share = F.col("weight") * budget
        each = each.join(tokens, "source").withColumns({"whole": F.floor(share / F.col("tokens")), "left": share - F.floor(share / F.col("tokens")) * F.col("tokens")})
        turn = F.xxhash64(F.lit(0), F.col("whole"), mixing.key_of(F.col("source")), F.col("block"))
        before = F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        want = F.col("whole") + (before + F.col("b") / 2 < F.col("left")).cast("long")
        found = each.withColumn("want", want).collect()
        assert all(x.copies == x.most == x.want for x in found), (budget, blocks)
        drawn = sum(x.copies * x.b for x in found)
        assert abs(drawn - budget) <= sum(max(x.b for x in found if x.source == k) for k in "abc")


PAGE = '<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="</p>"</script></head><body class="home">{nav}{body}</body></html>'


def test_html(spark):
    from lodestone.llm.wrappers import extract, main_text

    cases = {
        "<article><h1>A &amp; B</h1><p>x\n  y<br>z<p>&lt;q&gt; caf&eacute; &#8364; &am &amp</article>": "A & B\nx y z\n<q> café € &am &",
        '<div class="cookie-notice">Hi</div><main><p>One<p>Two</main><aside>no</aside><div id="comments"><p>bad</div>': "One\nTwo",
        "<p>a<b>b</b>c <i>d</i></p><form><p>no</form><ul><li>1<li>2</ul><div class=ad>no</div>": "abc d\n1\n2",
        '<header><h1>Site</h1></header><div class="sidebar">no</div><div><p>yes</div><footer>no</footer>': "yes",
        "<table><tr><td>1<td>2<tr><td>3</table><!-- no --><p>3 < 4": "1\n2\n3\n3 < 4",
        '<article><p>in</p><div class="advert">no</div><article class="comment">no</article></article>': "in",
        "": "",
        "plain": "plain",
        "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
    }
    for html, want in cases.items():
        assert main_text(html) == want, html[:80]
    r = random.Random(3)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(word() for _ in range(8)) for _ in range(r.randrange(1, 6))]
        # This site says nothing about its parts: what all its pages share must be the template.
        body = "<div><b>Welcome to the site</b></div><div><i>Start</i><i>News</i></div><div>" + "".join(f"<p>{x}</p>" for x in own) + "<p>Licensed to all.</p></div><div><b>All rights kept</b></div>"
        rows.append((i, f"https://Site.example.com/{i}", PAGE.format(t=word(), nav="", body=body)))
        want[i] = "\n".join([*own, "Licensed to all."])
    rows += [(100, None, None), (101, "not a url", ""), (102, "http://x.org", PAGE.format(t="t", nav="<nav>no</nav>", body="<p>ok"))]
    want.update({100: "", 101: "", 102: "ok"})
    same = PAGE.format(t="t", nav="", body="<article><p>copy of one page</p></article>")
    rows += [(200 + i, "http://copies.org/a", same) for i in range(30)]
    want.update({200 + i: "copy of one page" for i in range(30)})
    # Near copies of one article are no template of their site.
    for i in range(20):
        rows.append((300 + i, f"http://near.org/{i}", PAGE.format(t="News", nav=f"<nav>{word()}</nav>", body=f"<article><h1>Same heading</h1><p>Same text but {i}</p></article>")))
        want[300 + i] = f"Same heading\nSame text but {i}"
    df = spark.createDataFrame([(*x, "t", "w") for x in rows], "page_id long, url string, html string, text string, wrapper string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "wrapper", "text", "n_chars"]
    assert {x.page_id: x.text for x in got.collect()} == want and all(x.n_chars == len(x.text) for x in got.collect())
    assert extract(df.limit(0)).count() == 0


def test_simple_tree_matching():
    from lodestone.llm.wrappers import matching, parse, skeleton

    tree = lambda h: skeleton(parse(h))[0]
    a, b = tree("<div><p>1</p><ul><li>x</ul><h1>t</h1></div>"), tree("<div><p>2</p><p>3</p><h1>t</h1><ul><li>y<li>z</ul></div>")
    # html, div, p, and of (ul li) and h1, which change places, the larger one.
    assert matching(a, b, {})[0] == 5 and matching(a, a, {})[0] == 6


def page_of(t, *parts):
    return f"<html><head><title>{t}</title></head><body>" + "".join(parts) + "</body></html>"


def test_html_counts_all_pages_of_a_host(spark):
    from lodestone.llm.wrappers import extract

    r = random.Random(8)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    rows, want = [], {}
    for i in range(80):
        own = " ".join(word() for _ in range(8))
        # Two layouts of half the pages each, neither of which names its menu.
        if i % 2:
            parts = "<div id=a1><b>Menu one</b></div>", f"<div id=a2><p>{own}</p></div>", "<div id=a3><i>Legal one</i></div>"
        else:
            parts = "<table id=b1><tr><td>Menu two</table>", f"<section id=b2><p>{own}</p></section>", "<ul id=b3><li>Legal two</ul>"
        rows.append((i, "http://two.org/", page_of(word(), *parts)))
        want[i] = own
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in extract(df).collect()} == want


def test_layouts_that_are_found_in_parts(spark, monkeypatch):
    from lodestone.llm import wrappers

    r = random.Random(19)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    rows, want = [], {}
    for i in range(60):
        own = [word() for _ in range(3)]
        # Every page has elements of its own, and pages of a third kind are alone with theirs.
        extra = "".join(f"<u id={word()}>{w}</u>" for w in own)
        parts = (f"<b id=m>Menu</b><b id=n>News</b><b id=o>Other</b><b id=p>People</b><b id=q>Questions</b><b id=r>Rest</b>{extra}", f"<i id={word()}><s>{extra}</s></i>")[i % 10 == 0]
        rows.append((i, "http://parts.org/", page_of(word(), parts)))
        want[i] = "".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(wrappers, "AT_ONCE", 7)
    assert {x.page_id: x.text for x in wrappers.extract(df).collect()} == want


def test_html_of_many_nodes(spark):
    from lodestone.llm.wrappers import extract

    r = random.Random(9)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    rows, want = [], {}
    for i in range(12):
        # Over 400 nodes after runs are joined, and a notice over 60 deep.
        own = [word() for _ in range(2 * (250 + i))]
        body = "".join(f"<h2>{a}</h2><p>{b}</p>" for a, b in zip(own[::2], own[1::2], strict=True))
        parts = "<div id=m><b>Menu</b></div>", f"<div id=t>{body}</div>", "<div>" * 70 + f"<em>{own[0]}</em><b>Legal</b>" + "</div>" * 70
        rows.append((i, "http://long.org/", page_of(word(), *parts)))
        want[i] = "\n".join([*own, own[0]])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in extract(df).collect()} == want


def test_html_as_another_parser_reads_it(spark):
    from lodestone.llm.wrappers import extract

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: brute.Articles(r.html or "").text() for r in pages.collect()}
    assert sum(map(bool, want.values())) > 0.9 * len(want)
    assert {r.page_id: r.text for r in extract(pages).collect()} == want


def test_names_of_parts():
    from lodestone.llm.wrappers import main_text

    story = "<h1>Head</h1><p>One</p><p>Two</p>"
    for around in ('<div class="layout has-sidebar">{}</div>', '<div class="long-form">{}</div>', '<article class="post comments-open">{}</article>', '<div id="search-results-article">{}</div>', '<main class="page-with-nav">{}</main>', '<div class="no-ads"><section id="reader-view">{}</section></div>'):
        assert main_text(around.format(story)) == "Head\nOne\nTwo", around
        assert main_text(around.format(story + '<div class="related-articles">x</div><ul id="comment-list"><li>y</ul><div class="share_buttons">z</div><div class="ad ad-box-2">w</div>')) == "Head\nOne\nTwo", around
    assert main_text('<article><p>a</p><p class="social">b</p><p class="advert">c</p><span class="note">d</span></article>') == "a\nb\nd"
    assert main_text('<div class="siteHeader">a</div><div class="page-header">b</div><div class="site-footer">c</div><div class="content">d</div><div class="cookie-notice">e</div><section id="user-comments"><p>f</section>') == "d"


def test_html_menus_that_vary(spark):
    from lodestone.llm.wrappers import extract

    r = random.Random(18)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(6))
    rows, want = [], {}
    for i in range(30):
        own = " ".join(word() for _ in range(40))
        menu = "".join(f'<i><a href="/{word()}">{word()}</a></i>' for _ in range(r.randrange(2, 6)))
        # Links in an article, before it as a title, and after it as its sources stay; so does an article of nothing but a link.
        text = f'<p>{own} <a href="/x">{word()}</a></p>' if i else f'<p><a href="/y">{own}</a></p>'
        parts = f'<h1><a href="/z">{word()}</a></h1>', text, f"<ul><li>{menu}</li></ul>"
        rows.append((i, "http://links.org/", page_of(word(), f"<div id=u1>{menu}</div><div id=u2>{''.join(parts)}</div>")))
        want[i] = "\n".join(" ".join(re.sub("<[^>]*>", "", t).split()) for t in parts)
    # A site of link lists keeps them.
    for i in range(30, 50):
        own = [word() for _ in range(5)]
        rows.append((i, "http://lists.org/", page_of(word(), "<ul>" + "".join(f'<li><a href="/{w}">{w}</a>' for w in own) + "</ul>")))
        want[i] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in extract(df).collect()} == want


def test_matching_is_the_best_one(monkeypatch):
    from lodestone.llm import wrappers

    r = random.Random(1)

    def tree(depth, label="a"):
        s = wrappers.Skeleton(label, [])
        s.kids = [tree(depth - 1, r.choice("abc")) for _ in range(r.randrange(5))] if depth else []
        return s

    def best(a, b):
        rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                rows[i][j] = max(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1] + best(x, y) if x.label == y.label else 0)
        return rows[-1][-1] + 1

    for held in (1 << 22, 6):
        monkeypatch.setattr(wrappers, "HELD", held, raising=False)
        for _ in range(150):
            a, b = tree(3), tree(3)
            assert wrappers.matching(a, b, {})[0] == best(a, b) == len(list(wrappers.aligned(a, b)))


def test_one_id_on_different_texts(spark):
    from lodestone.llm.simhash import keep_one

    a, b, c, d = (" ".join(random.Random(k).choices(string.ascii_lowercase, k=60)) for k in range(4))
    # 5 stands on two texts that don't link; 7 on one that links to 1 and on one that has no other row.
    df = spark.createDataFrame([(1, a), (5, b), (5, c), (7, a), (7, "quite another text")], "doc_id long, text string")
    assert sorted(keep_one(df).collect()) == sorted([(1, a), (5, b), (5, c), (7, "quite another text")])
    # No text may vanish: every text that no kept row has is a near copy of one.
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, c), (9, c + " zz " + a), (9, d), (9, d)], "doc_id long, text string")
    assert sorted(keep_one(df).collect()) == sorted([(3, a), (5, b), (9, c), (9, c + " zz " + a), (9, d)])
