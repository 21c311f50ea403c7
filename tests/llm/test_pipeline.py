"""The stages one after another against plain Python, and the registry."""

import public_tokenizers
import sentencepiece

import brute
from lodestone.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11)) and ORACLES.keys() < QUERIES.keys()


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from lodestone.llm.langid import identify
    from lodestone.llm.mixing import mixture
    from lodestone.llm.quality import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append((name, before, docs))
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, before, after in kept:
        if name == "language_id":
            assert ids(after) == ids(identify(before).where("lang_pred <> 'und' and score >= 0.5"))
        elif name == "quality_rules":
            assert ids(after) == ids(quality(before).where("kept"))
        elif name == "near_dedup":
            groups = brute.near_copies([(r.doc_id, r.text) for r in before.collect()])
            assert ids(after) == sorted(i for i, c in groups.items() if i == c)
        elif name == "source_mixing":
            assert ids(after) == sorted(r.doc_id for r in mixture(before).collect() for _ in range(r.copies))
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in after.collect():
                assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded_sha256 == brute.sha(library.decode(r.ids))
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_awkward_tables(spark, tmp_path):
    """Nulls, repeated ids with equal and with different texts, very long texts, further columns, and no rows at all."""
    import os

    import corpus_pipeline

    good = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 1000 and 4000").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x") for r in good]
    a, b = good[0].text, good[1].text
    rows += [(None, None, None, None, None, None), (7000, "", "en", "s", 0, "x"), (7001, " \t", None, None, None, "y"), (None, a, "en", None, 1, "z"), (None, good[2].text + " tail", "en", "s", 1, "z")]
    rows += [(7100, a, "en", "s", 1, "x"), (7100, b + " " + a, "en", "s", 1, "x"), (7101, b, "en", "s", 1, "x"), (7101, b, "en", "s", 1, "x"), (7102, " ".join(g.text for g in good) * 12, "en", "s", 1, "x")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _tokens string"
    place = tmp_path / "some"
    spark.createDataFrame(rows, kinds).write.parquet(f"{place}/documents.parquet")
    got = corpus_pipeline.run(spark, str(place)).collect()
    assert {r.doc_id for r in got} >= {r.doc_id for r in good[:2]} and 7000 not in {r.doc_id for r in got}
    assert all(r.n_tokens == len(r.ids) > 0 for r in got)
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    # Only what the last stages have kept is left of the pipelines' tables.
    from lodestone.llm.common import shared_folder

    left = [d for d in os.listdir(shared_folder(spark)) if d.startswith(("pipeline-", "quality-"))]
    assert left and all(os.listdir(f"{shared_folder(spark)}/{d}") == ["sentencepiece"] for d in left if d.startswith("pipeline-")) and not any(d.startswith("quality-") for d in left)


def test_few_texts_at_a_time(spark):
    """Every stage bounds what its readers and workers hold at a time, and leaves bounds that are smaller."""
    import corpus_pipeline
    from lodestone.llm.common import LEAN, ship

    docs = ship(spark).read.parquet(f"{SF}/documents.parquet").limit(20)
    before = {k: spark.conf.get(k) for k in LEAN}
    try:
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            for k in LEAN:
                spark.conf.set(k, "100" if n == 1 else "100000000")
            stage(spark, docs, SF)
            assert {k: spark.conf.get(k) for k in LEAN} == {k: "100" if n == 1 else str(v) for k, v in LEAN.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fewer_units_remembered():
    """A small cache gives the library's ids still, and holds no more than two generations."""
    from lodestone.llm.pieces import Pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        pieces = Pieces(f.read(), cache=50)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [[" ".join(f"w{a}x{b}" for b in range(40)), f"again a{a} \n é{a}"] for a in range(12)]
    for part in texts + texts[-2:]:
        assert [x.tolist() for x in pieces.encode_batch(part)] == library.encode(part)
        assert len(pieces.number) <= 50 + 60 and len(pieces.old[0]) <= 50 + 60
