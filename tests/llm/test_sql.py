"""Queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from lodestone.llm.queries import ORACLES, QUERIES

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in found), key=repr)


def compare(spark, name, place, tables):
    con = duckdb.connect()
    for t in tables:
        where = f"{place}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where + '/*.parquet' if os.path.isdir(where) else where}')")
    df = QUERIES[name](spark, place)
    want = con.execute(ORACLES[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", list(ORACLES))
def test_whole_tables(spark, name):
    compare(spark, name, SF, ["documents", "embeddings", "conversations"])


def test_awkward_tables(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "a b c a b c a b c", "x\ny\nx\n\nx", "# $ %% !!! ??? SHOUT", "word " * 60, "ça été ÀÉ 123 " * 20, "[INST] \\ [\\INST] </s><<SYS>>", "<s>" * 3, "é" * 40]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(i % 3, i, ["user", "assistant", "system", "tool<s>", None][i % 5], t) for i, t in enumerate(texts * 2)] + [(1, None, "assistant", "first"), (1, 3, "assistant", "b"), (1, 3, "assistant", "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    nan = float("nan")
    vectors = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.2], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, None, 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], 1), (11, [], 1), (12, [-1.0, 0.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ORACLES:
        compare(spark, name, str(tmp_path), ["documents", "embeddings", "conversations"])
