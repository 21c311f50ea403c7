"""Documents from files, and results to files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import IllegalArgument
from lodestone.schema import FieldSpec, IndexSchema

KINDS = ("TERM", "AND", "OR", "PHRASE")


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.LongType | T.IntegerType)


def read_json_lines(spark: SparkSession, paths: str | list[str], keywords: Iterable[str] = (), doc_values: dict[str, FieldSpec] | None = None) -> tuple[DataFrame, IndexSchema]:
    """Documents of JSON Lines files, and the schema that suits them.

    Strings become stored text, or exact terms where ``keywords`` names the
    field; whole and other numbers are stored; booleans become the exact terms
    "true" and "false"; arrays are repeated values; nulls and objects are left
    out, and so are blank lines. ``doc_values`` overrides a field's spec, as to
    sort by a number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.option("mode", "FAILFAST").json(paths)
    return shape_json(df, keywords, doc_values)


def shape_json(df: DataFrame, keywords: Iterable[str] = (), doc_values: dict[str, FieldSpec] | None = None) -> tuple[DataFrame, IndexSchema]:
    """Columns that JSON came with, as fields."""
    keywords, fields, columns = set(keywords), {}, []
    for c in df.schema:
        kind = c.dataType
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        value = F.col(f"`{c.name}`")
        if isinstance(inner, T.BooleanType):
            fields[c.name] = FieldSpec.string(True)
            text = F.transform(value, lambda v: v.cast("string")) if inner is not kind else value.cast("string")
            columns.append(text.alias(c.name))
        elif isinstance(inner, T.StringType):
            fields[c.name] = FieldSpec.string(True) if c.name in keywords else FieldSpec.text(True)
            columns.append(value)
        elif _whole(inner) or isinstance(inner, T.DoubleType):
            fields[c.name] = FieldSpec.stored_only()
            columns.append(value)
    fields.update(doc_values or {})
    return df.select(*columns), IndexSchema(fields)


def read_lines(spark: SparkSession, paths: str | list[str], field: str = "body") -> tuple[DataFrame, IndexSchema]:
    """A document for each line of text files."""
    return spark.read.text(paths).withColumnRenamed("value", field), IndexSchema({field: FieldSpec.text()})


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, kind, terms of a file of queries: TERM, AND, OR or PHRASE, a tab, and terms between blanks."""
    df = spark.read.schema("kind string, terms string").option("sep", "\t").option("quote", "").csv(path)
    bad = df.where(~F.col("kind").isin(*KINDS) | F.col("terms").isNull()).first()
    if bad is not None:
        raise IllegalArgument(f"not a query: {bad['kind']}\t{bad['terms']}")
    return df.select(F.monotonically_increasing_id().alias("qid"), "kind", F.split(F.trim("terms"), r"\s+").alias("terms"))


def hits_json(hits: DataFrame, stored: list[str]) -> DataFrame:
    """value: a JSON object (doc, score, fields) for each hit; fields without a value are left out."""
    fields: Column = F.struct(*(F.col(f"`{c}`") for c in stored)) if stored else F.struct(F.lit(None).cast("string").alias("_"))
    return hits.select(F.to_json(F.struct("doc", "score", fields.alias("fields"))).alias("value"))


def write_hits(hits: DataFrame, stored: list[str], path: str) -> None:
    """Hits as JSON Lines."""
    hits_json(hits, stored).write.mode("overwrite").text(path)


def write_dump(results: DataFrame, path: str) -> None:
    """Results of many queries (kind, terms, total, relation, hits) as tab-separated text: hits are ``doc:score``."""
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h.doc.cast("string"), h.score.cast("string"))), " ")
    results.select("kind", F.array_join("terms", " ").alias("terms"), "total", "relation", hits.alias("hits")).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def first_bad_line(path: str) -> str | None:
    """``file:line`` and what is wrong there, of a local JSON Lines file; None if nothing is."""
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if line.strip():
                try:
                    if not isinstance(json.loads(line), dict):
                        return f"{path}:{n}: not an object"
                except ValueError as e:
                    return f"{path}:{n}: {e}"
    return None
