"""Connected components by alternating large and small stars.

Each round hangs every node's larger neighbours on the least node known near
it, then its smaller ones; the rounds end when all edges are stars, after a number
that grows with the logarithm of the longest chain. A hub's edges meet only in
a minimum, which is pre-aggregated, and in a join whose other side has one row
a node, which adaptive execution may split. Every round's edges are written to
the shared checkpoint folder, so that a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable


def settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v < u) are stars: every u hangs on one v, and no v hangs on another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not each.where("hangs > 1 or (hangs = 1 and holds = 1)").limit(1).count()


def connected(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component: the least node reachable, for every node that has an edge to another.

    Rows with a null end and loops are left out; repeated edges count once; no
    edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = durable(e)
    for _ in range(rounds):
        if settled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = durable(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def joined_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, share: int = 1000) -> DataFrame:
    """``rows`` (``total`` in all) joined to ``keyed`` (one row a key, with n: the rows that have it), whatever the number of rows of a key.

    A key of over a thousandth of all rows goes to a table of at most a thousand rows, which is broadcast; so no task gets all rows of such a key.
    """
    frequent = F.broadcast(keyed.where(F.col("n") * share > total))
    rare = keyed.where(F.col("n") * share <= total)
    return rows.join(frequent, keys).unionByName(rows.join(frequent.select(*keys), keys, "left_anti").join(rare, keys))


def one_of_each(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame, mark: Callable[[Column], Column], few_ids: int) -> DataFrame:
    """The row of least id of each group (of equal ids, that of least mark); rows without an id as their marks are free.

    ``groups``: doc_id, mark, comp for each row. Only rows with repeated ids or none are marked again;
    of all others none moves while at most ``few_ids`` go.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    bare, own, text = docs.toDF(*inner.values()), inner[id_col], F.col(inner[text_col])
    few = lambda df: F.broadcast(df) if df.count() <= few_ids else df
    named = groups.where("doc_id is not null")
    best = named.groupBy("comp").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*", F.lit(True).alias("stays"))
    rows = durable(named.groupBy("doc_id", "mark").count().join(best, ["doc_id", "mark"], "left"))
    ids = rows.groupBy("doc_id").agg(F.sum("count").alias("n"), F.max(F.coalesce("stays", F.lit(False))).alias("stays"))
    gone = durable(ids.where("n > 1 or not stays").select(F.col("doc_id").alias(own), "stays"))
    kept = bare.where(F.col(own).isNotNull()).join(few(gone.select(own)), own, "left_anti")
    out = kept.select(*inner.values())
    repeated = gone.where("stays").select(own)
    if repeated.limit(1).count():
        again = bare.join(few(repeated), own, "left_semi").withColumn("_mark", mark(text))
        staying = rows.where("stays").select(F.col("doc_id").alias(own), F.col("mark").alias("_mark"))
        again = again.join(few(staying.join(repeated, own, "left_semi")), [own, "_mark"], "left_semi").dropDuplicates([own, "_mark"])
        out = out.unionByName(again.select(*inner.values()))
    if groups.where("doc_id is null").limit(1).count():
        free = bare.where(F.col(own).isNull()).withColumn("_mark", mark(text))
        free = free.join(named.select(F.col("mark").alias("_mark")).distinct(), "_mark", "left_anti")
        out = out.unionByName(free.dropDuplicates(["_mark"]).select(*inner.values()))
    return out.select(*(F.col(n).alias(c) for c, n in inner.items()))
