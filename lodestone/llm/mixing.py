"""Mixing sources to target weights by temperature.

The token share of every source is raised to one exponent between 0 (equal
weights) and 1 (natural shares), and the results are normalised. The exponent
is bisected until the weights have the wanted entropy; if that would repeat a
source more often than allowed, it is bisected to the repetition limit instead,
which is always kept where the budget allows it at all.

A source's documents are dealt by hash to blocks of about ``budget / blocks``
tokens. Each pass over a source takes its blocks in a permutation of their own;
a source gets as many whole passes as its share of the budget pays for, and of
one more pass the blocks that lie more than half within what is left. So every
source ends within one block of its weight, and a document's number of copies
follows from one row a source, made from sums that are taken in every task
first. Texts never move unless there are over ``BROADCAST_ROWS`` sources.

Rows: null and empty texts count no tokens, but go where their block goes;
rows without a source are a source; a source without any token has no weight
and is not drawn; equal rows fall in one block and are drawn alike; a row
without an id goes by its text; an empty table gives an empty result; columns
that clash with the added ones are replaced in ``mixture`` and kept in ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import durable

#: The wanted entropy, as a share of what equal weights have; the most passes over a source; blocks in a budget.
ENTROPY, REPEATS, BLOCKS, SEED = 0.95, 4.0, 4096, 0
#: Parts that one round of the bisection cuts an interval into, and rounds.
PARTS, ROUNDS = 32, 8
BROADCAST_ROWS = 200_000
#: Leading bits of the hash that orders a pass, by which its blocks are summed.
PART_BITS = 10


def words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def exponent(totals: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> tuple[float, float]:
    """(exponent, normaliser) for ``totals`` (key, tokens > 0), one aggregation of sources a round."""
    all_ = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("tokens").alias("least")).first()
    if not all_["n"]:
        return 1.0, 1.0
    total, least = float(all_["t"]), float(all_["least"]) / float(all_["t"])
    p = F.col("tokens") / F.lit(total)
    wanted = entropy * math.log(all_["n"])

    def measured(at: list[float]) -> list[tuple[float, float, float]]:
        """(normaliser, entropy, most passes over a source) of each exponent."""
        sums = totals.agg(*(f for k, a in enumerate(at) for f in (F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}")))).first()
        out = []
        for k, a in enumerate(at):
            z, s = sums[f"z{k}"], sums[f"l{k}"]
            out.append((z, math.log(z) - a * s / z, budget / total * least ** (a - 1) / z))
        return out

    def bisected(good) -> float:
        """The border of ``good``, which holds from some exponent on."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            at = [low + (high - low) * k / PARTS for k in range(1, PARTS)]
            first = next((k for k, m in enumerate(measured(at)) if good(m)), PARTS - 1)
            low, high = ([low, *at])[first], ([*at, high])[first]
        return high

    ends = measured([0.0, 1.0])
    # Entropy falls, and so do the passes over the smallest source, as the exponent grows.
    a = 0.0 if ends[0][1] <= wanted else 1.0 if ends[1][1] >= wanted else bisected(lambda m: m[1] <= wanted)
    if measured([a])[0][2] > repeats:
        a = 1.0 if ends[1][2] > repeats else max(a, bisected(lambda m: m[2] <= repeats))
    return a, measured([a])[0][0]


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with _k (source key) and _h (the hash that deals rows to blocks)."""
    return docs.withColumns({"_k": key_of(F.col(source_col)), "_h": F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))})


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """``docs`` with _k, _tokens, _block, _weight and _copies: how often each row is drawn."""
    own = placed(docs, id_col, text_col, source_col, seed)
    counted = durable(own.select("_k", "_h", words(F.col(text_col)).alias("n")))
    totals = durable(counted.groupBy("_k").agg(F.sum("n").alias("tokens")).where("tokens > 0"))
    found = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = int(found["t"] or 0)
    budget = total if budget is None else int(budget)
    a, z = exponent(totals, budget, entropy, repeats)
    unit = max(1.0, budget / blocks)
    weight = F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(a)) / F.lit(z)
    sources = totals.withColumn("_weight", weight).withColumn("_n", F.greatest(F.lit(1.0), F.ceil(F.col("tokens") / F.lit(unit))).cast("long"))
    sources = sources.withColumn("share", F.col("_weight") * F.lit(float(budget)))
    sources = sources.withColumn("whole", F.floor(F.col("share") / F.col("tokens"))).withColumn("left", F.col("share") - F.col("whole") * F.col("tokens"))
    sources = durable(sources)
    at = lambda df: df.withColumn("_block", F.pmod(F.col("_h"), F.col("_n")))
    table = at(counted.join(small(sources, found["n"]), "_k")).groupBy("_k", "_block").agg(F.sum("n").alias("b"), F.first("whole").alias("whole"), F.first("left").alias("left"))
    # The permutation of a pass is the order of a hash. Sums by its leading bits tell where each part of a source begins, so that no task orders all blocks of a source.
    turn = F.xxhash64(F.lit(seed), F.col("whole"), F.col("_k"), F.col("_block"))
    table = durable(table.withColumn("turn", turn).withColumn("part", F.shiftright("turn", 64 - PART_BITS)))
    before = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("_k", "part").agg(F.sum("b").alias("own")).withColumn("base", F.coalesce(F.sum("own").over(before(["_k"], ["part"])), F.lit(0)))
    inner = F.coalesce(F.sum("b").over(before(["_k", "part"], ["turn", "_block"])), F.lit(0))
    drawn_more = table.join(parts.select("_k", "part", "base"), ["_k", "part"]).withColumn("inner", inner).where(F.col("base") + F.col("inner") + F.col("b") / 2 < F.col("left"))
    # The blocks of the last, partial pass are those up to one place in its order: one row a source says which.
    last = drawn_more.groupBy("_k").agg(F.max(F.struct("turn", "_block")).alias("last"))
    number = durable(sources.join(last, "_k", "left").select("_k", "_n", "_weight", "whole", "last"))
    out = at(own.join(small(number, found["n"]), "_k", "left"))
    place = F.struct(turn.alias("turn"), F.col("_block"))
    out = out.withColumn("_copies", (F.col("whole") + F.when(place <= F.col("last"), 1).otherwise(0)).cast("long")).drop("whole", "last")
    return out.withColumns({"_tokens": words(F.col(text_col)), "_copies": F.coalesce("_copies", F.lit(0).cast("long")), "_weight": F.coalesce("_weight", F.lit(0.0))})


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, copies: one row for each row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    got = drawn(slim, "doc_id", "text", "source", **options)
    return got.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_block").alias("block"), F.col("_copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is drawn, with its own columns."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    bare = docs.toDF(*inner.values())
    got = drawn(bare, inner[id_col], inner[text_col], inner[source_col], **options).where("_copies > 0")
    again = got.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return again.select(*(F.col(n).alias(c) for c, n in inner.items()))
