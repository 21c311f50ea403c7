"""Quality rules by weak supervision, in DataFrame functions only.

Rules look at counts of a text and each votes for good (1), for bad (-1) or
abstains (0). Nobody tells which rule is right: expectation maximisation over
the table of vote patterns (at most three to the power of the rules, whatever
the corpus holds) estimates how often each rule is right about good and about
bad texts, and the share of good ones. A text is kept if the posterior
probability that it is good is at least ``threshold``, and if it passes the
base limits on length and repetition.

Rows: null and empty texts have no words and fail the base limits; texts are
taken whole, whatever their length; a null id stays null; repeated rows count
as often as they stand there and give repeated results; an empty table gives
an empty result; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, durable, written

SYMBOLS = "#*$%&|<>"
ROUNDS, THRESHOLD = 50, 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_symbol_runs"]
#: The chance of each vote given a good and a bad text, before any is seen.
BELIEVED = {1: (0.9, 0.6), 0: (0.08, 0.1), -1: (0.02, 0.3)}
RULES = ["symbols", "symbol_runs", "shouting", "repeats", "duplicate_lines", "word_length", "letters", "marks", "length"]


def without(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_m`` of MEASURES; no row meets another."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.withColumn("_t", raw)
    t, none = F.col("_t"), F.array().cast("array<string>")
    bare = F.btrim(t, F.lit(SPACES))
    step = step.withColumn("_w", F.when(bare == "", none).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    w, n = F.col("_w"), F.size("_w")
    joined = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    step = step.withColumn("_g", F.when(n >= 3, joined).otherwise(none))
    g = F.col("_g")
    # Windows in order, so that equal ones are neighbours; only for texts that repeat any.
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    placed = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))
    step = step.withColumn("_s", F.when(repeats, F.sort_array(placed)))
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (x.g == F.get(s, i - 1).g) | (x.g == F.get(s, i + 1).g))
    places = F.sort_array(F.transform(twice, lambda x: x.p))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a.total + F.least(F.lit(3), p - a.last)).alias("total")), lambda a: a.total)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = step.withColumn("_l", lines)
    values = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": without(t, SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.when(s.isNull(), F.lit(0)).otherwise(covered),
        "n_lines": F.size("_l"),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "n_letters": F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", "")),
        "n_marks": without(t, "!?"),
        "n_symbol_runs": F.regexp_count(t, F.lit(r"[#*$%&|<>]+")),
    }
    # A partition's number keeps the optimiser from copying these expressions to every place that reads a measure.
    m = F.struct(*(v.cast("long").alias(k) for k, v in values.items()), F.spark_partition_id().alias("part"))
    return step.withColumn("_m", m).drop("_t", "_w", "_g", "_s", "_l")


def vote(value: Column, good: float, bad: float) -> Column:
    """1 up to ``good``, -1 from ``bad``, which is larger; 0 between, and where there is no value."""
    return F.when(value <= good, F.lit(1)).when(value >= bad, F.lit(-1)).otherwise(F.lit(0))


def votes(m: str = "_m") -> dict[str, Column]:
    """The vote of each rule on a struct of MEASURES."""
    c = {k: F.col(f"{m}.{k}").cast("double") for k in MEASURES}
    per = lambda a, b: F.when(c[b] > 0, c[a] / c[b])
    length = per("word_chars", "n_words")
    return {
        "symbols": vote(per("n_symbols", "n_words"), 0.05, 0.2),
        "symbol_runs": vote(per("n_symbol_runs", "n_words"), 0.03, 0.1),
        "shouting": vote(per("n_upper", "n_letters"), 0.2, 0.5),
        "repeats": vote(per("n_repeat_words", "n_words"), 0.2, 0.4),
        "duplicate_lines": vote(per("n_dup_lines", "n_lines"), 0.2, 0.5),
        "word_length": F.when(length.between(3, 11), 1).when((length < 2) | (length > 20), -1).otherwise(0),
        "letters": vote(1 - per("n_letters", "word_chars"), 0.1, 0.2),
        "marks": vote(per("n_marks", "n_words"), 0.1, 0.5),
        "length": F.when(c["n_words"] >= 50, 1).when(c["n_words"] < 5, -1).otherwise(0),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """The share of good texts, and for each rule the chance of each vote given a good and a bad text.

    ``patterns``: the votes of all rules, and how many texts have just these.
    """
    n = len(RULES)
    share = 0.9
    chance = [dict(BELIEVED) for _ in range(n)]
    total = sum(c for _, c in patterns)
    if not total:
        return share, chance
    for _ in range(rounds):
        good_sum = 0.0
        # A little of what was believed before stands for unseen votes.
        seen = [{v: [10 * x for x in both] for v, both in BELIEVED.items()} for _ in range(n)]
        for pattern, count in patterns:
            odds = math.log(share) - math.log(1 - share) + sum(math.log(chance[k][v][0]) - math.log(chance[k][v][1]) for k, v in enumerate(pattern))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good_sum += p * count
            for k, v in enumerate(pattern):
                seen[k][v][0] += p * count
                seen[k][v][1] += (1 - p) * count
        share = min(max(good_sum / total, 1e-6), 1 - 1e-6)
        chance = []
        for k in range(n):
            sums = [sum(seen[k][v][g] for v in (-1, 0, 1)) for g in (0, 1)]
            chance.append({v: (seen[k][v][0] / sums[0], seen[k][v][1] / sums[1]) for v in (-1, 0, 1)})
    return share, chance


def pattern_counts(voted: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """How many rows have each pattern of votes (a column a rule); counted in every task first, and no more rows than patterns."""
    rows = voted.groupBy(*RULES).count().collect()
    return sorted((tuple(int(r[k]) for k in RULES), r["count"]) for r in rows)


def posterior(model: tuple) -> Column:
    """The probability that a text is good, from a column of votes a rule."""
    share, chance = model
    odds = F.lit(math.log(share) - math.log(1 - share))
    for k, r in enumerate(RULES):
        weight = {x: math.log(chance[k][x][0]) - math.log(chance[k][x][1]) for x in (-1, 0, 1)}
        odds = odds + F.when(F.col(r) == 1, weight[1]).when(F.col(r) == -1, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("_m.n_words") < 50) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the measures, base_failed, posterior, kept: one row for each row of ``docs``."""
    m = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    m = durable(m.select("doc_id", "_m", *(v.alias(k) for k, v in votes().items())))
    p = posterior(estimate(pattern_counts(m)))
    out = m.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", base_failed().alias("base_failed"), p.alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Texts are measured once: rows wait in the shared folder with their votes."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    bare = docs.toDF(*inner.values())
    m = measured(bare, inner[text_col])
    m = written(m.select(*inner.values(), base_failed().alias("_failed"), *(v.alias(k) for k, v in votes().items())), "quality")
    p = posterior(estimate(pattern_counts(m)))
    return m.where(~F.col("_failed") & (p >= threshold)).select(*(F.col(n).alias(c) for c, n in inner.items()))
