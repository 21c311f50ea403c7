"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces,
found by a forward recursion; a text scores the product over its words, and
the posterior of equal priors decides. The piece probabilities are fitted by
expectation maximisation on the words of a bounded sample of the labelled
texts: ``sample`` texts a language, those of least id hash (of rows with one id
and language the least text), and of their different words the ``most``
commonest of a language. Words of any length are fitted and scored; those of
over ``SHORT`` letters one by one, rescaled as they go.

Rows: a text that is null or has no letter is ``und`` with score 0, and so is
every text when nothing is labelled; texts are taken whole, whatever their
length; of equal posteriors the first language by name wins; repeated rows give
repeated results; an empty table gives an empty result; other columns don't
matter.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, give_back, only_model, ship, tokenizer_bytes
from lodestone.llm.merging import PairTable
from lodestone.llm.pieces import SPACE, Pieces, batches_of

SAMPLE, ROUNDS, MOST_WORDS = 300, 4, 200_000
#: Words of up to so many characters are scored in arrays, longer ones alone.
SHORT, FLOOR, CACHE_WORDS, LONGEST = 28, 1e-8, 150_000, 16
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case; none if no letter is among them."""
    found = WORD.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


class PieceModel:
    """Piece probabilities (a row a piece, a column a language) and the forward recursion."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.pieces, self.prob = langs, pieces, np.ascontiguousarray(prob)
        chars = sorted(set().union(*pieces)) if pieces else []
        self.of_char = np.full(0x110000, len(chars) + 1, dtype=np.int64)
        self.of_char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        # A trie as a table: node and character to node; nodes that end a piece know its row.
        nodes: dict[tuple[int, int], int] = {}
        self.row = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                key = (at, int(self.of_char[ord(c)]))
                if key not in nodes:
                    nodes[key] = len(self.row)
                    self.row.append(-1)
                at = nodes[key]
            self.row[at] = i
        self.nodes = nodes
        self.row = np.array(self.row, dtype=np.int64)
        base = len(chars) + 2
        keys = np.array([a * base + c for a, c in nodes], dtype=np.int64)
        to = np.array(list(nodes.values()), dtype=np.int64)
        self.table = PairTable(base, keys, np.arange(keys.size), to)
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(langs)))

    def spans(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, words, piece rows): where pieces stand in words of one length."""
        n = codes.shape[1]
        for i in range(n):
            own, at = np.arange(codes.shape[0]), np.zeros(codes.shape[0], dtype=np.int64)
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                slot = self.table.find(at, codes[own, j - 1])
                hit = self.table.rank[slot] < (1 << 39)
                own, at = own[hit], self.table.made[slot[hit]]
                if not own.size:
                    break
                row = self.row[at]
                ends = row >= 0
                if ends.any():
                    yield i, j, own[ends], row[ends]

    def forward(self, codes: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, list]:
        """Sums over all segmentations of every prefix, and the spans behind them."""
        u, n = codes.shape
        alpha = np.zeros((n + 1, u, prob.shape[1]))
        alpha[0] = 1
        found: list = [[] for _ in range(n)]
        for i, j, own, row in self.spans(codes):
            found[i].append((j, own, row))
        for i in range(n):
            for j, own, row in found[i]:
                alpha[j][own] += alpha[i][own] * prob[row]
            alpha[i + 1] += alpha[i] * FLOOR
        return alpha, found

    def long_score(self, word: str) -> np.ndarray:
        """The log probability of one long word, rescaled as it goes."""
        codes = self.of_char[[ord(c) for c in SPACE + word]].tolist()
        n = len(codes)
        window = {0: np.ones(len(self.langs))}
        total = np.zeros(len(self.langs))
        for i in range(n):
            here = window.pop(i)
            top = np.maximum(here, 1e-300)
            total += np.log(top)
            window = {j: v / top for j, v in window.items()}
            here = here / top
            at = 0
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                at = self.nodes.get((at, codes[j - 1]))
                if at is None:
                    break
                if self.row[at] >= 0:
                    window[j] = window.get(j, 0) + here * self.prob[self.row[at]]
            window[i + 1] = window.get(i + 1, 0) + here * FLOOR
        return total + np.log(np.maximum(window[n], 1e-300))

    def long_spans(self, word: str) -> list[list[tuple[int, int]]]:
        """(end, piece row) of the pieces that stand at each place of one long word."""
        codes = self.of_char[[ord(c) for c in SPACE + word]].tolist()
        out: list[list[tuple[int, int]]] = []
        for i in range(len(codes)):
            at, here = 0, []
            for j in range(i + 1, min(len(codes), i + LONGEST) + 1):
                at = self.nodes.get((at, codes[j - 1]))
                if at is None:
                    break
                if self.row[at] >= 0:
                    here.append((j, int(self.row[at])))
            out.append(here)
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self.long_score(w)
            else:
                by.setdefault(len(w), []).append(i)
        for n, own in by.items():
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                flat = np.frombuffer("".join(SPACE + words[i] for i in part).encode("utf-32-le"), np.uint32)
                alpha, _ = self.forward(self.of_char[flat].reshape(len(part), n + 1), self.prob)
                out[part] = np.log(alpha[-1])
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        cut = [words_of(t) for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        new = list(set().union(*cut).difference(self.index)) if cut else []
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index.clear()
            new = list(set().union(*cut))
        if new:
            a, b = len(self.index), len(self.index) + len(new)
            if b > len(self.scores):
                grown = np.zeros((2 * b, len(self.langs)))
                grown[:a] = self.scores[:a]
                self.scores = grown
            self.scores[a:b] = self.word_scores(new)
            self.index.update(zip(new, range(a, b), strict=True))
        out = []
        get = self.index.__getitem__
        for words in cut:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            s = self.scores[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
            best = int(s.argmax())
            out.append((self.langs[best], float(1 / np.exp(s - s[best]).sum())))
        return out


def long_uses(spans: list[list[tuple[int, int]]], p: np.ndarray) -> dict[int, float]:
    """How often each piece is expected in one word, over all its segmentations by their probabilities.

    Forward sums are divided by themselves at every place, so that neither they nor the backward sums leave the range of doubles.
    """
    n = len(spans)
    window, scale = {0: 1.0}, [1.0] * (n + 1)
    for i in range(n + 1):
        scale[i] = here = window.pop(i)
        window = {j: v / here for j, v in window.items()}
        if i < n:
            for j, row in spans[i]:
                window[j] = window.get(j, 0.0) + float(p[row])
            window[i + 1] = window.get(i + 1, 0.0) + FLOOR
    back, uses = [0.0] * n + [1.0], {}
    for i in range(n - 1, -1, -1):
        total, passed, at = FLOOR * back[i + 1] / scale[i + 1], 1.0, i
        for j, row in spans[i]:
            while at < j:
                at += 1
                passed *= scale[at]
            share = float(p[row]) * back[j] / passed
            uses[row] = uses.get(row, 0.0) + share
            total += share
        back[i] = total
    return uses


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = ROUNDS) -> PieceModel:
    """Piece probabilities of each language by expectation maximisation over its words' counts."""
    langs = sorted(counts)
    pieces = [p for p in vocabulary if p == p.lower() and all(c.isalpha() for c in p.lstrip(SPACE)) and p.count(SPACE) == p.startswith(SPACE)]
    model = PieceModel(langs, pieces, np.zeros((len(pieces), 0)))
    prob = np.zeros((len(pieces), len(langs)))
    for k, lang in enumerate(langs):
        groups = []
        by: dict[int, list[tuple[str, int]]] = {}
        long: list[tuple[list[list[tuple[int, int]]], int]] = []
        for w, c in sorted(counts[lang].items()):
            if len(w) <= SHORT:
                by.setdefault(len(w), []).append((w, c))
            else:
                long.append((model.long_spans(w), c))
        for n, own in by.items():
            flat = np.frombuffer("".join(SPACE + w for w, _ in own).encode("utf-32-le"), np.uint32)
            codes = model.of_char[flat].reshape(len(own), n + 1)
            found: list = [[] for _ in range(n + 1)]
            for i, j, who, row in model.spans(codes):
                found[i].append((j, who, row))
            groups.append((len(own), n + 1, found, np.array([c for _, c in own], dtype=np.float64)))
        p = np.zeros(len(pieces))
        for _, _, found, weight in groups:  # at first, as often as a piece occurs at all
            for own in found:
                for _, who, row in own:
                    p += np.bincount(row, weight[who], len(pieces))
        for spans, c in long:
            np.add.at(p, [row for here in spans for _, row in here], c)
        p /= max(p.sum(), 1)
        for _ in range(rounds):
            seen = np.zeros(len(pieces))
            for u, n, found, weight in groups:
                alpha, beta = np.zeros((n + 1, u)), np.zeros((n + 1, u))
                alpha[0] = beta[n] = 1
                for i in range(n):
                    for j, who, row in found[i]:
                        alpha[j][who] += alpha[i][who] * p[row]
                    alpha[i + 1] += alpha[i] * FLOOR
                for i in range(n - 1, -1, -1):
                    beta[i] += beta[i + 1] * FLOOR
                    for j, who, row in found[i]:
                        beta[i][who] += beta[j][who] * p[row]
                share = weight / alpha[n]
                for i in range(n):
                    for j, who, row in found[i]:
                        seen += np.bincount(row, share[who] * alpha[i][who] * p[row] * beta[j][who], len(pieces))
            for spans, c in long:
                uses = long_uses(spans, p)
                seen[list(uses)] += c * np.fromiter(uses.values(), np.float64, len(uses))
            p = seen / max(seen.sum(), 1e-300)
        prob[:, k] = p
    shared = prob.mean(axis=1, keepdims=True) if langs else prob
    prob = 0.95 * prob + 0.05 * shared
    own = np.flatnonzero(prob.any(axis=1)) if langs else np.zeros(0, dtype=int)
    return PieceModel(langs, [pieces[i] for i in own], prob[own])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = MOST_WORDS, tokenizer_path: str | None = None) -> tuple:
    """A fitted model as plain data, from ``sample`` texts a language of the rows of ``docs`` with a language and a text."""
    from pyspark.sql import Window

    spark = ship(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("l is not null and t is not null and i is not null")
    hashed = named.select("i", "l", F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 40)).alias("h"))
    # A cut on the hash leaves about half as many again as are wanted, so that no task ranks many rows of a language.
    sizes = durable(hashed.groupBy("l").agg(F.approx_count_distinct("i").alias("n")))
    langs = sizes.count()
    near = F.col("h") < F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n")) * F.lit(float(1 << 40))
    ids = hashed.join(F.broadcast(sizes) if langs <= 100_000 else sizes, "l").where(near).select("l", "i", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))
    chosen = durable(ids.withColumn("r", rank).where(F.col("r") <= sample).select("i", "l"))
    picked = named.join(F.broadcast(chosen) if langs * sample <= 1_000_000 else chosen, ["i", "l"], "left_semi").groupBy("i", "l").agg(F.min("t").alias("t")).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column("l").to_pylist(), batch.column("t"), strict=True):
                seen.update((lang, w) for w in words_of(text.as_py()))
            yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["l", "w", "n"])

    words = picked.mapInArrow(count, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n"))
    common = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))
    found = words.withColumn("r", common).where(F.col("r") <= most).select("l", "w", "n").toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, w, n in zip(found["l"].to_pylist(), found["w"].to_pylist(), found["n"].to_pylist(), strict=True):
        counts.setdefault(lang, {})[w] = n
    vocabulary = sorted(Pieces(tokenizer_bytes("piece_bpe_32k.model", tokenizer_path), check=False).known)
    model = fit(counts, vocabulary)
    return model.langs, model.pieces, model.prob


def language(text: Column, model: tuple, spark) -> Column:
    """A struct (lang_pred, score) for each text."""
    data = ship(spark).sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = only_model("langid", data.value, lambda: PieceModel(*pickle.loads(data.value)))
        for batch in batches:
            got = [p for part in batches_of(batch) for p in held.predict(part)]
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])
        give_back()

    return predict(text)


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, parts: int = 4, held: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``; learned from the rows that aren't held out."""
    model = learn(docs.where(fold(id_col, parts) != held), id_col, text_col, lang_col, sample, tokenizer_path=tokenizer_path)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col, parts) == held, F.lit(False)).alias("held_out"), language(F.col(text_col), model, docs.sparkSession).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language with a posterior of ``least`` or more; their own columns."""
    parts, held = options.pop("parts", 4), options.pop("held", 2)
    model = learn(docs.where(fold(id_col, parts) != held), id_col, text_col, lang_col, **options)
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    got = docs.toDF(*inner.values()).withColumn("_p", language(F.col(inner[text_col]), model, docs.sparkSession))
    return got.where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= least)).select(*(F.col(n).alias(c) for c, n in inner.items()))
