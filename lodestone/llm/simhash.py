"""SimHash fingerprints, and their links by bit-sliced comparison.

A fingerprint bit is 1 where over half of the hashes of a text's word shingles
have it. Equal fingerprints are one node. Of 64 bits in four quarters, two
fingerprints within two bits agree on two quarters at least, so each distinct
fingerprint is dealt to six keys of 32 bits. The fingerprints of a key are
compared vertically: bit planes, which are made once, hold one bit of many
fingerprints a word; planes meet themselves moved by 1, 2, 3 ... places,
carry-save counters add up all distances of a move at once, and a word of
pairs is abandoned when every one has passed the radius.

A key may gather any number of fingerprints (a large group of near copies).
Keys over ``hot`` fingerprints are counted first and taken another exact way:
fingerprints within two bits share one that is at most one bit from each, so
every fingerprint is dealt to itself and its 64 neighbours, and no neighbour
can gather more than 65. Nothing is capped, and no task sees a whole hot key.

``keep_one`` goes by the similarity of sets of five-word shingles instead of a
fixed radius. Blocks are then the texts that share a band of least hashes, bit
planes leave those within a wide radius, and these are compared exactly.

Rows: null and empty texts and those without words have fingerprint zero and
link as any other; texts of any length are taken whole; repeated rows link as
copies; a row without an id gets its group's least id; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, give_back, no_model, ship
from lodestone.llm.components import connected, joined_by_key, one_of_each

HOT_KEY = 4096
#: Bands of least hashes and hashes to a band: texts of similarity 0.8 share one in 999 of 1000 cases.
BANDS, ROWS = 14, 4
#: Words of a wide fingerprint. Those of texts of similarity 0.8 differ in some 39 bits of 256, and in over RADIUS hardly ever.
LANES, RADIUS = 4, 64
#: Bytes of shingles that meet in one place.
SET_BYTES = 64 << 20
CHUNK = 200_000
#: Ids up to so many are broadcast (8 bytes each, some MB in all).
FEW = 500_000


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of the ASCII-lower-cased words, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    begin = 0
    while begin < len(hashes):
        end, total = begin, 0
        while end < len(hashes) and (end == begin or total + sizes[end] <= CHUNK):
            total += sizes[end]
            end += 1
        own = np.arange(begin, end)[sizes[begin:end] > 0]
        if own.size:
            counts = np.zeros((own.size, 64), np.int64)
            flat = np.concatenate([hashes[i] for i in own])
            starts = np.r_[0, np.cumsum(sizes[own])[:-1]]
            for a in range(0, flat.size, CHUNK):  # a very long text comes in parts
                bits = np.unpackbits(flat[a : a + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                first = np.searchsorted(starts, a, side="right") - 1
                at = np.r_[0, starts[(starts > a) & (starts < a + CHUNK)] - a]
                counts[first : first + at.size] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            set_ = (2 * counts > sizes[own][:, None]).astype(np.uint8)
            out[own] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
        begin = end
    return out


def once(udf: Callable) -> Callable:
    """``udf`` so that the optimiser evaluates it once: filters on its result, as joins imply, would otherwise work it out again."""
    return udf.asNondeterministic()


def fingerprint(text: Column, spark, width: int = 3, seed: int = 42) -> Column:
    """The fingerprint of each text, as a signed long."""
    ship(spark)

    @F.arrow_udf("bigint")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        no_model()
        for batch in batches:
            found, held, size = [], [], 0
            for x in batch:
                held.append(shingle_hashes(x.as_py(), width, seed))
                size += held[-1].size
                if size > CHUNK:
                    found.append(majority(held))
                    held, size = [], 0
            found.append(majority(held))
            yield pa.array(np.concatenate(found).view(np.int64), pa.int64())
        give_back()

    return once(mark)(text)


class Planes:
    """Values of some bits each as bit planes: word j of a plane holds one bit of the values 64 j to 64 j + 63.

    ``beyond`` compares every value with the one some places further on, all
    pairs at once: a plane meets itself moved by as many bits, and carry-save
    counters add up the differences. A word of 64 pairs is abandoned once all
    have passed the radius, and no further plane of it is read.
    """

    def __init__(self, values: np.ndarray, bits: int):
        """``values``: a word of 64 bits each, or a row of words."""
        rows = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")[:, :bits]
        rows = np.vstack([rows, np.zeros((-len(rows) % 64, bits), np.uint8)])
        self.planes = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").view(np.uint64)
        self.words = self.planes.shape[1]
        self.read = 0

    def near(self, step: int, words: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
        """Of the pairs (i, i + step) that ``lanes`` names in ``words``, those that differ in ``radius`` bits or fewer: the places i."""
        ahead, turn = words + step // 64, np.uint64(step % 64)
        counters = [np.zeros(words.size, np.uint64) for _ in range(int(radius).bit_length())]
        over = ~lanes  # pairs that don't count are beyond from the start
        for k, plane in enumerate(self.planes):
            moved = self._at(plane, ahead) >> turn
            if turn:
                moved |= self._at(plane, ahead + 1) << (np.uint64(64) - turn)
            carry = plane[words] ^ moved
            self.read += words.size
            for c in counters:
                carry, c[:] = c & carry, c ^ carry
            over |= carry
            if k % 8 == 7 or k + 1 == len(self.planes):
                if counters:
                    over |= self._past(counters, radius)
                alive = np.flatnonzero(~over)
                if alive.size < words.size:
                    words, ahead, over = words[alive], ahead[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not words.size:
                    break
        bit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, lane = np.nonzero(bit)
        return words[w] * 64 + lane

    def _at(self, plane: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.where(words < self.words, plane[np.minimum(words, self.words - 1)], np.uint64(0))

    @staticmethod
    def _past(counters: list[np.ndarray], radius: int) -> np.ndarray:
        """The lanes whose count is over ``radius``, from the highest bit down."""
        more, equal = np.zeros_like(counters[0]), None
        for k in range(len(counters) - 1, -1, -1):
            c = counters[k]
            if radius >> k & 1:
                equal = c if equal is None else equal & c
            else:
                more = more | (c if equal is None else equal & c)
                equal = ~c if equal is None else equal & ~c
        return more


def neighbours(starts: np.ndarray, value: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within ``radius`` in runs that begin at ``starts``: those one place apart, those two apart, and so on."""
    if not len(value):
        return
    sizes = np.diff(np.r_[starts, len(value)])
    end = np.repeat(starts + sizes, sizes)
    planes = Planes(value, bits)
    at = np.flatnonzero(np.arange(len(value)) + 1 < end)
    step = 1
    while at.size:
        words, first = np.unique(at >> 6, return_index=True)
        lanes = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
        hit = planes.near(step, words, lanes, radius)
        if hit.size:
            yield hit, hit + step
        step += 1
        at = at[at + step < end[at]]


class Forest:
    """What is joined, by places; the least place of a tree is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return above
            self.up = above

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins pairs, all at once, until nothing changes."""
        while i.size:
            top = self.roots()
            a, b = top[i], top[j]
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def link_groups(key: np.ndarray, value: np.ndarray, node: np.ndarray, radius: int, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is within ``radius`` in runs of equal keys: no more than a forest of each run's links."""
    forest = Forest(key.size)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for i, j in neighbours(starts, value, bits, radius):
        forest.join(i, j)
    top = forest.roots()
    own = np.flatnonzero(top != np.arange(key.size))
    return node[own], node[top[own]]


def links(nodes: DataFrame, radius: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """Edges (a, b) between the ids of distinct fingerprints, with the components of all links of ``radius`` or fewer bits.

    ``nodes``: fp (long, distinct), node (long).
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    ship(nodes.sparkSession)
    quarter = [F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    pair = lambda p, q: F.shiftleft(quarter[p], 16) + quarter[q]
    # A key is two quarters; fingerprints of one key can only differ in the other two.
    keys = F.array(*(F.struct((F.lit(t << 32) + pair(p, q)).alias("k"), pair(*sorted({0, 1, 2, 3} - {p, q})).alias("rest")) for t, (p, q) in enumerate(combinations(range(4), 2))))
    dealt = nodes.select(F.explode(keys).alias("x"), "fp", "node").select("x.k", "x.rest", "fp", "node")
    large = durable(dealt.groupBy("k").count().where(F.col("count") > hot).select("k"))
    over = large.count()
    cold = dealt
    if over:
        cold = dealt.join(F.broadcast(large) if over <= 100_000 else large, "k", "left_anti")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            k, value, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if rest is not None:
                k, value, node = (np.concatenate(p) for p in zip(rest, (k, value, node), strict=True))
            if not k.size:
                continue
            cut = np.searchsorted(k, k[-1])  # the last key may go on
            rest = k[cut:], value[cut:], node[cut:]
            if cut:
                a, b = link_groups(k[:cut], value[:cut], node[:cut], radius)
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
        if rest is not None:
            a, b = link_groups(*rest, radius)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    found = cold.select("k", "rest", "node").repartition("k").sortWithinPartitions("k").mapInArrow(compare, "a bigint, b bigint")
    if over:
        inside = dealt.join(F.broadcast(large) if over <= 100_000 else large, "k", "left_semi").select("fp", "node").distinct()
        near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)))
        # Each of these groups has 65 members at most, all within two bits of one another.
        group = inside.select(F.explode(near).alias("v"), "fp", "node").groupBy("v").agg(F.collect_list(F.struct("fp", "node")).alias("m"), F.count("*").alias("n")).where("n > 1")
        if radius == 2:
            found = found.unionByName(group.select(F.array_min("m.node").alias("a"), F.explode("m.node").alias("b")).where("a <> b"))
        elif radius == 1:
            found = found.unionByName(group.select("v", F.explode("m").alias("x"), F.filter("m", lambda y: y.fp == F.col("v")).alias("c")).where("size(c) > 0").select(F.col("x.node").alias("a"), F.col("c")[0].node.alias("b")).where("a <> b"))
    return found


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, hot: int = HOT_KEY) -> DataFrame:
    """doc_id, fp (long), component_id: one row for each row of ``docs``."""
    marked = durable(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), docs.sparkSession, width).alias("fp")))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    groups = connected(links(nodes.where("node is not null").select("fp", "node"), radius, hot))
    named = nodes.join(groups, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return joined_by_key(marked, named, ["fp"], marked.count()).select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash_groups(docs, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: blocks by least hashes, distances by bit planes, exact similarity of what is left.


def multipliers(n: int) -> np.ndarray:
    """Odd factors, each of which puts hashes in another order."""
    return np.fromiter((xxhash.xxh64_intdigest(str(k), 1) | 1 for k in range(n)), np.uint64, n)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    if not lane:
        return h
    x = h ^ np.uint64(xxhash.xxh64_intdigest(str(lane), 2))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(text: Column, spark, width: int, bands: int = BANDS, rows: int = ROWS) -> Column:
    """A struct for each text: mark (of its set of shingles), n (their number), fp (LANES words), and one key a band of least hashes."""
    ship(spark)

    @F.arrow_udf("struct<mark:string,n:int,fp:array<bigint>,keys:array<bigint>>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        no_model()
        factors = multipliers(bands * rows)
        for batch in batches:
            marks, sizes, fps, keys = [], [], [], []
            held, size = [], 0
            for i, x in enumerate(batch):
                h = shingle_hashes(x.as_py(), width)
                held.append(h)
                size += h.size
                if size > CHUNK or i + 1 == len(batch):
                    fps.append(np.stack([majority([mixed(h, k) for h in held]) for k in range(LANES)], axis=1))
                    held, size = [], 0
                own = np.unique(h)
                marks.append(xxhash.xxh128_hexdigest(own.tobytes()))
                sizes.append(own.size)
                least = np.full(factors.size, ~np.uint64(0))
                for a in range(0, own.size, CHUNK // factors.size):
                    np.minimum(least, (own[None, a : a + CHUNK // factors.size] * factors[:, None]).min(1), out=least)
                band = least.reshape(bands, rows)
                keys.append([xxhash.xxh64_intdigest(v.tobytes(), k) for k, v in enumerate(band)] if own.size else [])
            flat = np.fromiter((k for own in keys for k in own), np.uint64).view(np.int64)
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))
            fp = np.concatenate(fps).view(np.int64).ravel() if fps else np.zeros(0, np.int64)
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * LANES), pa.array(fp, pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(marks, pa.string()), pa.array(sizes, pa.int32()), prints, lists], ["mark", "n", "fp", "keys"])
        give_back()

    return once(look)(text)


def shingle_sets(text: Column, spark, width: int) -> Column:
    """A struct for each text: mark, and its different shingle hashes."""
    ship(spark)

    @F.arrow_udf("struct<mark:string,own:array<bigint>>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), width)) for x in batch]
            marks = [xxhash.xxh128_hexdigest(s.tobytes()) for s in sets]
            yield pa.StructArray.from_arrays([pa.array(marks, pa.string()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["mark", "own"])
        give_back()

    return once(look)(text)


def shared_keys(dealt: DataFrame, hot: int) -> DataFrame:
    """k, parts: the keys that several marks have, of keys with the very same marks only the least; and in how many parts they are looked at.

    ``dealt``: k, n, mark. A key of over ``hot`` marks, or of over SET_BYTES of shingles, is cut into parts of about half of that.
    """
    sets = [F.bit_xor(F.xxhash64(F.lit(seed), "mark")).alias(f"x{seed}") for seed in (1, 2)]
    keys = dealt.groupBy("k").agg(F.count("*").alias("c"), F.sum("n").alias("size"), *sets).where("c > 1")
    parts = F.greatest(F.ceil(F.col("c") * 2 / hot), F.ceil(F.col("size") * 16 / SET_BYTES)).cast("bigint")
    return durable(keys.groupBy("c", "size", "x1", "x2").agg(F.min("k").alias("k")).select("k", parts.alias("parts")))


def alike(dealt: DataFrame, sets: DataFrame, radius: int, similarity: float, across: bool) -> DataFrame:
    """a, b: edges that join the marks of one key which have the similarity; no more than a forest a key or part.

    ``dealt``: k, parts, fp, n, mark, label; marks of one label are joined already. ``sets``: mark, own (its shingle hashes).
    Pairs within ``radius`` whose sizes allow it are held against the similarity where they meet, unless they are joined by then.
    Parts of a key are looked at by themselves, or with ``across`` every two of them together.
    """
    part = F.when(F.col("parts") > 2, F.pmod(F.xxhash64("mark", "k"), F.col("parts"))).otherwise(F.lit(0)).cast("bigint")
    held = dealt.withColumn("part", part)
    if across:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
        held = held.withColumn("other", every).where("part <> other").withColumn("part", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))

    def joined(t: pa.Table) -> pa.RecordBatch:
        k, part, n = (t[c].to_numpy() for c in ("k", "part", "n"))
        marks, own = t["mark"].combine_chunks(), t["own"].combine_chunks()
        fp = t["fp"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
        flat, ends = own.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(own.value_lengths().to_numpy())]
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (part[1:] != part[:-1])])
        forest = Forest(len(k))
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        group = np.repeat(np.arange(starts.size), np.diff(np.r_[starts, len(k)]))
        first, where = np.unique(np.stack([group, label], axis=1), axis=0, return_index=True, return_inverse=True)[1:]
        forest.join(first[where.ravel()], np.arange(len(k)))

        def same(i: int, j: int) -> bool:
            x, y = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
            both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), y.size - 1)] == x))
            return both / (x.size + y.size - both) >= similarity

        found = []
        for i, j in neighbours(starts, fp, 64 * LANES, radius):
            top = forest.roots()
            fit = (top[i] != top[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            hit = [p for p in zip(i[fit].tolist(), j[fit].tolist(), strict=True) if same(*p)]
            if hit:
                found += hit
                forest.join(*np.array(hit).T)
        i, j = (pa.array([p[c] for p in found], pa.int64()) for c in (0, 1))
        return pa.record_batch([marks.take(i), marks.take(j)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_model()
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            k, part = t["k"].to_numpy(), t["part"].to_numpy()
            cut = int(np.argmax((k == k[-1]) & (part == part[-1])))  # the last group may go on
            rest = t.slice(cut)
            if cut:
                yield joined(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield joined(rest)
        give_back()

    rows = held.join(sets, "mark").select("k", "part", "fp", "n", "mark", "label", "own")
    return durable(rows.repartition("k", "part").sortWithinPartitions("k", "part", "mark").mapInArrow(compare, "a string, b string"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS, hot: int = HOT_KEY) -> DataFrame:
    """doc_id, mark, comp: one row for each row of ``docs``; texts whose sets of shingles have that Jaccard similarity or more are linked.

    Candidates share a key of least hashes and have fingerprints within ``radius``; each is then
    held against the similarity exactly, unless both are in one group by then.
    """
    spark = docs.sparkSession
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    few = lambda df: F.broadcast(df) if df.count() <= FEW else df
    marked = durable(docs.select(own.alias("doc_id"), sketch(text, spark, width).alias("s")).select("doc_id", "s.*"))
    nodes = marked.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = durable(nodes)
    # Most keys stand alone: they are told by themselves, before anything wider moves.
    keys = shared_keys(nodes.select(F.explode("keys").alias("k"), "n", "mark"), hot)
    dealt = durable(nodes.select(F.explode("keys").alias("k"), "fp", "n", "mark", "id").join(few(keys), "k"))

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = durable(rows.select("mark", "id").distinct())
        texts = docs.select(own.alias("id"), text.alias("t")).join(few(wanted.select("id").distinct()), "id", "left_semi")
        sets = texts.select("id", shingle_sets(F.col("t"), spark, width).alias("s")).select("id", "s.mark", "s.own")
        return sets.join(few(wanted), ["id", "mark"], "left_semi").dropDuplicates(["mark"]).select("mark", "own")

    edges = alike(dealt.withColumn("label", F.col("mark")), sets_of(dealt), radius, similarity, across=False)
    groups = connected(edges)
    # Of keys in more than two parts every two parts meet, where their marks are in different groups still.
    large = dealt.where("parts > 2")
    if large.limit(1).count():
        labels = groups.select(F.col("node").alias("mark"), F.col("component").alias("label"))
        large = large.join(few(labels), "mark", "left").withColumn("label", F.coalesce("label", "mark"))
        apart = large.groupBy("k").agg(F.count_distinct("label").alias("labels")).where("labels > 1").select("k")
        large = durable(large.join(few(apart), "k", "left_semi"))
        groups = connected(edges.unionByName(alike(large, sets_of(large), radius, similarity, across=True)))
    named = groups.withColumnRenamed("node", "mark")
    return marked.select("doc_id", "mark").join(few(named), "mark", "left").select("doc_id", "mark", F.coalesce("component", "mark").alias("comp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS, hot: int = HOT_KEY) -> DataFrame:
    """One row of each group of near copies, that of least id, with its own columns.

    Rows that share an id are told apart by their marks. Rows without an id stay only where no row with one has their set of shingles, and then one of each set.
    Null and empty texts and those without words have one empty set; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    groups = durable(similar_groups(docs, id_col, text_col, width, similarity, radius, hot))
    return one_of_each(docs, id_col, text_col, groups, lambda text: shingle_sets(text, spark, width)["mark"], FEW)
