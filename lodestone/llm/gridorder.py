"""Embedding near-duplicates by an epsilon grid order join.

Copies of a vector are one row first. Unit vectors are turned to principal
axes and sorted by label and by the grid cells (as wide as the radius) of
their leading coordinates. Runs of the sorted sequence are blocks with a
bounding box, whose last side is what the leading axes leave of a vector.
Blocks are paired only where they hold adjacent cells and their boxes lie
within the radius. A pair of blocks is then joined recursively, each half
against each half, until boxes prove it distant, or prove all of it within
the radius, or it is small enough to compute.

Cosines are computed in double precision. A vector is first multiplied by the
power of two that brings its largest component near 1, which is exact, so that
no square leaves the range of doubles.

The axes only decide what can be skipped, never what is linked, so they are
fitted on a bounded sample (``sample`` vectors of least hash). Where vectors
spread evenly over many dimensions, no box is far from another, and all pairs
of a label are computed.

Rows: vectors that are null, empty, zero, or hold a null or non-finite
component, and rows without a label or an id, link with nothing and are groups
of their own (without an id: kept, with a null component); vectors of
different lengths don't link; repeated rows link as copies; an empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import durable, give_back, ship
from lodestone.llm.components import connected, joined_by_key
from lodestone.llm.simhash import Forest

#: Leading axes of the boxes, and of the cells by which blocks are paired.
AXES, CELLS = 12, 3
#: Vectors and bytes of a block at most, vectors of the smallest interval, vectors the axes are fitted on.
BLOCK, BLOCK_BYTES, LEAF, SAMPLE = 4096, 8 << 20, 128, 4096
#: Tasks that share the blocks of one cell.
SALTS = 16
#: Tasks that join pairs of blocks, for each that makes blocks; no more than a shuffle has.
PAIRS_TO_BLOCKS = 8
SLACK = 1e-9


def linkable(v: Column) -> Column:
    """Whether a vector has a direction: finite, without nulls, not all zeros."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of doubles, each multiplied by a power of two so that its largest component lies from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def axes(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal axes (columns), those along which unit vectors spread most first."""
    x = scaled(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x - x.mean(axis=0)
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES])


def placed(x: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    """The coordinates of vectors on the leading axes, and the length of what is left."""
    x = scaled(x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:, :AXES] if turn is None else x @ turn
    out = np.zeros((len(x), AXES + 1))
    out[:, : y.shape[1]] = y
    out[:, AXES] = np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
    return out


class Block:
    """Vectors of one label next to each other in the grid order."""

    def __init__(self, ids: bytes, names: bytes, copies: bytes, vectors: bytes, places: bytes, kind: str):
        self.ids, self.names, self.copies = (np.frombuffer(b, np.int64) for b in (ids, names, copies))
        self.x = scaled(np.frombuffer(vectors, kind).reshape(self.ids.size, -1).astype(np.float64))
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.places = np.frombuffer(places, np.float64).reshape(self.ids.size, AXES + 1)


def least_and_most(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[float, float]:
    """Bounds of the squared distances between two boxes. Of what the axes leave, lengths are known and directions aren't."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    far = np.maximum(high_a - low_b, high_b - low_a)
    far[-1] = high_a[-1] + high_b[-1]
    return float(gap @ gap), float(far @ far)


class BlockJoin:
    """The links between two blocks, or in one."""

    def __init__(self, a: Block, b: Block | None, least: float, radius: float):
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.least, self.within = least, radius * radius
        self.shift = 0 if self.same else a.ids.size
        self.forest = Forest(a.ids.size + (0 if self.same else self.b.ids.size))
        self.more_a = np.zeros(a.ids.size, np.int64)
        self.more_b = self.more_a if self.same else np.zeros(self.b.ids.size, np.int64)
        self.computed = self.skipped = self.proven = 0
        if a.ids.size and self.b.ids.size:
            self.visit(0, a.ids.size, 0, self.b.ids.size)

    def visit(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and a0 > b0:
            return  # the mirror of a visited pair
        one = self.same and a0 == b0
        x, y = self.a.places[a0:a1], self.b.places[b0:b1]
        low, high = least_and_most(x.min(0), x.max(0), y.min(0), y.max(0))
        if low > self.within + SLACK:
            self.skipped += (a1 - a0) * (b1 - b0)
            return
        if high < self.within - SLACK:
            self.all_linked(a0, a1, b0, b1, one)
        elif a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.compute(a0, a1, b0, b1, one)
        else:
            ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
            halves_a = [(a0, ma), (ma, a1)] if a1 - a0 > LEAF else [(a0, a1)]
            halves_b = [(b0, mb), (mb, b1)] if b1 - b0 > LEAF else [(b0, b1)]
            for (p, q), (r, s) in itertools.product(halves_a, halves_b):
                self.visit(p, q, r, s)

    def all_linked(self, a0: int, a1: int, b0: int, b1: int, one: bool) -> None:
        self.proven += (a1 - a0) * (b1 - b0)
        own, other = self.a.copies[a0:a1], self.b.copies[b0:b1]
        self.more_a[a0:a1] += other.sum() - (own if one else 0)
        if not one:
            self.more_b[b0:b1] += own.sum()
        every = np.r_[np.arange(a0, a1), np.arange(b0, b1) + self.shift]
        self.forest.join(np.full(every.size, a0), every)

    def compute(self, a0: int, a1: int, b0: int, b1: int, one: bool) -> None:
        self.computed += (a1 - a0) * (b1 - b0)
        cos = (self.a.x[a0:a1] @ self.b.x[b0:b1].T) / (self.a.norms[a0:a1, None] * self.b.norms[None, b0:b1])
        hit = cos >= self.least
        if one:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.more_a[a0:a1] += hit @ self.b.copies[b0:b1]
        if not one:
            self.more_b[b0:b1] += self.a.copies[a0:a1] @ hit
        i, j = np.nonzero(hit)
        self.forest.join(i + a0, j + b0 + self.shift)


def neighbours(cells: np.ndarray) -> list[list[int]]:
    """A cell key and those of all cells that touch it."""
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=cells.shape[1])))
    return np.unique((cells[:, None, :] + steps[None]).reshape(-1, cells.shape[1]), axis=0).tolist()


def grid_links(reps: DataFrame, rows: int, least: float, sample: int = SAMPLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(node, more), (a, b): copies linked to each distinct vector, and edges (of structs name, node) with the components of all links.

    ``reps``: label, embedding (of floats or doubles, distinct by label), node (its number), name (its least id), n (its copies).
    """
    spark = ship(reps.sparkSession)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    chosen = [r[0] for r in reps.orderBy(F.xxhash64("node"), "node").select("embedding").limit(sample).collect()]
    turn = {d: axes(np.array([v for v in chosen if len(v) == d], dtype=np.float64)) for d in {len(v) for v in chosen}}
    width = max(radius, 1e-6)
    element = reps.schema["embedding"].dataType.elementType.simpleString()
    kind = "f4" if element == "float" else "f8"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())]
            sizes = np.diff(ends)
            places = np.zeros((len(sizes), AXES + 1))
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                places[own] = placed(flat[ends[own][:, None] + np.arange(d)[None]], turn.get(int(d)))
            cells = np.floor(places / width).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (AXES + 1)), pa.array(places.ravel()))
            yield pa.record_batch(
                [batch.column("label"), pa.array(sizes, pa.int32()), batch.column("node"), batch.column("name"), batch.column("n"), vectors, lists, *(pa.array(cells[:, k]) for k in range(CELLS + 1))],
                names=["label", "d", "node", "name", "n", "embedding", "place", *(f"c{k}" for k in range(CELLS + 1))],
            )

    label = reps.schema["label"].dataType.simpleString()
    order = ["label", "d", *(f"c{k}" for k in range(CELLS + 1)), "node"]
    # As many tasks as there are blocks for: a few vectors a task would take longer to hand over than to place.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // block + 1))
    found = reps.coalesce(parts).select("label", "embedding", "node", "name", "n").mapInArrow(place, f"label {label}, d int, node bigint, name bigint, n bigint, embedding array<{element}>, place array<double>, {', '.join(f'c{k} int' for k in range(CELLS + 1))}")
    found = durable(found)
    sequence = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held = TaskContext.get().partitionId() << 32, None
        names = ["id", "label", "d", "size", "low", "high", "own", "near", "ids", "names", "copies", "vectors", "places"]

        def packed(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            places = t["place"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            cells = np.unique(np.stack([t[f"c{k}"].to_numpy() for k in range(CELLS)], axis=1), axis=0)
            vectors = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
            row = [made, t["label"][0].as_py(), t["d"][0].as_py(), t.num_rows, places.min(0).tolist(), places.max(0).tolist(), cells.tolist(), neighbours(cells), *(t[c].to_numpy().astype(np.int64).tobytes() for c in ("node", "name", "n")), vectors.tobytes(), places.tobytes()]
            kinds = [pa.int64(), t["label"].type, pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())), *[pa.binary()] * 5]
            made += 1
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                label_, d = (held[c].combine_chunks() for c in ("label", "d"))
                most = max(LEAF, min(block, BLOCK_BYTES // (8 * d[0].as_py())))
                other = np.flatnonzero((label_.to_numpy(zero_copy_only=False) != label_[0].as_py()) | (d.to_numpy() != d[0].as_py()))
                end = min(int(other[0]) if other.size else held.num_rows, most)
                if end == held.num_rows and end < most:
                    break  # it may go on in the next batch
                yield packed(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield packed(held)

    kinds = f"id bigint, label {label}, d int, size int, low array<double>, high array<double>, own array<array<int>>, near array<array<int>>, ids binary, names binary, copies binary, vectors binary, places binary"
    blocks = durable(sequence.mapInArrow(cut, kinds))
    # The blocks of one cell are met by those next to it in several tasks, a share of the first in each.
    one = blocks.select("label", "d", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), F.explode("own").alias("cell"), F.col("low").alias("la"), F.col("high").alias("ha"))
    two = blocks.select("label", "d", F.col("id").alias("b"), F.explode("near").alias("cell"), F.col("low").alias("lb"), F.col("high").alias("hb")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    gap = [F.greatest(F.lit(0.0), F.col("la")[k] - F.col("hb")[k], F.col("lb")[k] - F.col("ha")[k]) for k in range(AXES + 1)]
    near = sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= radius * radius + SLACK
    pairs = one.join(two, ["label", "d", "salt", "cell"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    pack = F.struct("ids", "names", "copies", "vectors", "places")

    def linked(x: tuple, y: tuple | None) -> pa.RecordBatch:
        a, b = (None if v is None else Block(*v.values(), kind) for v in (x, y))
        got = BlockJoin(a, b, least, radius)
        ids, names, more = (a.ids, a.names, got.more_a) if b is None else (np.r_[a.ids, b.ids], np.r_[a.names, b.names], np.r_[got.more_a, got.more_b])
        order = np.lexsort((ids, names))
        rank = np.empty_like(order)
        rank[order] = np.arange(order.size)
        first = np.full(ids.size, order.size)
        np.minimum.at(first, got.forest.roots(), rank)
        own = np.flatnonzero(more)
        hub = order[first[got.forest.roots()[own]]]
        return pa.record_batch([pa.array(v) for v in (ids[own], names[own], more[own], ids[hub], names[hub])], names=["node", "name", "more", "hub", "hub_name"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield linked(batch.column("x")[k].as_py(), None)
        give_back()

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield linked(batch.column("x")[k].as_py(), batch.column("y")[k].as_py())
        give_back()

    # A block meets itself where it lies; only blocks that meet another move.
    out = "node bigint, name bigint, more bigint, hub bigint, hub_name bigint"
    alone = blocks.select(pack.alias("x")).mapInArrow(inside, out)
    both = pairs.join(blocks.select(F.col("id").alias("a"), pack.alias("x")), "a").join(blocks.select(F.col("id").alias("b"), pack.alias("y")), "b")
    found = durable(alone.unionByName(both.select("x", "y").coalesce(PAIRS_TO_BLOCKS * parts).mapInArrow(between, out)))
    edges = found.where("node <> hub").select(F.struct("name", "node").alias("a"), F.struct(F.col("hub_name").alias("name"), F.col("hub").alias("node")).alias("b"))
    return found.groupBy("node").agg(F.sum("more").alias("more")), edges


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    held = vectors.schema[vector_col].dataType
    single = isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & linkable(F.col("embedding"))
    # Two hashes of 64 bits stand for a vector of a label, so that vectors themselves are no keys.
    hashed = v.withColumns({f"h{k}": F.when(good, F.xxhash64(F.lit(k), "label", "embedding")) for k in (1, 2)})
    reps = durable(hashed.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("r"), F.count("*").alias("n")).select("h1", "h2", "n", "r.*"))
    reps = reps.withColumnRenamed("vec_id", "name").withColumn("node", F.monotonically_increasing_id())  # ids may repeat
    counted = reps.agg(F.count("*").alias("rows"), F.sum("n").alias("total")).first()
    out = hashed.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counted["rows"]:
        more, edges = grid_links(reps, counted["rows"], least, **options)
        groups = connected(edges).select("node.node", F.col("component.name").alias("component_id"))
        named = reps.select("h1", "h2", "n", "node", "name").join(more, "node", "left").join(groups, "node", "left")
        named = named.select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "name").alias("component_id"))
        found = joined_by_key(hashed.where("h1 is not null").select("vec_id", "h1", "h2"), durable(named), ["h1", "h2"], counted["total"])
        out = found.select("vec_id", "n_links", "component_id").unionByName(out)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
