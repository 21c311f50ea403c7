"""Documents to postings and statistics.

The JVM cuts texts into tokens, and an Arrow function groups those of each
document where the document is, by numbers in place of terms: nothing moves.
The postings are laid out by term in one exchange, with the document in the
range key, so that the postings of a very common term spread over many
partitions. They move as blocks, each a run of a batch's sorted postings that
lies between two cuts; where to cut is told from the postings of some documents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.analysis import Analyzer, field_tokens, small_batches
from lodestone.functions.similarity import EXACT
from lodestone.schema import IndexOptions, IndexSchema

POSTINGS = "field string, term string, doc bigint, tf int, norm smallint, lead boolean, positions array<int>"


#: Tokens that are grouped at once, some 60 bytes each; a document is never cut.
GROUPED = 1 << 21
#: Where postings are cut is told from so many bytes of documents as they are written, and so many documents at least, which have a mark every so many bytes of postings.
SAMPLED, SAMPLED_DOCS, MARKED = 4 << 20, 200, 1024
#: Bytes of postings that a task lays out at once, of which it holds some three copies.
LAID = 48 << 20
#: What a posting weighs without its positions, which are 4 bytes each.
POSTING_BYTES = 32


def field_values(name: str, docs: DataFrame, schema: IndexSchema, analyzer: Analyzer) -> Column:
    """The tokens of a field's column: plain strings, long ones not cut yet, whose places are their positions, or (term, pos)."""
    spec, kind = schema.get(name), docs.schema[name].dataType
    analyzer, multi = analyzer.for_field(name), isinstance(kind, T.ArrayType)
    value = F.col(f"`{name}`")
    if not spec.tokenized:  # whole values are terms, empty ones too
        return F.filter(value, lambda v: v.isNotNull()) if multi else F.when(value.isNotNull(), F.array(value))
    if not multi and not analyzer.python and not analyzer.stop_words:
        return analyzer.words(value)
    return field_tokens(analyzer, value, multi)


#: A field's name, whether frequencies, positions and norms are kept, and how long a token that is a plain string can be.
Kept = tuple[str, bool, bool, bool, int | None]


def grouping(fields: list[Kept]) -> Callable:
    """A function from batches (doc, t0, t1 ... by field) to postings, sorted by term and document in each batch.

    All it needs travels with it, so that workers import no code of ours.
    """
    most, exact = GROUPED, EXACT

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def codes(n):
            v = n - exact
            shift = np.maximum(np.frexp(v.astype(float))[1].astype(np.int64) - 4, 0)
            return np.where(v < 8, n, exact + (v >> shift & 7 | shift + 1 << 3)).astype(np.int16)

        def cut(words, n, long):
            sizes = pc.utf8_length(words).to_numpy()
            if not len(sizes) or sizes.max() <= long:
                return words, n
            times = np.maximum(1, -(-sizes // long))
            of = np.repeat(np.arange(len(times)), times)
            pieces = [t[a : a + long] for t in words.filter(pa.array(sizes > long)).to_pylist() for a in range(0, len(t), long)]
            ends = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(n)))]
            return pc.replace_with_mask(words.take(pa.array(of)), pa.array(sizes[of] > long), pa.array(pieces, pa.string())), np.diff(ends)

        def one(docs, lists, n, name, freqs, places, norms, long):
            tokens = lists.flatten()
            if long is not None and not pa.types.is_struct(tokens.type):
                tokens, n = cut(tokens, n, long)
            of = np.repeat(np.arange(len(n)), n)
            if pa.types.is_struct(tokens.type):
                words, at = tokens.field(0), tokens.field(1).to_numpy(zero_copy_only=False)
            else:
                words, at = tokens, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            if words.null_count:
                there = words.is_valid().to_numpy(zero_copy_only=False)
                words, at, of = words.drop_null(), at[there], of[there]
            if not len(words):
                return None
            # Terms are numbered in their order, so that one sort of numbers groups the tokens.
            told = words.dictionary_encode()
            order = pc.sort_indices(told.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            group, bits = rank[told.indices.to_numpy()] * len(n) + of, len(of).bit_length()
            if (len(order) * len(n)).bit_length() + bits < 64:
                group = group << bits | np.arange(len(of))
                group.sort()
                token = group & (1 << bits) - 1
                group >>= bits
            else:
                token = np.argsort(group, kind="stable")
                group = group[token]
            start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            term, row = np.divmod(group[start], len(n))
            ends = np.append(start, len(token)).astype(np.int32)
            first = np.concatenate(([True], of[1:] != of[:-1]))
            k = len(start)
            return pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(name, pa.string()), k),
                    told.dictionary.take(pa.array(order[term])).cast(pa.string()),
                    docs.take(pa.array(row)),
                    pa.array(np.diff(ends) if freqs else np.ones(k, np.int32)),
                    pa.array(codes(n)[row] if norms else np.ones(k, np.int16)),
                    pa.array(first[token[start]]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(at[token].astype(np.int32))) if places else pa.nulls(k, pa.list_(pa.int32())),
                ],
                names=["field", "term", "doc", "tf", "norm", "lead", "positions"],
            )

        for batch in batches:
            docs = batch.column(0)
            for k, field in enumerate(fields):
                lists = batch.column(k + 1)
                n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends, a = np.cumsum(n), 0
                while a < len(n):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
                    out = one(docs.slice(a, b - a), lists.slice(a, b - a), n[a:b], *field)
                    if out is not None:
                        yield out
                    a = b

    return run


def _read(docs: DataFrame, schema: IndexSchema, analyzer: Analyzer) -> tuple[DataFrame, list[Kept]] | None:
    """doc and the tokens of each indexed field, and what ``grouping`` is to know of the fields; None if there are none."""
    own = [(name, spec) for name, spec in schema if spec.indexed and name in docs.columns]
    if not own:
        return None
    small_batches()
    fields = [(name, spec.index_options >= IndexOptions.FREQS, spec.index_options >= IndexOptions.POSITIONS, bool(spec.has_norms), analyzer.for_field(name).max_token_length if spec.tokenized else None) for name, spec in own]
    values = [field_values(name, docs, schema, analyzer).alias(f"t{k}") for k, (name, _) in enumerate(own)]
    return docs.select(F.col("doc").cast("long").alias("doc"), *values), fields


def postings(docs: DataFrame, schema: IndexSchema, analyzer: Analyzer) -> DataFrame:
    """The postings of all indexed fields of ``docs`` (doc, of another document in each row, and the fields' columns). ``lead`` marks one posting of every document in a field."""
    read = _read(docs, schema, analyzer)
    return docs.sparkSession.createDataFrame([], POSTINGS) if read is None else read[0].mapInArrow(grouping(read[1]), POSTINGS)


def marking(group: Callable, every: int) -> Callable:
    """A function from batches to (field, term, doc) of the postings at which so many more bytes have passed."""
    least = POSTING_BYTES

    def run(batches):
        import numpy as np
        import pyarrow as pa

        left = 0
        for out in group(batches):
            sizes = np.cumsum(out.column(3).to_numpy().astype(np.int64) * 4 + least) + left
            left = int(sizes[-1]) % every
            at = pa.array(np.searchsorted(sizes, np.arange(every, sizes[-1] + 1, every)))
            yield pa.RecordBatch.from_arrays([out.column(k).take(at) for k in range(3)], names=["field", "term", "doc"])

    return run


def dealing(group: Callable, names: list[str], cuts: list[tuple[str, str, int]]) -> Callable:
    """A function from batches to (part, field, block): runs of sorted postings between ``cuts``. ``names``: the fields in order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def in_order():
            for batch in batches:
                docs = batch.column(0).to_numpy()
                yield batch if np.all(docs[1:] > docs[:-1]) else batch.take(pa.array(np.argsort(docs)))

        for out in group(in_order()):
            name, terms, docs = out.column(0)[0].as_py(), out.column(1), out.column(2).to_numpy()
            own = [(k, t, d) for k, (f, t, d) in enumerate(cuts) if f == name]
            ends, seen = [0], {}
            for _, t, d in own:
                if t not in seen:
                    value = lambda i: terms[i].as_py()
                    a = bisect_left(range(len(terms)), t, lo=ends[-1], key=value)
                    seen[t] = a, bisect_right(range(len(terms)), t, lo=a, key=value)
                a, b = seen[t]
                ends.append(a + int(np.searchsorted(docs[a:b], d)))
            ends.append(len(terms))
            first = own[0][0] if own else sum(f < name for f, _, _ in cuts)
            rows = [(first + k, out.slice(a, b - a)) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
            blocks = [r.select(range(1, r.num_columns)).serialize().to_pybytes() for _, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([names.index(name)] * len(rows), pa.int32()), pa.array(blocks, pa.binary())], names=["part", "field", "block"])

    return run


def gathering(names: list[str]) -> Callable:
    """A function from blocks, sorted by part and field, to postings in order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        columns = pa.schema([("term", pa.string()), ("doc", pa.int64()), ("tf", pa.int32()), ("norm", pa.int16()), ("lead", pa.bool_()), ("positions", pa.list_(pa.int32()))])

        def laid(field, blocks):
            (all_,) = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), columns) for b in blocks]).combine_chunks().to_batches()
            told, docs = all_.column(0).dictionary_encode(), all_.column(1).to_numpy()
            order = pc.sort_indices(told.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rank, docs = rank[told.indices.to_numpy()], docs - docs.min()
            width = int(docs.max()) + 1
            order = np.argsort(rank * width + docs) if len(told.dictionary) * width < 1 << 63 else np.lexsort((docs, rank))
            for a in range(0, len(order), 1 << 16):
                out = all_.take(pa.array(order[a : a + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(names[field], pa.string()), len(out)), *out.columns], names=["field", *columns.names])

        key, blocks = None, []
        for batch in batches:
            for part, field, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, field) != key and blocks:
                    yield from laid(key[1], blocks)
                    blocks = []
                key = part, field
                blocks.append(block)
        if blocks:
            yield from laid(key[1], blocks)

    return run


def laid_out(docs: DataFrame, schema: IndexSchema, analyzer: Analyzer, count: int, size: int, parts: int) -> DataFrame:
    """The postings of ``docs``, which are ``count`` rows of ``size`` bytes in files, ordered by field, term and document through ``parts`` partitions, or more if they are large.

    ``docs`` is read twice; the first time only some documents, which tell where to cut, are tokenised.
    """
    read = _read(docs, schema, analyzer)
    if read is None:
        return postings(docs, schema, analyzer)
    _, fields = read
    every = max(1, min(size // SAMPLED, count // SAMPLED_DOCS))
    some, _ = _read(docs.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0), schema, analyzer)
    marks = sorted(tuple(r) for r in some.mapInArrow(marking(grouping(fields), MARKED), "field string, term string, doc bigint").collect())
    parts = max(parts, -(-len(marks) * MARKED * every // LAID))
    cuts = sorted({marks[k * len(marks) // parts] for k in range(1, parts)}) if marks else []
    names = sorted(f[0] for f in fields)
    blocks = read[0].mapInArrow(dealing(grouping(fields), names, cuts), "part int, field int, block binary")
    return blocks.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "field").mapInArrow(gathering(names), POSTINGS)


def term_stats(posted: DataFrame) -> DataFrame:
    """field, term, doc_freq, total_term_freq."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_term_freq"))


def field_stats(posted: DataFrame) -> DataFrame:
    """field, doc_count (documents with a term), sum_total_term_freq, sum_doc_freq."""
    return posted.groupBy("field").agg(F.sum(F.col("lead").cast("long")).alias("doc_count"), F.sum("tf").alias("sum_total_term_freq"), F.count("*").alias("sum_doc_freq"))
