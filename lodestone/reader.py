"""Point-in-time views of an index."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import Corrupt, IndexNotFound
from lodestone.operators.indexing import POSTINGS
from lodestone.plans.compile import FieldStats
from lodestone.schema import IndexSchema
from lodestone.sources.storage import Storage

COMMITS = "commits"
#: Terms whose statistics a reader remembers, which never change in a snapshot.
KNOWN_TERMS = 100_000


@dataclass
class Segment:
    """An immutable part of an index: documents 0 to ``max_doc``, their postings, and which are deleted."""

    name: str
    max_doc: int
    fields: dict[str, FieldStats] = field(default_factory=dict)
    num_terms: dict[str, int] = field(default_factory=dict)
    del_gen: int = 0
    del_count: int = 0
    files: dict[str, list[int | None]] = field(default_factory=dict)

    @property
    def num_docs(self) -> int:
        return self.max_doc - self.del_count

    @property
    def docs_dir(self) -> str:
        return f"segments/{self.name}/docs"

    @property
    def postings_dir(self) -> str:
        return f"segments/{self.name}/postings"

    @property
    def terms_dir(self) -> str:
        return f"segments/{self.name}/terms"

    @property
    def deletes_dir(self) -> str | None:
        return f"deletes/{self.name}-{self.del_gen}" if self.del_gen else None

    def folders(self) -> list[str]:
        return [d for d in (self.docs_dir, self.postings_dir, self.terms_dir, self.deletes_dir) if d]

    def to_json(self) -> dict:
        return {**vars(self), "fields": {n: vars(s) for n, s in self.fields.items()}}

    @classmethod
    def from_json(cls, data: dict) -> Segment:
        return cls(**{**data, "fields": {n: FieldStats(**s) for n, s in data["fields"].items()}})


@dataclass
class Commit:
    """What a generation of an index consists of."""

    generation: int = 0
    counter: int = 0
    schema: IndexSchema = field(default_factory=IndexSchema)
    segments: list[Segment] = field(default_factory=list)

    def to_json(self) -> dict:
        return {"generation": self.generation, "counter": self.counter, "schema": self.schema.to_json(), "segments": [s.to_json() for s in self.segments]}

    @classmethod
    def from_json(cls, data: dict) -> Commit:
        try:
            return cls(data["generation"], data["counter"], IndexSchema.from_json(data["schema"]), [Segment.from_json(s) for s in data["segments"]])
        except (KeyError, TypeError, ValueError) as e:
            raise Corrupt("a commit can't be read") from e

    @staticmethod
    def generations(storage: Storage) -> list[int]:
        return sorted(int(n[:-5]) for n in storage.names(COMMITS) if n.endswith(".json") and n[:-5].isdigit())

    @classmethod
    def newest(cls, storage: Storage) -> Commit:
        known = cls.generations(storage)
        if not known:
            raise IndexNotFound(storage.root)
        return cls.from_json(storage.read_json(f"{COMMITS}/{known[-1]}.json"))


class SegmentReader:
    """One segment as DataFrames; documents by their numbers in it."""

    def __init__(self, storage: Storage, segment: Segment, schema: IndexSchema):
        self.storage, self.segment, self.schema = storage, segment, schema
        self._frames: dict[str, DataFrame] = {}

    name = property(lambda self: self.segment.name)
    max_doc = property(lambda self: self.segment.max_doc)
    num_docs = property(lambda self: self.segment.num_docs)
    field_infos = property(lambda self: self.schema)

    def _read(self, folder: str) -> DataFrame:
        """A folder's files, listed once: they never change."""
        if folder not in self._frames:
            self._frames[folder] = self.storage.spark.read.parquet(self.storage.at(folder))
        return self._frames[folder]

    def docs(self, own: list[int] | None = None) -> DataFrame:
        """doc, and the columns of stored fields and doc values, of all documents or of some; deleted documents too."""
        df = self._read(self.segment.docs_dir)
        if own is not None:
            df = df.where(F.col("_doc").isin(own))
        return df.select(F.col("_doc").alias("doc"), *(F.col(f"`{c}`") for c in df.columns if c in self.schema))

    def stored(self, docs: list[int]) -> DataFrame:
        """The rows of some documents; the list reaches the scan as a filter."""
        df = self.docs(docs)
        return df.select("doc", *(F.col(f"`{n}`") for n, s in self.schema if s.stored and n in df.columns))

    def postings(self) -> DataFrame:
        return self._read(self.segment.postings_dir)

    def terms(self) -> DataFrame:
        return self._read(self.segment.terms_dir)

    def term_meta(self, field_name: str, term: str) -> Row | None:
        return self.terms().where((F.col("field") == field_name) & (F.col("term") == term)).first()

    def norms(self, field_name: str) -> DataFrame:
        """doc, norm of the documents that have the field."""
        return self.postings().where((F.col("field") == field_name) & F.col("lead")).select("doc", "norm")

    def deletes(self) -> DataFrame | None:
        """doc of deleted documents."""
        return self._read(self.segment.deletes_dir) if self.segment.del_gen else None

    def is_live(self, doc: int) -> bool:
        """Whether the segment has the document and it isn't deleted."""
        gone = self.deletes()
        return 0 <= doc < self.max_doc and (gone is None or not gone.where(F.col("doc") == doc).limit(1).count())

    def live_docs(self) -> DataFrame:
        docs = self.docs().select("doc")
        gone = self.deletes()
        return docs if gone is None else docs.join(gone, "doc", "left_anti")

    def doc_value(self, field_name: str, doc: int) -> object:
        spec = self.schema.get(field_name)
        df = self._read(self.segment.docs_dir)
        if spec is None or spec.doc_values is None or field_name not in df.columns or not 0 <= doc < self.max_doc:
            return None
        row = df.where(F.col("_doc") == doc).select(f"`{field_name}`").first()
        return row[0] if row else None

    def document(self, doc: int) -> Row | None:
        """The stored fields of a document."""
        return self.stored([doc]).drop("doc").first() if 0 <= doc < self.max_doc else None

    def field_stats(self, field_name: str) -> FieldStats | None:
        return self.segment.fields.get(field_name)

    def check_files(self) -> None:
        """Refuses a segment whose files aren't those that were written, going by their lengths."""
        there = {n: size for d in self.segment.folders() for n, size in self.storage.sizes(d).items()}
        for name, (size, _) in self.segment.files.items():
            if there.get(name) != size:
                raise Corrupt(f"{name} is {'missing' if name not in there else 'damaged'}")

    def check_integrity(self) -> None:
        """Holds every byte against the checksums that were taken when the files were written; very long files page by page."""
        self.check_files()
        got = self.storage.checksums(self.segment.folders())
        for name, (_, crc) in sorted(self.segment.files.items()):
            if crc is not None and got.get(name) != crc:
                raise Corrupt(f"checksum of {name}")
        for folder in sorted({name.rpartition("/")[0] for name, (_, crc) in self.segment.files.items() if crc is None}):
            self.storage.read_pages(folder)


class IndexReader:
    """A snapshot of an index. What later commits do doesn't change it."""

    def __init__(self, storage: Storage, commit: Commit):
        self.storage, self.commit = storage, commit
        self.segments = [SegmentReader(storage, s, commit.schema) for s in commit.segments]
        self.doc_bases = [0]
        for s in commit.segments:
            self.doc_bases.append(self.doc_bases[-1] + s.max_doc)
        self._postings: DataFrame | None = None
        self._known: dict[tuple[str, str], tuple[int, int] | None] = {}
        for s in self.segments:
            s.check_files()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IndexReader:
        storage = Storage(spark, path)
        return cls(storage, Commit.newest(storage))

    def reopen(self) -> IndexReader:
        """The newest view: itself if nothing has been committed since."""
        known = Commit.generations(self.storage)
        return self if known and known[-1] == self.generation else IndexReader(self.storage, Commit.newest(self.storage))

    schema = property(lambda self: self.commit.schema)
    generation = property(lambda self: self.commit.generation)
    max_doc = property(lambda self: self.doc_bases[-1])
    num_docs = property(lambda self: sum(s.num_docs for s in self.segments))
    num_deleted_docs = property(lambda self: self.max_doc - self.num_docs)

    def _union(self, parts: list[DataFrame | None]) -> DataFrame | None:
        """The segments' rows with documents numbered through the index."""
        moved = [p.withColumn("doc", F.col("doc") + F.lit(b).cast("long")) if b else p for p, b in zip(parts, self.doc_bases, strict=False) if p is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), moved) if moved else None

    def all_docs(self) -> DataFrame:
        """doc and all columns; deleted documents too."""
        out = self._union([s.docs() for s in self.segments])
        return self.storage.spark.createDataFrame([], "doc bigint") if out is None else out

    def docs(self) -> DataFrame:
        """doc and all columns of live documents."""
        return self.live(self.all_docs())

    def postings(self) -> DataFrame:
        """All postings, those of deleted documents too."""
        if self._postings is None:
            out = self._union([s.postings() for s in self.segments])
            self._postings = self.storage.spark.createDataFrame([], POSTINGS) if out is None else out
        return self._postings

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` without those of deleted documents. Their number is known, and decides how they are joined."""
        gone = self._union([s.deletes() for s in self.segments])
        if gone is None:
            return rows
        few = self.num_deleted_docs <= 1_000_000
        return rows.join(F.broadcast(gone) if few else gone, "doc", "left_anti")

    def locate(self, doc: int) -> tuple[int, int]:
        """(segment, number in it) of a document."""
        if not 0 <= doc < self.max_doc:
            raise IndexError(doc)
        k = bisect_right(self.doc_bases, doc) - 1
        return k, doc - self.doc_bases[k]

    def documents(self, docs: list[int]) -> dict[int, Row]:
        """The stored fields of some documents, one scan a segment."""
        by: dict[int, list[int]] = {}
        for d in docs:
            k, local = self.locate(d)
            by.setdefault(k, []).append(local)
        out = {}
        for k, own in by.items():
            for row in self.segments[k].stored(own).collect():
                values = row.asDict()
                number = values.pop("doc") + self.doc_bases[k]
                out[number] = Row(**values)
        return out

    def document(self, doc: int) -> Row:
        return self.documents([doc])[doc]

    def rows_of(self, docs: list[int]) -> DataFrame:
        """doc and all columns of some documents, one scan a segment that any of them lies in; the list reaches the scan as a filter."""
        by: dict[int, list[int]] = {}
        for d in docs:
            k, local = self.locate(d)
            by.setdefault(k, []).append(local)
        return self.all_docs().where(F.lit(False)) if not by else self._union([s.docs(by[k]) if k in by else None for k, s in enumerate(self.segments)])

    def collection_stats(self, field_name: str) -> FieldStats | None:
        """Over all segments, deleted documents included; None if no document has the field."""
        parts = [s.segment.fields[field_name] for s in self.segments if field_name in s.segment.fields]
        if not sum(p.doc_count for p in parts):
            return None
        return FieldStats(*(sum(getattr(p, k) for p in parts) for k in ("doc_count", "sum_total_term_freq", "sum_doc_freq")))

    def terms(self) -> DataFrame:
        """field, term, doc_freq, total_term_freq over all segments."""
        parts = [s.terms() for s in self.segments]
        if not parts:
            return self.storage.spark.createDataFrame([], "field string, term string, doc_freq bigint, total_term_freq bigint")
        if len(parts) == 1:
            return parts[0]
        return reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_term_freq").alias("total_term_freq"))

    def term_stats(self, keys: set[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, int]]:
        """(doc_freq, total_term_freq) of the terms that occur."""
        new = keys - self._known.keys()
        if new and self.segments:
            wanted = None
            for f in sorted({f for f, _ in new}):
                own = (F.col("field") == f) & F.col("term").isin(sorted(t for g, t in new if g == f))
                wanted = own if wanted is None else wanted | own
            found: dict[tuple[str, str], tuple[int, int]] = {}
            for r in reduce(DataFrame.unionByName, [s.terms().where(wanted) for s in self.segments]).collect():
                a, b = found.get((r["field"], r["term"]), (0, 0))
                found[r["field"], r["term"]] = a + r["doc_freq"], b + r["total_term_freq"]
            self._known.update({k: found.get(k) for k in new})
        out = {k: v for k in keys if (v := self._known.get(k)) is not None}
        if len(self._known) > KNOWN_TERMS:
            self._known.clear()
        return out

    def check_integrity(self) -> None:
        for s in self.segments:
            s.check_integrity()

    def report(self) -> dict:
        """What the index consists of."""
        fields = {}
        for name, spec in self.schema:
            c = self.collection_stats(name)
            fields[name] = {"index_options": spec.index_options.name.lower(), "norms": spec.has_norms, "doc_count": c and c.doc_count, "sum_total_term_freq": c and c.sum_total_term_freq}
        segments = [{"name": s.name, "max_doc": s.max_doc, "num_docs": s.num_docs} for s in self.segments]
        return {"generation": self.generation, "max_doc": self.max_doc, "num_docs": self.num_docs, "deleted_docs": self.num_deleted_docs, "segments": segments, "fields": fields}
