"""How fields are indexed, stored and sorted, and the schema of an index."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace
from enum import Enum, IntEnum

from pyspark.sql import types as T

from lodestone.errors import IllegalArgument


#: Columns of the index's own tables.
RESERVED = frozenset(("doc", "score", "_doc", "_mid", "_seg", "_old", "_row"))


class IndexOptions(IntEnum):
    """What the postings of a field keep, each level with all below it."""

    NONE = 0
    DOCS = 1
    FREQS = 2
    POSITIONS = 3


class DocValues(str, Enum):
    """Types of single-valued columns for ranges and sorts."""

    I64 = "i64"
    F64 = "f64"
    KEYWORD = "keyword"


@dataclass(frozen=True)
class FieldSpec:
    """One field's configuration; see the presets below."""

    index_options: IndexOptions = IndexOptions.NONE
    tokenized: bool = False
    stored: bool = True
    omit_norms: bool = True
    doc_values: DocValues | None = None

    @property
    def indexed(self) -> bool:
        return self.index_options != IndexOptions.NONE

    @property
    def has_norms(self) -> bool:
        return self.indexed and not self.omit_norms

    @classmethod
    def text(cls, stored: bool = False) -> FieldSpec:
        """Full text: tokens with frequencies, positions and length norms."""
        return cls(IndexOptions.POSITIONS, True, stored, False)

    @classmethod
    def string(cls, stored: bool = False) -> FieldSpec:
        """The whole value as one exact term."""
        return cls(IndexOptions.DOCS, False, stored, True)

    @classmethod
    def stored_only(cls) -> FieldSpec:
        return cls()

    @classmethod
    def numeric_i64(cls, stored: bool = False) -> FieldSpec:
        return cls(stored=stored, doc_values=DocValues.I64)

    @classmethod
    def numeric_f64(cls, stored: bool = False) -> FieldSpec:
        return cls(stored=stored, doc_values=DocValues.F64)

    @classmethod
    def sorted_keyword(cls, stored: bool = False) -> FieldSpec:
        """An exact term that can be sorted by, too."""
        return replace(cls.string(stored), doc_values=DocValues.KEYWORD)

    def with_stored(self, stored: bool = True) -> FieldSpec:
        return replace(self, stored=stored)

    def with_index_options(self, options: IndexOptions) -> FieldSpec:
        return replace(self, index_options=options)

    def with_omit_norms(self, omit: bool = True) -> FieldSpec:
        return replace(self, omit_norms=omit)

    def check(self, name: str) -> None:
        if not (self.indexed or self.stored or self.doc_values):
            raise IllegalArgument(f'field "{name}" is neither indexed nor stored nor a doc value')

    def merged(self, name: str, other: FieldSpec) -> FieldSpec:
        """This spec after another use of the name; uses that contradict are refused."""
        if self.doc_values and other.doc_values and self.doc_values != other.doc_values:
            raise IllegalArgument(f"cannot change doc values type of {name}")
        if self.indexed and other.indexed and (self.index_options != other.index_options or self.has_norms != other.has_norms):
            raise IllegalArgument(f"cannot change how field {name} is indexed")
        first = self if self.indexed or not other.indexed else other
        return replace(first, stored=self.stored or other.stored, doc_values=self.doc_values or other.doc_values)


#: Spark types a doc-values column may come in.
_COLUMN = {DocValues.I64: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), DocValues.F64: (T.FloatType, T.DoubleType), DocValues.KEYWORD: (T.StringType,)}


@dataclass(frozen=True)
class IndexSchema:
    """The fields of an index, by name, in the order of first use."""

    fields: dict[str, FieldSpec] = field(default_factory=dict)

    def __post_init__(self):
        for name, spec in self.fields.items():
            spec.check(name)
            if name in RESERVED:
                raise IllegalArgument(f"{name} is a name the index uses itself")

    def __len__(self) -> int:
        return len(self.fields)

    def __iter__(self):
        return iter(self.fields.items())

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    def get(self, name: str) -> FieldSpec | None:
        return self.fields.get(name)

    def by_number(self, number: int) -> tuple[str, FieldSpec] | None:
        return dict(enumerate(self.fields.items())).get(number)

    def merged(self, other: IndexSchema) -> IndexSchema:
        out = dict(self.fields)
        for name, spec in other.fields.items():
            spec.check(name)
            out[name] = out[name].merged(name, spec) if name in out else spec
        return IndexSchema(out)

    def check_columns(self, schema: T.StructType) -> None:
        """Refuses a DataFrame whose columns can't hold what the fields need."""
        for name, spec in self.fields.items():
            if name not in schema.fieldNames():
                continue
            kind = schema[name].dataType
            if spec.doc_values and not isinstance(kind, _COLUMN[spec.doc_values]):
                raise IllegalArgument(f"doc value {name} is {kind.simpleString()}, not one {spec.doc_values.value}")
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if spec.indexed and not isinstance(inner, T.StringType):
                raise IllegalArgument(f'field "{name}": only text values can be indexed')

    def to_json(self) -> dict:
        return {n: {**asdict(s), "index_options": int(s.index_options), "doc_values": s.doc_values and s.doc_values.value} for n, s in self.fields.items()}

    @classmethod
    def from_json(cls, data: dict) -> IndexSchema:
        return cls({n: FieldSpec(**{**d, "index_options": IndexOptions(d["index_options"]), "doc_values": d["doc_values"] and DocValues(d["doc_values"])}) for n, d in data.items()})


def check_doc_value(name: str, value: object, kind: DocValues) -> None:
    """Refuses a Python value that a doc-values column of ``kind`` can't hold."""
    good = {
        DocValues.I64: isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63,
        DocValues.F64: isinstance(value, float) and math.isfinite(value),
        DocValues.KEYWORD: isinstance(value, str),
    }[kind]
    if not good:
        raise IllegalArgument(f"{value!r} is no {kind.value} value of {name}")
