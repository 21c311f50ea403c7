"""Single documents, for callers that have no DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from lodestone.errors import IllegalArgument
from lodestone.schema import FieldSpec, IndexSchema, check_doc_value

Value = str | bytes | int | float


@dataclass(frozen=True)
class Term:
    """A term of a field, the unit of indexing."""

    field: str
    text: str

    @classmethod
    def from_bytes(cls, field: str, data: bytes) -> Term:
        """Terms are UTF-8; other bytes are no term of any document."""
        try:
            return cls(field, data.decode())
        except UnicodeDecodeError as e:
            raise IllegalArgument(f"a term of {field} isn't UTF-8") from e


@dataclass(frozen=True)
class Field:
    name: str
    value: Value
    spec: FieldSpec

    def as_str(self) -> str | None:
        return self.value if isinstance(self.value, str) else None

    def as_bytes(self) -> bytes | None:
        return self.value if isinstance(self.value, bytes) else None

    def as_i64(self) -> int | None:
        return self.value if isinstance(self.value, int) and not isinstance(self.value, bool) else None

    def as_f64(self) -> float | None:
        return self.value if isinstance(self.value, float) else None

    def size(self) -> int:
        """About how many bytes the value takes up."""
        return len(self.value) if isinstance(self.value, str | bytes) else 8

    @classmethod
    def text(cls, name: str, value: str, stored: bool = False) -> Field:
        return cls(name, value, FieldSpec.text(stored))

    @classmethod
    def string(cls, name: str, value: str, stored: bool = False) -> Field:
        return cls(name, value, FieldSpec.string(stored))

    @classmethod
    def stored_only(cls, name: str, value: Value) -> Field:
        return cls(name, value, FieldSpec.stored_only())

    @classmethod
    def numeric_i64(cls, name: str, value: int, stored: bool = False) -> Field:
        return cls(name, value, FieldSpec.numeric_i64(stored))

    @classmethod
    def numeric_f64(cls, name: str, value: float, stored: bool = False) -> Field:
        return cls(name, value, FieldSpec.numeric_f64(stored))

    @classmethod
    def sorted_keyword(cls, name: str, value: str, stored: bool = False) -> Field:
        return cls(name, value, FieldSpec.sorted_keyword(stored))


@dataclass
class Document:
    """An ordered list of fields; a name may come more than once."""

    fields: list[Field] = field(default_factory=list)

    def add(self, one: Field) -> Document:
        self.fields.append(one)
        return self

    def __len__(self) -> int:
        return len(self.fields)

    @property
    def is_empty(self) -> bool:
        return not self.fields

    def size(self) -> int:
        """About how many bytes the values take up."""
        return sum(f.size() for f in self.fields)

    def __iter__(self) -> Iterator[Field]:
        return iter(self.fields)

    def get(self, name: str) -> Value | None:
        """The first value of a field."""
        return next((f.value for f in self.fields if f.name == name), None)

    def get_str(self, name: str) -> str | None:
        value = self.get(name)
        return value if isinstance(value, str) else None

    def get_all(self, name: str) -> list[Value]:
        return [f.value for f in self.fields if f.name == name]

    def schema(self, known: IndexSchema) -> IndexSchema:
        """``known`` with this document's fields; a document that contradicts it or itself is refused as a whole."""
        seen, out = set(), known
        for f in self.fields:
            if f.spec.doc_values:
                check_doc_value(f.name, f.value, f.spec.doc_values)
                if f.name in seen:
                    raise IllegalArgument(f"duplicate doc value: {f.name}")
                seen.add(f.name)
            if f.spec.indexed and not isinstance(f.value, str):
                raise IllegalArgument(f'field "{f.name}": only text values can be indexed')
            out = out.merged(IndexSchema({f.name: f.spec}))
        return out
