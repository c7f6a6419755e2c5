"""Models, fields and enums as Python objects.

A definition is checked when it is constructed. Models and fields are matched
between versions by their index; names may change.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field as dc_field, replace
from typing import Any

from pyspark.sql import types as T


class DefinitionError(ValueError):
    """A model, field or enum definition that cannot be used."""


@dataclass(frozen=True)
class Primitive:
    name: str


STRING = Primitive("String")
INT = Primitive("Int")
FLOAT = Primitive("Float")
BOOL = Primitive("Boolean")
DATE = Primitive("Date")
FILE = Primitive("File")

_SPARK = {
    STRING: T.StringType(),
    INT: T.LongType(),
    FLOAT: T.DoubleType(),
    BOOL: T.BooleanType(),
    DATE: T.DateType(),
    FILE: T.StringType(),
}


@dataclass(frozen=True)
class Enumeration:
    name: str
    values: tuple[str, ...]

    def __post_init__(self):
        if not self.values or len(set(self.values)) != len(self.values):
            raise DefinitionError(f"enum `{self.name}` needs distinct members")


@dataclass(frozen=True)
class Ref:
    """A to-one reference, stored as the other model's primary key."""

    model: str


@dataclass(frozen=True)
class ArrayOf:
    """Many values or many references, stored as a link table (source, target)."""

    of: Primitive | Enumeration | Ref

    def __post_init__(self):
        if isinstance(self.of, ArrayOf):
            raise DefinitionError("arrays cannot be nested")


FieldType = Primitive | Enumeration | Ref | ArrayOf


class _Missing:
    def __repr__(self):
        return "MISSING"

    def __reduce__(self):
        return "MISSING"


MISSING = _Missing()


def _fits(value: Any, ftype: FieldType, optional: bool) -> bool:
    if value is None:
        return optional
    if isinstance(ftype, Enumeration):
        return value in ftype.values
    if isinstance(ftype, ArrayOf):
        return isinstance(value, (list, tuple)) and all(_fits(v, ftype.of, False) for v in value)
    if ftype == INT:
        return isinstance(value, int) and not isinstance(value, bool)
    if ftype == FLOAT:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if ftype == BOOL:
        return isinstance(value, bool)
    if ftype == DATE:
        return isinstance(value, (str, dt.date))
    if ftype in (STRING, FILE):
        return isinstance(value, str)
    return False


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    index: int
    optional: bool = False
    default: Any = MISSING
    primary: bool = False
    unique: bool = False
    uuid: bool = False
    auto_increment: bool = False
    public_credential: bool = False
    secret_credential: bool = False

    def __post_init__(self):
        def bad(reason):
            raise DefinitionError(f"field `{self.name}`: {reason}")

        if self.index < 1:
            bad("the index must be positive")
        if self.optional and self.is_array:
            bad("an array cannot be optional")
        if self.has_default and not _fits(self.default, self.type, self.optional):
            bad(f"the default {self.default!r} does not fit its type")
        if self.primary and (self.optional or self.type not in (INT, STRING)):
            bad("a primary field must be a required Int or String")
        if self.uuid and self.type != STRING:
            bad("only a String can be a uuid")
        if self.auto_increment and self.type != INT:
            bad("only an Int can auto-increment")
        if (self.public_credential or self.secret_credential) and self.type not in (STRING, INT):
            bad("a credential must be a String or an Int")

    @property
    def has_default(self) -> bool:
        return not isinstance(self.default, _Missing)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, ArrayOf)

    @property
    def is_ref(self) -> bool:
        return isinstance(self.type, Ref)

    @property
    def is_ref_array(self) -> bool:
        return self.is_array and isinstance(self.type.of, Ref)

    @property
    def ref_model(self) -> str | None:
        inner = self.type.of if self.is_array else self.type
        return inner.model if isinstance(inner, Ref) else None

    @property
    def is_unique(self) -> bool:
        return self.unique or self.public_credential

    @property
    def generated(self) -> bool:
        """Can a value be produced for a record that has none?"""
        return self.optional or self.is_array or self.has_default or self.uuid or self.auto_increment

    @property
    def directives(self) -> list[str]:
        names = ("primary", "unique", "uuid", "auto_increment", "public_credential", "secret_credential")
        return [n for n in names if getattr(self, n)]


Hook = str | Callable


@dataclass(frozen=True)
class Model:
    name: str
    index: int
    fields: tuple[Field, ...]
    user: bool = False
    on_read: tuple[Hook, ...] = ()
    on_write: tuple[Hook, ...] = ()
    on_delete: tuple[Hook, ...] = ()

    def __post_init__(self):
        for attr in ("fields", "on_read", "on_write", "on_delete"):
            object.__setattr__(self, attr, tuple(getattr(self, attr)))

        def bad(reason):
            raise DefinitionError(f"model `{self.name}`: {reason}")

        if self.index < 1:
            bad("the index must be positive")
        for what in ("name", "index"):
            seen = [getattr(f, what) for f in self.fields]
            if len(set(seen)) != len(seen):
                bad(f"two fields share one {what}")
        if sum(f.primary for f in self.fields) != 1:
            bad("exactly one field must be primary")
        if sum(f.secret_credential for f in self.fields) > 1:
            bad("only one field can be the secret credential")
        if not self.user and any(f.public_credential or f.secret_credential for f in self.fields):
            bad("credentials need a user model")

    @property
    def primary(self) -> Field:
        return next(f for f in self.fields if f.primary)

    @property
    def pk(self) -> str:
        return self.primary.name

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise DefinitionError(f"`{name}` is not a field of `{self.name}`")

    def by_index(self, index: int) -> Field | None:
        return next((f for f in self.fields if f.index == index), None)

    @property
    def stored(self) -> list[Field]:
        """Fields that are columns of the model's own table."""
        return [f for f in self.fields if not f.is_array]

    @property
    def refs(self) -> list[Field]:
        return [f for f in self.fields if f.is_ref]

    @property
    def arrays(self) -> list[Field]:
        return [f for f in self.fields if f.is_array]

    @property
    def public_credentials(self) -> list[Field]:
        return [f for f in self.fields if f.public_credential]

    @property
    def secret(self) -> Field | None:
        return next((f for f in self.fields if f.secret_credential), None)

    def with_field(self, new: Field) -> Model:
        """Replace the field of the same index, or append."""
        if self.by_index(new.index) is None:
            return replace(self, fields=(*self.fields, new))
        return replace(self, fields=tuple(new if f.index == new.index else f for f in self.fields))

    def without_field(self, name: str) -> Model:
        return replace(self, fields=tuple(f for f in self.fields if f.name != name))


@dataclass(frozen=True)
class Catalog:
    models: tuple[Model, ...] = dc_field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "models", tuple(self.models))
        for what in ("name", "index"):
            seen = [getattr(m, what) for m in self.models]
            if len(set(seen)) != len(seen):
                raise DefinitionError(f"two models share one {what}")
        names = {m.name for m in self.models}
        for m in self.models:
            for f in m.fields:
                if f.ref_model is not None and f.ref_model not in names:
                    raise DefinitionError(f"`{m.name}.{f.name}`: model `{f.ref_model}` is not defined")

    def has(self, name: str) -> bool:
        return any(m.name == name for m in self.models)

    def model(self, name: str) -> Model:
        for m in self.models:
            if m.name == name:
                return m
        raise DefinitionError(f"model `{name}` is not defined")

    def by_index(self, index: int) -> Model | None:
        return next((m for m in self.models if m.index == index), None)

    def with_model(self, new: Model) -> Catalog:
        if self.by_index(new.index) is None:
            return Catalog((*self.models, new))
        return Catalog(tuple(new if m.index == new.index else m for m in self.models))

    def value_type(self, ftype: FieldType) -> T.DataType:
        """Spark type of a stored value (a reference has its target key's type)."""
        if isinstance(ftype, Ref):
            return self.value_type(self.model(ftype.model).primary.type)
        if isinstance(ftype, Enumeration):
            return T.StringType()
        if isinstance(ftype, ArrayOf):
            return T.ArrayType(self.value_type(ftype.of), containsNull=False)
        return _SPARK[ftype]

    def struct(self, name: str, arrays: bool = False, fields: Iterable[str] | None = None) -> T.StructType:
        """Schema of a model table; ``arrays=True`` gives the shape of an input record."""
        model = self.model(name)
        wanted = set(fields) if fields is not None else None
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    self.value_type(f.type),
                    nullable=f.optional,
                    metadata={"index": f.index, "directives": f.directives},
                )
                for f in model.fields
                if (arrays or not f.is_array) and (wanted is None or f.name in wanted)
            ]
        )

    def link_struct(self, model: str, field: str) -> T.StructType:
        m = self.model(model)
        return T.StructType(
            [
                T.StructField("source", self.value_type(m.primary.type), False),
                T.StructField("target", self.value_type(m.field(field).type.of), False),
            ]
        )

    def referrers(self, name: str) -> list[tuple[Model, Field]]:
        """To-one fields anywhere in the catalog that point at ``name``."""
        return [(m, f) for m in self.models for f in m.refs if f.ref_model == name]

    def links_touching(self, name: str) -> list[tuple[Model, Field, str]]:
        """Link tables with ``name`` at one end, and which end."""
        out = []
        for m in self.models:
            for f in m.arrays:
                if m.name == name:
                    out.append((m, f, "source"))
                if f.is_ref_array and f.ref_model == name:
                    out.append((m, f, "target"))
        return out

    def to_dict(self) -> dict:
        """Plain form of the definition, as kept in the version history (hooks by name)."""

        def type_of(t):
            if isinstance(t, ArrayOf):
                return {"array": type_of(t.of)}
            if isinstance(t, Ref):
                return {"ref": t.model}
            if isinstance(t, Enumeration):
                return {"enum": t.name, "values": list(t.values)}
            return t.name

        def hooks(items):
            return [h if isinstance(h, str) else getattr(h, "__name__", "function") for h in items]

        def field_of(f):
            out = {"name": f.name, "index": f.index, "type": type_of(f.type), "optional": f.optional}
            out["directives"] = f.directives
            if f.has_default:
                out["default"] = f.default if not isinstance(f.default, dt.date) else f.default.isoformat()
            return out

        return {
            "models": [
                {
                    "name": m.name,
                    "index": m.index,
                    "user": m.user,
                    "on_read": hooks(m.on_read),
                    "on_write": hooks(m.on_write),
                    "on_delete": hooks(m.on_delete),
                    "fields": [field_of(f) for f in m.fields],
                }
                for m in self.models
            ]
        }

    @staticmethod
    def from_dict(data: dict) -> Catalog:
        primitives = {p.name: p for p in _SPARK}

        def type_of(t):
            if isinstance(t, str):
                return primitives[t]
            if "array" in t:
                return ArrayOf(type_of(t["array"]))
            if "ref" in t:
                return Ref(t["ref"])
            return Enumeration(t["enum"], tuple(t["values"]))

        return Catalog(
            tuple(
                Model(
                    m["name"],
                    m["index"],
                    tuple(
                        Field(
                            f["name"],
                            type_of(f["type"]),
                            f["index"],
                            optional=f["optional"],
                            default=f.get("default", MISSING),
                            **{d: True for d in f["directives"]},
                        )
                        for f in m["fields"]
                    ),
                    user=m["user"],
                    on_read=tuple(m["on_read"]),
                    on_write=tuple(m["on_write"]),
                    on_delete=tuple(m["on_delete"]),
                )
                for m in data["models"]
            )
        )
