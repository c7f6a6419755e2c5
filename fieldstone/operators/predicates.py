"""Filter trees as Columns.

A filter node is ``{"predicate": {...}, "and": [...], "or": [...], "negated": bool}``
or just the predicate. It means ``(predicate AND and1 AND ...) OR or1 OR ...``;
``negated`` turns the predicate alone. SQL's three-valued logic applies.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import BOOL, DATE, FILE, FLOAT, INT, STRING, Enumeration, FieldType, Model
from fieldstone.sources.derived import element_counts
from fieldstone.sources.store import Store

_TREE_KEYS = {"predicate", "and", "or", "negated"}

_COMPARISONS = {
    "lt": lambda c, v: c < v,
    "gt": lambda c, v: c > v,
    "eq": lambda c, v: c == v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


class FilterError(ValueError):
    """A filter that does not fit the model."""


def compare(column: Column, tests: Mapping, what: str) -> Column:
    """AND of the numeric comparisons in ``tests``."""
    unknown = set(tests) - set(_COMPARISONS)
    if unknown:
        raise FilterError(f"unknown comparison {sorted(unknown)} on {what}")
    return all_of([_COMPARISONS[k](column, F.lit(v)) for k, v in tests.items()])


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def value_predicate(
    column: Column, ftype: FieldType, tests: Mapping | None, what: str, stored: T.DataType | None = None
) -> Column:
    """Predicate on one scalar: ``None`` is IS NULL, ``{}`` is IS NOT NULL."""
    if tests is None:
        return column.isNull()
    if not isinstance(tests, Mapping):
        raise FilterError(f"the predicate on {what} must be a dict or None")
    if not tests:
        return column.isNotNull()
    if isinstance(ftype, Enumeration):
        _only(tests, {"eq"}, what)
        if tests["eq"] not in ftype.values:
            raise FilterError(f"`{tests['eq']}` is not a member of `{ftype.name}`")
        return column == F.lit(tests["eq"])
    if ftype == BOOL:
        _only(tests, {"eq"}, what)
        return column == F.lit(bool(tests["eq"]))
    if ftype in (INT, FLOAT):
        return compare(column, tests, what)
    if ftype in (STRING, FILE):
        return _string_predicate(column, tests, what)
    if ftype == DATE:
        _only(tests, {"before", "after", "eq"}, what)
        return all_of([_date_test(column, k, v, stored) for k, v in tests.items()])
    raise FilterError(f"no predicate for {what}")


def _only(tests: Mapping, allowed: set[str], what: str) -> None:
    unknown = set(tests) - allowed
    if unknown:
        raise FilterError(f"unknown test {sorted(unknown)} on {what}")


def _string_predicate(column: Column, tests: Mapping, what: str) -> Column:
    _only(tests, {"length", "startsWith", "endsWith", "pattern", "eq"}, what)
    parts = []
    for test, value in tests.items():
        if test == "length":
            parts.append(compare(F.length(column), value, what))
        elif test == "startsWith":
            parts.append(column.startswith(value))
        elif test == "endsWith":
            parts.append(column.endswith(value))
        elif test == "pattern":
            parts.append(column.like(value))
        else:
            parts.append(column == F.lit(value))
    return all_of(parts)


def _instant(value: str | dt.date) -> dt.datetime:
    """A moment in UTC, without zone."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    elif not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def _date_test(column: Column, test: str, value: str | dt.date, stored: T.DataType | None) -> Column:
    moment = _instant(value)
    if isinstance(stored, T.DateType):
        # Compare whole days, so that the bound stays a literal the scan can use.
        day, midnight = F.lit(moment.date()), moment.time() == dt.time()
        if test == "after":
            return column > day
        if test == "before":
            return column < day if midnight else column <= day
        return column == day if midnight else F.when(column.isNotNull(), F.lit(False))
    if isinstance(stored, T.TimestampType):
        bound = F.lit(moment.replace(tzinfo=dt.timezone.utc))
    else:
        bound = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    return {"after": column > bound, "before": column < bound, "eq": column == bound}[test]


class _Joined:
    """A model's frame plus the joins its filter needs, one per reference path."""

    def __init__(self, store: Store, model: Model, df: DataFrame):
        self.store = store
        self.df = df
        self.models: dict[tuple, Model] = {(): model}
        self.types: dict[str, T.DataType] = {f.name: f.dataType for f in df.schema}
        self.lengths: set[str] = set()

    def name(self, path: tuple, field: str) -> str:
        return field if not path else f"__{'.'.join(path)}.{field}"

    def column(self, path: tuple, field: str) -> tuple[Column, T.DataType]:
        name = self.name(path, field)
        return F.col(f"`{name}`"), self.types.get(name)

    def reference(self, path: tuple, field: str) -> tuple:
        """Join the model that ``field`` points at; the parent row always stays."""
        inner = (*path, field)
        if inner not in self.models:
            target = self.store.catalog.model(self.models[path].field(field).ref_model)
            right = self.store.scan(target.name)
            right = right.select(*[F.col(c).alias(self.name(inner, c)) for c in right.columns])
            self.types.update({f.name: f.dataType for f in right.schema})
            on = F.col(f"`{self.name(path, field)}`") == F.col(f"`{self.name(inner, target.pk)}`")
            self.df = self.df.join(right, on, "left")
            self.models[inner] = target
        return inner

    def length(self, path: tuple, field: str) -> Column:
        """Element count of an array, 0 when it has no links."""
        name = self.name((*path, field), "length")
        if name not in self.lengths:
            model = self.models[path]
            counts = array_length(self.store, model.name, field).select(
                F.col("source").alias(f"{name}.source"), F.col("length").alias(name)
            )
            on = F.col(f"`{self.name(path, model.pk)}`") == F.col(f"`{name}.source`")
            self.df = self.df.join(counts, on, "left")
            self.lengths.add(name)
        return F.coalesce(F.col(f"`{name}`"), F.lit(0).cast("bigint"))


def array_length(store: Store, model: str, field: str) -> DataFrame:
    """Elements per parent (``source``, ``length``); parents without elements are absent."""
    known = element_counts(store, model, field)
    if known is not None:
        return known
    return store.links(model, field).groupBy("source").agg(F.count("*").alias("length"))


def model_predicate(joined: _Joined, path: tuple, tests: Mapping) -> Column:
    """AND over the fields named in ``tests``; an empty dict is true."""
    if not isinstance(tests, Mapping):
        raise FilterError("a model predicate must be a dict")
    model, parts = joined.models[path], []
    for name, test in tests.items():
        f = model.field(name)
        what = f"`{model.name}.{name}`"
        if f.secret_credential:
            raise FilterError(f"{what} is secret")
        if f.is_array:
            if not isinstance(test, Mapping) or set(test) != {"length"}:
                raise FilterError(f"{what} takes only a `length` predicate")
            parts.append(compare(joined.length(path, name), test["length"], what))
        elif f.is_ref and test:
            parts.append(model_predicate(joined, joined.reference(path, name), test))
        else:
            column, stored = joined.column(path, name)
            parts.append(value_predicate(column, f.type, test, what, stored))
    return all_of(parts)


def _node(tests, leaf) -> Column:
    if isinstance(tests, Mapping) and tests and set(tests) <= _TREE_KEYS:
        # Nothing stated is true.
        predicate = leaf(tests["predicate"]) if "predicate" in tests else F.lit(True)
        if tests.get("negated"):
            predicate = ~predicate
        left = all_of([predicate, *[_node(t, leaf) for t in tests.get("and") or []]])
        return reduce(or_, [left, *[_node(t, leaf) for t in tests.get("or") or []]])
    return leaf(tests)


def _as_list(filters) -> list:
    if filters is None:
        return []
    return [filters] if isinstance(filters, Mapping) else list(filters)


def filter_model(store: Store, model: str, df: DataFrame, filters) -> DataFrame:
    """Rows of a frame with the model's columns that pass every filter in the list."""
    filters = _as_list(filters)
    if not filters:
        return df
    m = store.catalog.model(model)
    joined = _Joined(store, m, df)
    condition = all_of([_node(f, lambda t: model_predicate(joined, (), t)) for f in filters])
    return joined.df.where(condition).select(*[F.col(f"`{c}`") for c in df.columns])


def filter_values(df: DataFrame, column: str, ftype: FieldType, filters) -> DataFrame:
    """Elements of a primitive array that pass every filter in the list."""
    filters = _as_list(filters)
    if not filters:
        return df
    stored = df.schema[column].dataType
    leaf = lambda t: value_predicate(F.col(column), ftype, t, f"`{column}`", stored)
    return df.where(all_of([_node(f, leaf) for f in filters]))
