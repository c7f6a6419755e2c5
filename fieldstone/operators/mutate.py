"""Creates, patches, deletes and array pushes as table transformations.

Every operation is a batch: it takes records as a DataFrame and returns the new
frames of all tables it touches. The single-record forms are batches of one row.

Special input columns
    ``_present``  array of the field names a record really supplies (absent is not null)
    ``_ord``      position of a record in the batch; later ones win, numbering follows it
    ``_key``      key of the record to patch, when the patch also sets a new primary key
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import DATE, DefinitionError, Enumeration, Field, Model
from fieldstone.functions.joins import fits_broadcast, rows_without, written_side
from fieldstone.functions.numbering import dense_ids, number_rows
from fieldstone.functions.registry import apply_hooks
from fieldstone.functions.secrets import hash_secret, too_long
from fieldstone.operators.quality import dangling, ensure, enum_violations, required_violations, violation_rows
from fieldstone.operators.query import Result, next_key, read_many
from fieldstone.session import checkpointed, local_frame
from fieldstone.sources.json_records import PRESENT
from fieldstone.sources.files import Edit, Touch, folder_of
from fieldstone.sources.history import remove_folders
from fieldstone.sources.store import Changes, LinkKey, Store

ORDER, KEY = "_ord", "_key"
_CONTROL = {PRESENT, ORDER, KEY}
_SOURCE = "__source"


class EmptyRecord(ValueError):
    """A record that supplies no field."""


class _Work:
    """The store as it becomes, with the rows that changed and the checks they need.

    The batch is written once, because several plans read it. If it fits a
    broadcast, so does everything derived from it, and the stored tables are
    never shuffled for it.
    """

    def __init__(self, store: Store, batch: DataFrame, local: bool = False):
        # A local batch is a few rows that came from the driver.
        self.batch = batch if local else checkpointed(batch)
        self.small = local or fits_broadcast(self.batch)
        self.before = store
        self.store = store
        self.tables: dict[str, DataFrame] = {}
        self.links: dict[LinkKey, DataFrame] = {}
        # Model, changed rows and the fields whose values came from outside.
        self.changed: list[tuple[str, DataFrame, set[str]]] = []
        self.new_links: list[tuple[LinkKey, DataFrame, frozenset[str]]] = []
        self.violations: list[DataFrame] = []
        self.edits: dict[str, list[Edit]] = {}
        self.marks: list[DataFrame] = []
        self.sequences: dict = {}

    def near(self, df: DataFrame) -> DataFrame:
        """A frame derived from the batch, as the side of a join."""
        return F.broadcast(df) if self.small else df

    def missing(self, rows: DataFrame, column: Column, keys: DataFrame) -> DataFrame:
        return rows_without(rows, column, keys, self.small)

    def edit_table(self, model: str, apply: Callable[[DataFrame], DataFrame], *touches: Touch, adds: bool = False) -> None:
        """Change a model's table: ``apply`` makes new rows of old ones, and only of those in ``touches``."""
        df = self.tables[model] = apply(self.store.scan(model))
        self._edited(model, Changes({model: df}), Edit(apply, touches, adds))

    def edit_links(self, key: LinkKey, apply: Callable[[DataFrame], DataFrame], *touches: Touch, adds: bool = False) -> None:
        df = self.links[key] = apply(self.store.links(*key))
        self._edited(".".join(key), Changes(links={key: df}), Edit(apply, touches, adds))

    def _edited(self, name: str, changes: Changes, edit: Edit) -> None:
        self.edits.setdefault(name, []).append(edit)
        changes.edits[name] = [edit]
        self.store = self.store.apply(changes)

    def mark(self, kind: str, model: str, field: str, df: DataFrame, column: Column) -> None:
        """Note values that the operation changes or relies on, for writers that work at the same time."""
        if self.store.path is not None:
            rows = df.where(column.isNotNull())
            self.marks.append(
                rows.select(F.lit(f"{model}.{field}").alias("name"), column.cast("string").alias("value"), F.lit(kind).alias("kind"))
            )

    def mark_rows(self, kind: str, m: Model, rows: DataFrame, fields: set[str]) -> None:
        """Note records that are there from now on, or have new values in the fields."""
        self.mark(kind, m.name, m.pk, rows, F.col(f"`{m.pk}`"))
        for f in m.stored:
            if f.name in fields and f.is_unique and not f.primary:
                self.mark("exists", m.name, f.name, rows, F.col(f"`{f.name}`"))
            if f.name in fields and f.is_ref:
                target = self.store.catalog.model(f.ref_model)
                self.mark("read", target.name, target.pk, rows, F.col(f"`{f.name}`"))

    def use_numbers(self, m: Model, f: Field, mark) -> None:
        """Set the highest number ever used (or how to find it)."""
        name = f"{m.name}.{f.name}"
        self.sequences[name] = mark
        self.store = self.store.apply(Changes(sequences={name: mark}))

    def add_links(self, key: LinkKey, links: DataFrame, unchecked: frozenset[str] = frozenset()) -> None:
        """Append links; ends in ``unchecked`` exist by construction."""
        schema = self.store.catalog.link_struct(*key)
        links = links.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        self.new_links.append((key, links, unchecked))
        self.edit_links(key, lambda base: base.unionByName(links), adds=True)
        model, f = self.store.catalog.model(key[0]), self.store.catalog.model(key[0]).field(key[1])
        self.mark("adds", *key, links, F.col("source"))
        if "source" not in unchecked:
            self.mark("read", model.name, model.pk, links, F.col("source"))
        if "target" not in unchecked and f.is_ref_array:
            target = self.store.catalog.model(f.ref_model)
            self.mark("read", target.name, target.pk, links, F.col("target"))

    def finish(self, check: bool, result=None) -> Changes:
        if check:
            found = [*self.violations]
            for model, rows, fields in self.changed:
                found += _row_violations(self, model, rows, fields)
            for key, links, unchecked in self.new_links:
                found += _link_violations(self, key, links, unchecked)
            if found:
                ensure(reduce(DataFrame.unionByName, found))
        return Changes(self.tables, self.links, result, self.edits, self.marks, self.sequences)


def _row_violations(work: _Work, model: str, rows: DataFrame, fields: set[str]) -> list[DataFrame]:
    """Constraint checks on the changed rows alone; the table is only probed by key.

    Defaults and nulls need no look at other tables, so references and members
    are checked for the supplied ``fields`` only.
    """
    store = work.store
    m = store.catalog.model(model)
    found = [required_violations(rows, m)]
    found.append(violation_rows(rows.where(F.col(m.pk).isNull()), model, m.pk, "primary_missing", F.lit(None), F.lit(None)))
    for f in m.stored:
        column = F.col(f"`{f.name}`")
        if (f.primary and not f.uuid or f.is_unique) and (f.name in fields or f.has_default):
            values = rows.where(column.isNotNull()).select(column.alias("__value"))
            same = _same_values(work, model, f, values)
            twice = same.groupBy(f.name).agg(F.count("*").alias("__n")).where("__n > 1")
            rule = "primary_duplicate" if f.primary else "unique"
            found.append(violation_rows(twice, model, f.name, rule, F.lit(None), column))
        if f.is_ref and f.name in fields:
            target = store.catalog.model(f.ref_model)
            keys = store.scan(target.name, [target.pk])
            found.append(
                dangling(rows, f.name, keys, model, f.name, F.col(f"`{m.pk}`"), "reference", work.small)
            )
        if isinstance(f.type, Enumeration) and f.name in fields:
            found.append(enum_violations(rows, model, m.pk, f.name, f.type, f.name))
    return found


# Values of a batch that are looked for by their bloom filters, and as many as Spark sends to one.
_PROBED, _AT_ONCE = 500, 10


def _same_values(work: _Work, model: str, f: Field, values: DataFrame) -> DataFrame:
    """Rows of the model whose field has one of the values. A few values go into the scan of a stored table as
    literals, so that files and row groups whose ranges and bloom filters exclude them are not read."""
    column = F.col(f"`{f.name}`")
    rows = work.store.scan(model, [f.name])
    if work.small and model in work.before.locations:
        few = values.distinct().take(_PROBED + 1)
        if len(few) <= _PROBED:
            chunks = [few[i : i + _AT_ONCE] for i in range(0, len(few), _AT_ONCE)]
            tests = [column.isin([r["__value"] for r in chunk]) for chunk in chunks]
            return rows.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    return rows.join(work.near(values), column == F.col("__value"), "left_semi")


def _link_violations(
    work: _Work, key: LinkKey, links: DataFrame, unchecked: frozenset[str]
) -> list[DataFrame]:
    store, (model, field) = work.store, key
    m = store.catalog.model(model)
    f = m.field(field)
    found = []
    if "source" not in unchecked:
        own = store.scan(model, [m.pk])
        found.append(dangling(links, "source", own, model, field, F.col("source"), "link_source", work.small))
    if "target" in unchecked:
        return found
    if f.is_ref_array:
        target = store.catalog.model(f.ref_model)
        keys = store.scan(target.name, [target.pk])
        found.append(dangling(links, "target", keys, model, field, F.col("source"), "link_target", work.small))
    elif isinstance(f.type.of, Enumeration):
        found.append(enum_violations(links, model, "source", "target", f.type.of, field))
    return found


# -- input records -----------------------------------------------------------


def _check_columns(m: Model, df: DataFrame) -> None:
    for c in df.columns:
        if c not in _CONTROL and not c.startswith("__"):
            m.field(c)


def _present(df: DataFrame, name: str) -> Column:
    """Does the record supply the field?"""
    if name not in df.columns:
        return F.lit(False)
    return F.array_contains(PRESENT, name) if PRESENT in df.columns else F.lit(True)


def _struct_of(df: DataFrame, name: str) -> T.StructType | None:
    """Type of the object(s) in a nested column, None when it holds plain values."""
    dtype = df.schema[name].dataType if name in df.columns else None
    if isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype if isinstance(dtype, T.StructType) else None


def _supplied(struct: T.StructType, value: Column) -> Column:
    """Names of the fields that a nested object supplies; without ``_present``, its non-null ones."""
    if PRESENT in struct.names:
        return value[PRESENT]
    return F.array_compact(F.array(*[F.when(value[n].isNotNull(), F.lit(n)) for n in struct.names]))


def _only_key(struct: T.StructType, value: Column, pk: str) -> Column:
    """Does a nested object merely name an existing record?"""
    if set(struct.names) - {PRESENT} == {pk}:
        return value.isNotNull()
    return value.isNotNull() & (F.size(F.array_except(_supplied(struct, value), F.array(F.lit(pk)))) == 0)


def _unpack(df: DataFrame, struct: T.StructType, column: str, *extra: Column) -> DataFrame:
    """Nested objects as records of their own."""
    value = F.col(f"`{column}`")
    names = [n for n in struct.names if n != PRESENT]
    return df.select(
        *[value[n].alias(n) for n in names], _supplied(struct, value).alias(PRESENT), *extra
    )


def _typed(catalog, f: Field, value):
    """Schema and value of one entry of a record given as a dict."""
    shape = _shape(catalog, f, [value])
    return shape, _fitted(catalog, f, shape, value)


def _shape(catalog, f: Field, values: list) -> T.DataType:
    """A type that holds every one of the values: objects with all fields that any of them has.
    Beside objects, a bare key counts as an object with just the key."""
    if f.ref_model is None:
        return catalog.value_type(f.type)
    child = catalog.model(f.ref_model)
    items = [v for value in values for v in (value or [] if f.is_array else [value]) if v is not None]
    if any(isinstance(v, Mapping) for v in items):
        objects = [_object(child, v) for v in items]
        for name in {n for o in objects for n in o}:
            child.field(name)
        names = [c.name for c in child.fields if any(c.name in o for o in objects)]
        dtype = T.StructType(
            [T.StructField(n, _shape(catalog, child.field(n), [o[n] for o in objects if n in o])) for n in names]
            + [T.StructField(PRESENT, T.ArrayType(T.StringType()))]
        )
    else:
        dtype = catalog.value_type(child.primary.type)
    return T.ArrayType(dtype) if f.is_array else dtype


def _object(child: Model, value) -> Mapping:
    return value if isinstance(value, Mapping) else {child.pk: value}


def _fitted(catalog, f: Field, shape: T.DataType, value):
    """A value in the given shape."""
    if f.ref_model is None:
        if f.type == DATE and isinstance(value, str):
            return dt.datetime.fromisoformat(value.replace("Z", "+00:00")).date()
        return value
    child = catalog.model(f.ref_model)

    def one(dtype: T.DataType, item):
        if item is None or not isinstance(dtype, T.StructType):
            return item
        given = _object(child, item)
        fields = [s for s in dtype if s.name != PRESENT]
        return (*[_fitted(catalog, child.field(s.name), s.dataType, given.get(s.name)) for s in fields], list(given))

    return [one(shape.elementType, item) for item in value or []] if f.is_array else one(shape, value)


def frame(store: Store, model: str, record: Mapping) -> DataFrame:
    """A one-row frame for a record given as a dict; its keys are what it supplies."""
    m = store.catalog.model(model)
    typed = {n: _typed(store.catalog, m.field(n), v) for n, v in record.items()}
    schema = T.StructType([T.StructField(n, t) for n, (t, _) in typed.items()])
    return local_frame(store.spark, [tuple(v for _, v in typed.values())], schema)


# -- create ------------------------------------------------------------------


def create(store: Store, model: str, record: Mapping, select=None, check: bool = True) -> Changes:
    if not record:
        raise EmptyRecord(f"cannot create an empty record of `{model}`")
    return _create(store, model, frame(store, model, record), select, check, local=True)


def create_many(store: Store, model: str, records: DataFrame, select=None, check: bool = True) -> Changes:
    """Insert records; defaults, generated keys, nested objects and arrays included."""
    return _create(store, model, records, select, check, local=False)


def _create(store: Store, model: str, records: DataFrame, select, check: bool, local: bool) -> Changes:
    m = store.catalog.model(model)
    work = _Work(store, apply_hooks(m.on_write, records), local and not m.on_write)
    keys = _insert(work, m, work.batch)
    created = read_many(work.store, model, work.near(keys.select(m.pk)), select)
    return work.finish(check, created)


def _insert(work: _Work, m: Model, df: DataFrame) -> DataFrame:
    """Add records of one model; returns their keys with the ``__`` columns of ``df``."""
    _check_columns(m, df)
    supplied = [c for c in df.columns if m.has(c)]
    if not supplied:
        raise EmptyRecord(f"cannot create an empty record of `{m.name}`")
    if PRESENT in df.columns:
        empty = df.where(F.size(PRESENT) == 0)
        work.violations.append(violation_rows(empty, m.name, m.pk, "empty_record", F.lit(None), F.lit(None)))
    df = _generate(work, m, df)
    for f in m.refs:
        if _struct_of(df, f.name) is not None:
            df = _insert_reference(work, m, f, df)
    rows = df.select(*[_stored_value(work.store, m, f, df).alias(f.name) for f in m.stored])
    work.changed.append((m.name, rows, {*supplied, *([m.pk] if m.pk in df.columns else [])}))
    work.edit_table(m.name, lambda base: base.unionByName(rows), adds=True)
    work.mark_rows("exists", m, rows, {f.name for f in m.stored})
    for f in m.arrays:
        if f.name in df.columns:
            items = df.select(
                F.col(m.pk).alias("source"),
                F.explode(F.when(_present(df, f.name), F.col(f"`{f.name}`"))).alias("item"),
            )
            _insert_items(work, m, f, items, frozenset({"source"}))
        elif f.has_default and f.default:
            values = F.array(*[F.lit(v) for v in f.default])
            links = df.select(F.col(m.pk).alias("source"), F.explode(values).alias("target"))
            work.add_links((m.name, f.name), links, frozenset({"source", "target"}))
    return df.select(m.pk, *[c for c in df.columns if c.startswith("__")])


def _stored_value(store: Store, m: Model, f: Field, df: DataFrame) -> Column:
    dtype = store.scan(m.name).schema[f.name].dataType
    default = F.lit(f.default if f.has_default else None).cast(dtype)
    if f.name not in df.columns:
        return default
    value = F.col(f"`{f.name}`").cast(dtype)
    return F.when(_present(df, f.name), value).otherwise(default)


def _generate(work: _Work, m: Model, df: DataFrame) -> DataFrame:
    """Fill uuids and numbers, hash the secret; written once so that every use agrees."""
    written = False
    for f in m.stored:
        have = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string")
        if f.uuid:
            df, written = df.withColumn(f.name, F.coalesce(have, F.expr("uuid()"))), True
        elif f.secret_credential and f.name in df.columns:
            work.violations.append(_secret_violations(m, f, df))
            df, written = df.withColumn(f.name, hash_secret(have.cast("string"))), True
        else:
            continue
        df = _mark_present(df, f.name)
    if written:
        df = checkpointed(df)
    for f in m.stored:
        if f.auto_increment:
            df = _mark_present(_number(work, m, f, df), f.name)
    return df


def _mark_present(df: DataFrame, name: str) -> DataFrame:
    if PRESENT not in df.columns:
        return df
    return df.withColumn(PRESENT, F.array_union(PRESENT, F.array(F.lit(name))))


def _secret_violations(m: Model, f: Field, df: DataFrame) -> DataFrame:
    key = F.col(m.pk) if m.pk in df.columns else F.lit(None)
    secret = F.col(f"`{f.name}`").cast("string")
    return violation_rows(df.where(too_long(secret)), m.name, f.name, "secret_too_long", key, F.lit(None))


def _number(work: _Work, m: Model, f: Field, df: DataFrame) -> DataFrame:
    """Give records without a number the next ones after the highest ever used."""

    def numbered(rows: DataFrame) -> DataFrame:
        if ORDER in rows.columns:
            return number_rows(rows, [F.col(ORDER).asc()], "__no", ties=True)
        return dense_ids(rows, "__no")

    before = work.store
    given = df.where(F.col(f"`{f.name}`").isNotNull()) if f.name in df.columns else None
    if given is not None and df.where(F.col(f"`{f.name}`").isNull()).isEmpty():
        work.use_numbers(m, f, lambda: max(before.sequence(m.name, f.name), _highest(df, f.name)))
        return df
    last = before.sequence(m.name, f.name)
    if given is not None:
        last = max(last, _highest(given, f.name))
        new = numbered(df.where(F.col(f"`{f.name}`").isNull()))
    else:
        new = numbered(df)
    work.use_numbers(m, f, lambda: last + new.count())
    new = new.withColumn(f.name, F.col("__no") + F.lit(last)).drop("__no")
    return new if given is None else given.unionByName(new)


def _highest(df: DataFrame, name: str) -> int:
    return next_key(df, name).first()["next_key"] - 1


def _insert_reference(work: _Work, m: Model, f: Field, df: DataFrame) -> DataFrame:
    """Insert nested to-one objects and put their keys into the parent's column."""
    child = work.store.catalog.model(f.ref_model)
    struct = _struct_of(df, f.name)
    value = F.col(f"`{f.name}`")
    only_key = _only_key(struct, value, child.pk)
    if set(struct.names) - {PRESENT} == {child.pk}:
        return df.withColumn(f.name, value[child.pk])
    new = df.where(value.isNotNull() & ~only_key)
    generated = child.primary.uuid or child.primary.auto_increment
    if child.pk in struct.names and not generated:
        _insert(work, child, _unpack(new, struct, f.name))
        return df.withColumn(f.name, value[child.pk])
    keys = _insert(work, child, _unpack(new, struct, f.name, F.col(m.pk).alias("__parent")))
    keys = keys.select(F.col(child.pk).alias("__child"), F.col("__parent"))
    known = value[child.pk] if child.pk in struct.names else F.lit(None)
    joined = df.join(keys, F.col(m.pk) == F.col("__parent"), "left")
    return joined.withColumn(f.name, F.coalesce(F.col("__child"), known)).drop("__child", "__parent")


def _insert_items(
    work: _Work, m: Model, f: Field, items: DataFrame, unchecked: frozenset[str] = frozenset()
) -> DataFrame:
    """Add array elements (``source``, ``item``): records, keys or plain values; returns the links."""
    key, struct = (m.name, f.name), _struct_of(items, "item")
    if struct is None:
        links = items.select("source", F.col("item").alias("target"))
        work.add_links(key, links, unchecked)
        return links
    child = work.store.catalog.model(f.ref_model)
    value = F.col("item")
    only_key = _only_key(struct, value, child.pk)
    added = []
    if child.pk in struct.names:
        known = items.where(only_key).select("source", value[child.pk].alias("target"))
        work.add_links(key, known, unchecked)
        added.append(known)
    if set(struct.names) - {PRESENT} != {child.pk}:
        new = _unpack(items.where(~only_key), struct, "item", F.col("source").alias(_SOURCE))
        keys = _insert(work, child, new)
        made = keys.select(F.col(_SOURCE).alias("source"), F.col(child.pk).alias("target"))
        work.add_links(key, made, unchecked | {"target"})
        added.append(made)
    return reduce(DataFrame.unionByName, added)


# -- update ------------------------------------------------------------------


def update(store: Store, model: str, pk, patch: Mapping, select=None, check: bool = True) -> Changes:
    """Patch one record; fields that are not supplied stay."""
    m = store.catalog.model(model)
    key = F.lit(pk).cast(store.catalog.value_type(m.primary.type))
    if patch:
        df = frame(store, model, patch).withColumn(KEY, key)
    else:
        df = store.spark.range(1).select(key.alias(KEY))
    return _update(store, model, df, select, check, local=True)


def update_many(store: Store, model: str, patches: DataFrame, select=None, check: bool = True) -> Changes:
    """Patch records by key; for one key, later items (by ``_ord``) win field by field."""
    return _update(store, model, patches, select, check, local=False)


def _update(store: Store, model: str, patches: DataFrame, select, check: bool, local: bool) -> Changes:
    m = store.catalog.model(model)
    patches = apply_hooks(m.on_write, patches)
    if ORDER not in patches.columns:
        # Written with the batch, so every plan sees the same order.
        patches = patches.withColumn(ORDER, F.monotonically_increasing_id())
    work = _Work(store, patches, local and not m.on_write)
    keys = _patch(work, m, work.batch)
    return work.finish(check, read_many(work.store, model, work.near(keys), select))


def _patch(work: _Work, m: Model, df: DataFrame) -> DataFrame:
    """Apply patches to one model; returns the (new) keys of the patched records."""
    _check_columns(m, df)
    if KEY not in df.columns:
        df = df.withColumn(KEY, F.col(m.pk))
        moves_key = False
    else:
        moves_key = m.pk in df.columns
    if m.secret is not None and m.secret.name in df.columns:
        secret = F.col(f"`{m.secret.name}`").cast("string")
        work.violations.append(_secret_violations(m, m.secret, df))
        df = checkpointed(df.withColumn(m.secret.name, hash_secret(secret)))
    for f in m.fields:
        if _struct_of(df, f.name) is not None:
            df = _patch_array(work, m, f, df) if f.is_array else _patch_reference(work, m, f, df)
    for f in m.arrays:
        if f.name in df.columns:
            _replace_items(work, m, f, df)
    base = work.store.scan(m.name)
    fields = [f for f in m.stored if f.name in df.columns and (not f.primary or moves_key)]
    types = base.schema
    folded = df.groupBy(F.col(KEY).alias("__key")).agg(
        F.count("*").alias("__items"),
        *[
            F.max_by(
                F.struct(F.col(f"`{f.name}`").cast(types[f.name].dataType).alias("v")),
                F.when(_patched(df, f.name), F.col(ORDER)),
            ).alias(f"__new.{f.name}")
            for f in fields
        ],
    )
    lost = work.missing(folded, F.col("__key"), base.select(m.pk)).unionByName(folded.where("__key IS NULL"))
    work.violations.append(violation_rows(lost, m.name, m.pk, "not_found", F.col("__key"), F.lit(None)))
    if not fields:
        return folded.select(F.col("__key").alias(m.pk))

    def after(f: Field) -> Column:
        new = F.col(f"`__new.{f.name}`")
        return F.when(new.isNotNull(), new["v"]).otherwise(F.col(f"`{f.name}`")).alias(f.name)

    changed = {f.name for f in fields}
    columns = [after(f) if f.name in changed else F.col(f"`{f.name}`") for f in m.stored]
    match = F.col(f"`{m.pk}`") == F.col("__key")
    keys = work.near(folded.select("__key"))
    work.edit_table(m.name, lambda rows: rows.join(work.near(folded), match, "left").select(*columns), Touch((m.pk,), keys))
    rows = base.join(work.near(folded), match).select(*columns)
    work.changed.append((m.name, rows, changed))
    work.mark_rows("value", m, rows, changed - {m.pk})
    for f in fields:
        if f.auto_increment:
            _keep_above(work, m, f)
    if moves_key:
        moved = F.col(f"`__new.{m.pk}`")
        mapping = folded.where(moved.isNotNull() & (moved["v"] != F.col("__key"))).select(
            F.col("__key").alias("__old"), moved["v"].alias("__to")
        )
        for column in ("__old", "__to"):
            work.mark("exists", m.name, m.pk, mapping, F.col(column))
        _move_keys(work, m, mapping)
    return rows.select(m.pk)


def _keep_above(work: _Work, m: Model, f: Field) -> None:
    """Numbers given by hand may lie above those handed out."""
    before, after = work.before, work.store
    work.use_numbers(m, f, lambda: max(before.sequence(m.name, f.name), _highest(after.scan(m.name, [f.name]), f.name)))


def _patched(df: DataFrame, name: str) -> Column:
    flag = f"__set.{name}"
    return F.col(f"`{flag}`") if flag in df.columns else _present(df, name)


def _patch_reference(work: _Work, m: Model, f: Field, df: DataFrame) -> DataFrame:
    """A key alone repoints; other fields patch the named child, or the current one."""
    child = work.store.catalog.model(f.ref_model)
    struct = _struct_of(df, f.name)
    value = F.col(f"`{f.name}`")
    key = value[child.pk] if child.pk in struct.names else F.lit(None).cast(
        work.store.catalog.value_type(child.primary.type)
    )
    if set(struct.names) - {PRESENT} != {child.pk}:
        current = work.before.scan(m.name, [m.pk, f.name]).select(
            F.col(m.pk).alias("__pk"), F.col(f"`{f.name}`").alias("__fk")
        )
        nested = df.where(_present(df, f.name) & value.isNotNull() & ~_only_key(struct, value, child.pk))
        wanted = nested.select(F.col(KEY).alias("__wanted"))
        current = current.join(work.near(wanted), F.col("__pk") == F.col("__wanted"), "left_semi")
        keyed = nested.join(work.near(current), F.col(KEY) == F.col("__pk"), "left")
        patches = _unpack(keyed, struct, f.name, F.coalesce(key, F.col("__fk")).alias(KEY), F.col(ORDER))
        _patch(work, child, patches.drop(child.pk))
    repoints = _present(df, f.name) & (value.isNull() | _only_key(struct, value, child.pk))
    return df.withColumn(f"__set.{f.name}", F.coalesce(repoints, F.lit(False))).withColumn(f.name, key)


def _patch_array(work: _Work, m: Model, f: Field, df: DataFrame) -> DataFrame:
    """Objects in an array patch those children; membership stays."""
    child = work.store.catalog.model(f.ref_model)
    struct = _struct_of(df, f.name)
    if child.pk not in struct.names:
        raise DefinitionError(f"items of `{m.name}.{f.name}` need `{child.pk}`")
    items = df.where(_present(df, f.name)).select(ORDER, F.posexplode(F.col(f"`{f.name}`")).alias("__at", "__item"))
    order = F.struct(F.col(ORDER), F.col("__at")).alias(ORDER)
    key = F.col("__item")[child.pk].alias(KEY)
    _patch(work, child, _unpack(items, struct, "__item", key, order).drop(child.pk))
    return df.drop(f.name)


def _replace_items(work: _Work, m: Model, f: Field, df: DataFrame) -> None:
    """An array of plain values replaces all elements."""
    last = df.groupBy(F.col(KEY).alias("__key")).agg(
        F.max_by(F.col(f"`{f.name}`"), F.when(_present(df, f.name), F.col(ORDER))).alias("__items")
    )
    last = last.where(F.col("__items").isNotNull())
    key, given = (m.name, f.name), work.near(last.select("__key"))
    work.edit_links(key, lambda links: links.join(given, F.col("source") == F.col("__key"), "left_anti"), Touch(("source",), given))
    work.mark("value", *key, last, F.col("__key"))
    added = last.select(F.col("__key").alias("source"), F.explode("__items").alias("target"))
    # The source is the patched record itself, whose absence is reported as such.
    work.add_links((m.name, f.name), added, frozenset({"source"}))


def _move_keys(work: _Work, m: Model, mapping: DataFrame) -> None:
    """Carry changed primary keys (``__old``, ``__to``) into references and links."""
    catalog = work.store.catalog
    old = work.near(mapping.select("__old"))
    for other, f in catalog.referrers(m.name):
        work.edit_table(other.name, _remapped(f.name, work.near(mapping)), Touch((f.name,), old))
    for other, f, end in catalog.links_touching(m.name):
        work.edit_links((other.name, f.name), _remapped(end, work.near(mapping)), Touch((end,), old))


def _remapped(column: str, mapping: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        joined = df.join(mapping, F.col(f"`{column}`") == F.col("__old"), "left")
        return joined.withColumn(column, F.coalesce(F.col("__to"), F.col(f"`{column}`"))).select(*df.columns)

    return apply


# -- delete ------------------------------------------------------------------


def delete(store: Store, model: str, pk, select=None, cascade: bool = False, check: bool = True) -> Changes:
    """Delete one record; the result holds it as it was. Delete hooks may replace the key."""
    m = store.catalog.model(model)
    key = F.lit(pk).cast(store.catalog.value_type(m.primary.type))
    keys = apply_hooks(m.on_delete, store.spark.range(1).select(key.alias(m.pk)))
    return _delete(store, model, keys, select, cascade, check, local=not m.on_delete)


def delete_many(
    store: Store, model: str, keys: DataFrame, select=None, cascade: bool = False, check: bool = True
) -> Changes:
    """Delete records by key, with the consequences for references and links.

    Optional references become null, required ones block. ``cascade`` also
    deletes the to-one records that the deleted ones refer to.
    """
    return _delete(store, model, keys, select, cascade, check, local=False)


def _delete(store: Store, model: str, keys: DataFrame, select, cascade: bool, check: bool, local: bool) -> Changes:
    m = store.catalog.model(model)
    work = _Work(store, keys.select(F.col(m.pk).alias("__key")).distinct(), local)
    keys = work.batch
    lost = work.missing(keys, F.col("__key"), store.scan(model, [m.pk]))
    work.violations.append(violation_rows(lost, model, m.pk, "not_found", F.col("__key"), F.lit(None)))
    children = []
    if cascade:
        for f in m.refs:
            doomed = store.scan(model, [m.pk, f.name]).join(
                work.near(keys), F.col(m.pk) == F.col("__key"), "left_semi"
            )
            doomed = doomed.where(F.col(f"`{f.name}`").isNotNull()).select(F.col(f"`{f.name}`").alias("__key"))
            children.append((store.catalog.model(f.ref_model), doomed.distinct()))
    _remove(work, m, keys)
    for child, doomed in children:
        _remove(work, child, doomed)
    gone = read_many(store, model, work.near(keys.withColumnRenamed("__key", m.pk)), select)
    return work.finish(check, gone)


def _remove(work: _Work, m: Model, keys: DataFrame) -> None:
    catalog = work.store.catalog
    keys = work.near(keys)
    before = work.before
    for f in m.stored:
        if f.auto_increment and f"{m.name}.{f.name}" not in before.sequences:
            # The deleted numbers stay used.
            work.use_numbers(m, f, lambda name=f.name: before.sequence(m.name, name))
    work.mark("exists", m.name, m.pk, keys, F.col("__key"))
    work.edit_table(m.name, _without_keys(m.pk, keys), Touch((m.pk,), keys))
    for other, f in catalog.referrers(m.name):
        column = F.col(f"`{f.name}`")
        if f.optional:
            work.edit_table(other.name, _nulled(f.name, keys), Touch((f.name,), keys))
        else:
            held = work.store.scan(other.name).join(keys, column == F.col("__key"), "left_semi")
            work.violations.append(violation_rows(held, other.name, f.name, "still_referenced", F.col(f"`{other.pk}`"), column))
    for other, f, end in catalog.links_touching(m.name):
        work.edit_links((other.name, f.name), _without_keys(end, keys), Touch((end,), keys))


def _without_keys(column: str, keys: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.join(keys, F.col(f"`{column}`") == F.col("__key"), "left_anti")


def _nulled(column: str, keys: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        marked = df.join(keys, F.col(f"`{column}`") == F.col("__key"), "left")
        return marked.withColumn(column, F.when(F.col("__key").isNull(), F.col(f"`{column}`"))).select(*df.columns)

    return apply


# -- arrays ------------------------------------------------------------------


def push_to(store: Store, model: str, field: str, pk, item, select=None, check: bool = True) -> Changes:
    """Add one element: an existing record (key or object with just the key), a new record or a value."""
    m = store.catalog.model(model)
    f = m.field(field)
    dtype, value = _typed(store.catalog, f, [item])
    schema = T.StructType(
        [
            T.StructField("source", store.catalog.value_type(m.primary.type)),
            T.StructField("item", dtype.elementType),
        ]
    )
    return _push(store, model, field, local_frame(store.spark, [(pk, value[0])], schema), select, check, local=True)


def push_many_to(
    store: Store, model: str, field: str, items: DataFrame, select=None, check: bool = True
) -> Changes:
    """Add elements given as (``source``, ``item``); the result holds the pushed records or values."""
    return _push(store, model, field, items, select, check, local=False)


def _push(store: Store, model: str, field: str, items: DataFrame, select, check: bool, local: bool) -> Changes:
    m = store.catalog.model(model)
    f = m.field(field)
    work = _Work(store, items.select("source", "item"), local)
    links = _insert_items(work, m, f, work.batch)
    return work.finish(check, _elements(work.store, f, work.near(links), select))


def remove_from(store: Store, model: str, field: str, pk, target, select=None) -> Changes:
    """Remove an element; every equal link goes, the target record stays and is returned."""
    schema = store.catalog.link_struct(model, field)
    return remove_many_from(store, model, field, local_frame(store.spark, [(pk, target)], schema), select)


def remove_many_from(store: Store, model: str, field: str, pairs: DataFrame, select=None) -> Changes:
    """Remove all links equal to one of the pairs (``source``, ``target``)."""
    f = store.catalog.model(model).field(field)
    pairs = written_side(pairs.select("source", "target"))
    gone = pairs.select(F.col("source").alias("__source"), F.col("target").alias("__target")).distinct()
    same = (F.col("source") == F.col("__source")) & (F.col("target") == F.col("__target"))
    key, name = (model, field), f"{model}.{field}"

    def apply(links: DataFrame) -> DataFrame:
        return links.join(gone, same, "left_anti")

    marks = pairs.where(F.col("source").isNotNull()).select(
        F.lit(name).alias("name"), F.col("source").cast("string").alias("value"), F.lit("value").alias("kind")
    )
    return Changes(
        links={key: apply(store.links(*key))},
        result=_elements(store, f, pairs, select),
        edits={name: [Edit(apply, (Touch(("source", "target"), gone),))]},
        footprint=[marks],
    )


def _elements(store: Store, f: Field, links: DataFrame, select) -> Result:
    if f.is_ref_array:
        child = store.catalog.model(f.ref_model)
        return read_many(store, child.name, links.select(F.col("target").alias(child.pk)), select)
    return Result(links.select(F.col("target").alias("value")), "value")


# -- groups ------------------------------------------------------------------


def run_group(store: Store, operations: Iterable[Callable[[Store], Changes]]) -> tuple[Store, list]:
    """Run operations one after the other, each on the store the earlier ones left.

    An operation that fails raises, and the given store is as before. With a
    stored store, what an operation changed is written before the next one runs,
    so that it is not worked out again; it stays invisible until the returned
    store is published, and goes if an operation fails. If another writer has
    published a version in the meantime, publishing fails, or with ``rebase`` puts
    the group on top of it.
    """
    results = []
    before = set(store.locations.values())
    try:
        for operation in operations:
            changes = operation(store)
            store = store.apply(changes)
            if store.path is not None:
                store = store.settle()
            results.append(changes.result)
    except Exception:
        remove_folders(store.spark, {folder_of(x) for x in set(store.locations.values()) - before})
        raise
    return store, results
