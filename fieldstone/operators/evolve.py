"""Stored tables from one catalog version to the next.

Models and fields are matched by index. Every new table is one projection of
the old one; only a moved primary key needs joins, to rewrite what refers to it.
Tables that do not change are taken over as they are, not rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.catalog import INT, STRING, ArrayOf, Catalog, DefinitionError, Enumeration, Field, Model, Ref
from fieldstone.functions.numbering import dense_ids
from fieldstone.operators.quality import check_enums, check_primary, check_unique, ensure, violation_rows
from fieldstone.session import checkpointed
from fieldstone.sources.store import LinkKey, Store

_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_FLAGS = ("unique", "uuid", "auto_increment", "public_credential", "secret_credential")


class EvolutionError(ValueError):
    """A change of the catalog that stored data cannot follow."""


# -- what changed ------------------------------------------------------------


def _same(old: Catalog, new: Catalog, a, b) -> bool:
    """Is the type the same? References by the index of their model, enums by name."""
    if isinstance(a, ArrayOf) and isinstance(b, ArrayOf):
        return _same(old, new, a.of, b.of)
    if isinstance(a, Ref) and isinstance(b, Ref):
        return old.model(a.model).index == new.model(b.model).index
    if isinstance(a, Enumeration) and isinstance(b, Enumeration):
        return a.name == b.name
    return a == b


def _type_change(old: Catalog, new: Catalog, a: Field, b: Field) -> str | None:
    """None, ``make_optional``, ``to_array`` or an error."""
    if _same(old, new, a.type, b.type):
        if a.optional == b.optional:
            return None
        if b.optional:
            return "make_optional"
    elif b.is_array and not a.is_array and _same(old, new, a.type, b.type.of):
        return "to_array"
    raise EvolutionError(f"field `{a.name}` cannot change its type")


def differences(old: Catalog, new: Catalog) -> list[tuple]:
    """The steps between two catalogs; raises on a type change that is not possible."""
    steps: list[tuple] = []
    for m in old.models:
        if new.by_index(m.index) is None:
            steps.append(("drop_model", m.name))
    for m in new.models:
        before = old.by_index(m.index)
        if before is None:
            steps.append(("create_model", m.name))
            continue
        for f in before.fields:
            if m.by_index(f.index) is None:
                steps.append(("drop_field", before.name, f.name))
        for f in m.fields:
            was = before.by_index(f.index)
            if was is None:
                steps.append(("add_field", before.name, f.name))
                continue
            if was.name != f.name:
                steps.append(("rename_field", before.name, was.name, f.name))
            change = _type_change(old, new, was, f)
            if change:
                steps.append((change, before.name, was.name))
            for flag in _FLAGS:
                if getattr(was, flag) != getattr(f, flag):
                    steps.append((f"{'add' if getattr(f, flag) else 'remove'}_{flag}", before.name, f.name))
            if was.has_default != f.has_default or (f.has_default and was.default != f.default):
                steps.append(("set_default", before.name, f.name))
            if isinstance(f.type, Enumeration) and f.type != was.type and change is None:
                steps.append(("set_members", before.name, f.name))
        if before.primary.index != m.primary.index:
            steps.append(("move_primary", before.name, m.primary.name))
        if before.name != m.name:
            steps.append(("rename_model", before.name, m.name))
    return steps


# -- the new store -----------------------------------------------------------


def evolve(store: Store, old: Catalog, new: Catalog) -> Store:
    """The store as the new catalog wants it; the same store when nothing changed."""
    if not differences(old, new):
        return store.replaced(catalog=new)
    tables: dict[str, DataFrame | Callable] = {}
    links: dict[LinkKey, DataFrame | Callable] = {}
    locations: dict[str, str] = {}
    mappings: dict[int, DataFrame] = {}
    for m in new.models:
        before = old.by_index(m.index)
        if before is None:
            continue
        moved = before.primary.index != m.primary.index
        # Columns are selected by name, so a dropped one leaves the stored table as it is.
        same = not moved and all(_is_plain(before.by_index(f.index), f) for f in m.stored)
        once_single = [f for f in m.arrays if (was := before.by_index(f.index)) is not None and not was.is_array]
        if same:
            _take_table(store, before, m, tables, locations)
        if not same or once_single:
            wide = _widened(store, old, new, before, m)
        if not same:
            tables[m.name] = wide.select(*[F.col(f"`{_stage(f)}`").alias(f.name) for f in m.stored])
        for f in m.arrays:
            was = before.by_index(f.index)
            if was is not None and was.is_array:
                _take_links(store, before, was, m, f, links, locations)
            elif was is not None:
                links[(m.name, f.name)] = _first_elements(before, was, wide)
        if moved:
            mappings[m.index] = wide.select(
                F.col(f"`__old.{before.pk}`").alias("__old"), F.col(f"`{_stage(m.primary)}`").alias("__to")
            )
    evolved = store.replaced(catalog=new, tables=tables, links=links, locations=locations)
    if mappings:
        evolved = _rewrite_keys(evolved, old, new, mappings)
    _check(evolved, old, new)
    return evolved


def _is_plain(was: Field | None, now: Field) -> bool:
    """Stored just as before."""
    return was is not None and was.name == now.name and was.is_array == now.is_array


def _take_table(store: Store, before: Model, m: Model, tables, locations) -> None:
    if before.name in store.tables:
        tables[m.name] = store.tables[before.name]
    if before.name in store.locations:
        locations[m.name] = store.locations[before.name]


def _take_links(store: Store, before: Model, was: Field, m: Model, f: Field, links, locations) -> None:
    if (before.name, was.name) in store.link_tables:
        links[(m.name, f.name)] = store.link_tables[(before.name, was.name)]
    if f"{before.name}.{was.name}" in store.locations:
        locations[f"{m.name}.{f.name}"] = store.locations[f"{before.name}.{was.name}"]


def _stage(f: Field) -> str:
    return f"__new.{f.index}"


def _widened(store: Store, old: Catalog, new: Catalog, before: Model, m: Model) -> DataFrame:
    """The old columns as ``__old.<name>`` beside the new ones as ``__new.<index>``."""
    base = store.scan(before.name)
    wide = base.select(*[F.col(f"`{c}`").alias(f"__old.{c}") for c in base.columns])
    added, columns = [], {}
    for f in m.stored:
        was = before.by_index(f.index)
        if was is None:
            added.append(f)
        else:
            columns[_stage(f)] = F.col(f"`__old.{was.name}`")
    wide = wide.withColumns(columns) if columns else wide
    if any(not f.generated for f in added) and not base.isEmpty():
        name = next(f.name for f in added if not f.generated)
        raise EvolutionError(f"`{m.name}.{name}` is required, and existing records would have no value for it")
    for f in added:
        wide = _filled(wide, new, f)
    return wide


def _filled(wide: DataFrame, new: Catalog, f: Field) -> DataFrame:
    """Back-fill a new column; generated values are written once."""
    name, dtype = _stage(f), new.value_type(f.type)
    if f.uuid:
        return checkpointed(wide.withColumn(name, F.expr("uuid()")))
    if f.auto_increment:
        return dense_ids(wide, name)
    return wide.withColumn(name, F.lit(f.default if f.has_default else None).cast(dtype))


def _first_elements(before: Model, was: Field, wide: DataFrame) -> DataFrame:
    """The single value becomes the first element; a null becomes the empty array."""
    value = F.col(f"`__old.{was.name}`")
    return wide.where(value.isNotNull()).select(F.col(f"`__old.{before.pk}`").alias("source"), value.alias("target"))


def _rewrite_keys(store: Store, old: Catalog, new: Catalog, mappings: dict[int, DataFrame]) -> Store:
    """Replace old keys by new ones in every reference and link."""
    tables, links, locations = dict(store.tables), dict(store.link_tables), dict(store.locations)
    for m in new.models:
        before = old.by_index(m.index)
        if before is None:
            continue
        for f in m.refs:
            target = new.model(f.ref_model)
            if target.index in mappings and before.by_index(f.index) is not None:
                df = store.replaced(tables=tables).scan(m.name)
                tables[m.name] = _mapped(df, f.name, mappings[target.index], f"{m.name}.{f.name}")
                locations.pop(m.name, None)
        for f in m.arrays:
            key = (m.name, f.name)
            if key not in links or before.by_index(f.index) is None:
                continue
            df = store.replaced(links=links).links(*key)
            ends = [("source", m.index)] + ([("target", new.model(f.ref_model).index)] if f.is_ref_array else [])
            for end, index in ends:
                if index in mappings:
                    df = _mapped(df, end, mappings[index], f"{m.name}.{f.name}")
                    locations.pop(f"{m.name}.{f.name}", None)
            links[key] = df
    return store.replaced(tables=tables, links=links, locations=locations)


def _mapped(df: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    """The new keys in a column; a key of no record is refused when the rows are read, never erased."""
    key = F.col(f"`{column}`")
    joined = df.join(mapping, key == F.col("__old"), "left")
    dangling = F.raise_error(F.concat(F.lit(f"`{name}` refers to a record that does not exist: "), key.cast("string")))
    to = F.when(key.isNull() | F.col("__old").isNotNull(), F.col("__to")).otherwise(dangling.cast(mapping.schema["__to"].dataType))
    return joined.select(*[to.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def _check(store: Store, old: Catalog, new: Catalog) -> None:
    """Constraints that became stricter must hold for what is stored."""
    found: list[DataFrame] = []
    for m in new.models:
        before = old.by_index(m.index)
        if before is None:
            continue
        if before.primary.index != m.primary.index:
            found.append(check_primary(store, m.name))
        for f in m.stored:
            was = before.by_index(f.index)
            if f.is_unique and not f.primary and not (was is not None and was.is_unique):
                only = Model(m.name, m.index, tuple({m.pk: m.primary, f.name: f}.values()), user=m.user)
                alone = store.replaced(catalog=Catalog((only,)))
                found.append(check_unique(alone, m.name))
            if f.uuid and was is not None and not was.uuid:
                value = F.col(f"`{f.name}`")
                wrong = store.scan(m.name, dict.fromkeys([m.pk, f.name])).where(~value.rlike(_UUID))
                found.append(violation_rows(wrong, m.name, f.name, "uuid", F.col(f"`{m.pk}`"), value))
        grown = [
            f
            for f in m.fields
            if isinstance(f.type.of if f.is_array else f.type, Enumeration)
            and before.by_index(f.index) is not None
            and before.by_index(f.index).type != f.type
        ]
        if grown:
            found.append(check_enums(store, m.name))
    if found:
        ensure(reduce(DataFrame.unionByName, found))


# -- single steps ------------------------------------------------------------


def _edited(store: Store, model: str, edit: Callable[[Model], Model]) -> Store:
    old = store.catalog
    return evolve(store, old, old.with_model(edit(old.model(model))))


def _with_field(store: Store, model: str, field: str, **changes) -> Store:
    return _edited(store, model, lambda m: m.with_field(replace(m.field(field), **changes)))


def create_model(store: Store, model: Model) -> Store:
    """Add a model with an empty table and empty link tables."""
    return evolve(store, store.catalog, Catalog((*store.catalog.models, model)))


def rename_model(store: Store, old: str, new: str) -> Store:
    """Rename a model, its link tables and every reference to it."""

    def renamed(t):
        if isinstance(t, ArrayOf):
            return ArrayOf(renamed(t.of))
        return Ref(new) if isinstance(t, Ref) and t.model == old else t

    store.catalog.model(old)
    models = [
        replace(
            m,
            name=new if m.name == old else m.name,
            fields=tuple(replace(f, type=renamed(f.type)) for f in m.fields),
        )
        for m in store.catalog.models
    ]
    return evolve(store, store.catalog, Catalog(tuple(models)))


def drop_model(store: Store, model: str) -> Store:
    """Remove a model with its link tables; nothing else may refer to it."""
    store.catalog.model(model)
    return evolve(store, store.catalog, Catalog(tuple(m for m in store.catalog.models if m.name != model)))


def add_field(store: Store, model: str, field: Field) -> Store:
    """Add a field: back-filled with its default, generated, null or an empty array."""
    if store.catalog.model(model).by_index(field.index) is not None:
        raise DefinitionError(f"`{model}` has a field of index {field.index}")
    return _edited(store, model, lambda m: replace(m, fields=(*m.fields, field)))


def rename_field(store: Store, model: str, old: str, new: str) -> Store:
    return _with_field(store, model, old, name=new)


def drop_field(store: Store, model: str, field: str) -> Store:
    store.catalog.model(model).field(field)
    return _edited(store, model, lambda m: m.without_field(field))


def make_optional(store: Store, model: str, field: str) -> Store:
    return _with_field(store, model, field, optional=True)


def field_to_array(store: Store, model: str, field: str) -> Store:
    """``A`` or ``A?`` to ``[A]``: the value becomes the only element, null the empty array."""
    f = store.catalog.model(model).field(field)
    array = Field(f.name, ArrayOf(f.type), f.index)
    return _edited(store, model, lambda m: m.with_field(array))


def set_unique(store: Store, model: str, field: str, on: bool = True) -> Store:
    return _with_field(store, model, field, unique=on)


def set_uuid(store: Store, model: str, field: str, on: bool = True) -> Store:
    """Generate uuids from now on; what is stored must already be uuids."""
    if on and store.catalog.model(model).field(field).type != STRING:
        raise EvolutionError(f"`{model}.{field}` is not a String")
    return _with_field(store, model, field, uuid=on)


def set_autoincrement(store: Store, model: str, field: str, on: bool = True) -> Store:
    """Number new records from the maximum onwards."""
    if on and store.catalog.model(model).field(field).type != INT:
        raise EvolutionError(f"`{model}.{field}` is not an Int")
    return _with_field(store, model, field, auto_increment=on)


def move_primary(store: Store, model: str, to: str) -> Store:
    """Make another field the primary key and rewrite every reference and link."""

    def moved(m: Model) -> Model:
        m.field(to)
        return replace(m, fields=tuple(replace(f, primary=f.name == to) for f in m.fields))

    return _edited(store, model, moved)


def migrate(store: Store, new: Catalog) -> Store:
    """Evolve a published store; a version is recorded only if something changed."""
    if not differences(store.catalog, new):
        return store
    return evolve(store, store.catalog, new).publish()

