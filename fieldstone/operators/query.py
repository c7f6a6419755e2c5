"""Record queries: selection, filters, order, ranges and nested population.

Every to-one path is one join. A to-many path becomes a frame of its own, keyed
by its parent (``_source``), so a parent with very many elements never has to
fit into one row; ``Result.nested`` packs arrays for consumers that want them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import DefinitionError, Field, Model
from fieldstone.functions.numbering import GLOBAL_LIMIT_ROWS, number_rows, ranked
from fieldstone.functions.registry import apply_read_hooks
from fieldstone.operators.predicates import filter_model, filter_values
from fieldstone.session import checkpointed
from fieldstone.sources.derived import ordered_page
from fieldstone.sources.store import Store

SOURCE, POSITION, VALUE, PART = "_source", "_pos", "value", "_part"

_LIST_OPTIONS = {"field", "select", "filter", "order_by", "from_", "to"}


class RecordNotFound(LookupError):
    """No record has the requested key."""


@dataclass
class Result:
    """``records`` holds the rows with to-one references as structs; ``lists`` the to-many paths.

    A list's records carry the parent's key in ``_source`` and, when ordered or
    ranged, their place in ``_pos``; elements of a primitive array are in
    ``value``.
    """

    records: DataFrame
    key: str
    lists: dict[str, Result] = field(default_factory=dict)
    # Where in the parent row the key of each list is found.
    parent_keys: dict[str, str] = field(default_factory=dict)
    # The records with columns that only joins and the final sort need, that sort,
    # and which columns those are.
    full: DataFrame | None = None
    sort: list[Column] = field(default_factory=list)
    hidden: list[str] = field(default_factory=list)

    def nested(self, max_items: int = 1_000) -> DataFrame:
        """One row per record, its lists as arrays of structs, ``[]`` when empty.

        The caller states how many elements a list may have: a longer one stops
        the query with an error. ``nested_parts`` has no such bound.
        """
        return self._nest(max_items, parts=False)

    def nested_parts(self, max_items: int = 1_000) -> DataFrame:
        """Records with their lists as arrays, in rows counted by ``_part`` (from 0): row n holds the
        elements from ``n * max_items`` on, and a record has as many rows as its longest list needs."""
        return self._nest(max_items, parts=True)

    def _nest(self, max_items: int, parts: bool) -> DataFrame:
        if not self.lists:
            return self.records.withColumn(PART, F.lit(0).cast("bigint")) if parts else self.records
        df = self.full if self.full is not None else self.records
        packed = {path: child._packed(max_items, parts) for path, child in self.lists.items()}
        if parts:
            df = self._with_parts(df, packed)
        for path, arrays in packed.items():
            parent = _column(self.parent_keys[path])
            side = arrays.select(
                F.col(SOURCE).alias("__k"), F.col(PART).alias("__p"), F.col("items").alias("__items")
            )
            on = (parent == F.col("__k")) & (F.col(PART) == F.col("__p")) if parts else parent == F.col("__k")
            df = df.join(side, on, "left")
            empty = F.array().cast(side.schema["__items"].dataType)
            items = F.coalesce(F.col("__items"), empty)
            head, *rest = path.split(".")
            value = F.col(head).withField(".".join(rest), items) if rest else items
            df = df.withColumn(head, value).drop("__k", "__p", "__items")
        if self.sort:
            df = df.orderBy(*self.sort, *([F.col(PART)] if parts else []))
        return _without(df, self.hidden)

    def _with_parts(self, df: DataFrame, packed: dict) -> DataFrame:
        """One row per part: as many as the longest of the record's arrays needs."""
        needed = []
        for i, (path, arrays) in enumerate(packed.items()):
            last = arrays.where(F.col(PART) > 0).groupBy(F.col(SOURCE).alias("__k")).agg(F.max(PART).alias(f"__parts{i}"))
            df = df.join(last, _column(self.parent_keys[path]) == F.col("__k"), "left").drop("__k")
            needed.append(f"__parts{i}")
        last = F.greatest(F.lit(0).cast("bigint"), *[F.coalesce(F.col(n), F.lit(0)) for n in needed])
        return df.withColumn(PART, F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop(*needed)

    def _packed(self, max_items: int, parts: bool) -> DataFrame:
        rows = self._nest(max_items, parts)
        visible = [c for c in rows.columns if c not in (SOURCE, POSITION, PART)]
        by = POSITION if POSITION in rows.columns else self.key
        if parts:
            # Parts of an element's own lists stay beside each other.
            rows = rows.withColumnRenamed(PART, "__inner") if PART in rows.columns else rows.withColumn("__inner", F.lit(0))
            order = [F.col(by).asc_nulls_last(), F.col("__inner").asc()]
            rows = number_rows(rows, order, "__n", SOURCE, ties=True)
            rows = rows.withColumn(PART, F.floor((F.col("__n") - 1) / max_items))
        else:
            # No more than one element too many is ever gathered for a parent.
            first = Window.partitionBy(SOURCE).orderBy(F.col(by).asc_nulls_last())
            rows = rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= max_items + 1)
            rows = rows.withColumn(PART, F.lit(0).cast("bigint"))
        element = F.col(VALUE) if visible == [VALUE] else F.struct(*[F.col(f"`{c}`") for c in visible if not c.startswith("__")])
        if parts:
            # No task builds arrays for a parent whose elements are elsewhere: a map-side
            # collect_list would only ship larger buffers.
            rows = rows.repartition(SOURCE, PART)
        arrays = rows.groupBy(SOURCE, PART).agg(
            F.sort_array(F.collect_list(F.struct(F.col("__n").alias("by"), element.alias("item")))).alias("items")
        )
        items = F.col("items")["item"]
        if not parts:
            message = F.concat(F.lit(f"more than {max_items} elements, use nested_parts(): "), F.col(SOURCE).cast("string"))
            kind = arrays.select(items.alias("i")).schema["i"].dataType
            items = F.when(F.size("items") <= max_items, items).otherwise(F.raise_error(message).cast(kind))
        return arrays.withColumn("items", items)


def _without(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """Drop columns and, by dotted path, fields of structs."""
    df = df.drop(*[h for h in hidden if "." not in h])
    for path in hidden:
        head, _, rest = path.partition(".")
        if rest:
            df = df.withColumn(head, F.col(f"`{head}`").dropFields(rest))
    return df


def _column(path: str) -> Column:
    head, *rest = path.split(".")
    column = F.col(f"`{head}`")
    for name in rest:
        column = column[name]
    return column


# -- selections ----------------------------------------------------------


@dataclass(frozen=True)
class _Pick:
    alias: str
    field: str
    select: object = None
    options: Mapping = field(default_factory=dict)


def _picks(model: Model, select) -> list[_Pick]:
    """Normalise a selection; without one, every stored field that is not secret."""
    if select is None:
        return [_Pick(f.name, f.name) for f in model.stored if not f.secret_credential]
    items = []
    for item in [select] if isinstance(select, Mapping) else select:
        items += item.items() if isinstance(item, Mapping) else [(item, True)]
    picks = []
    for alias, spec in items:
        if spec is True:
            pick = _Pick(alias, alias)
        elif isinstance(spec, str):
            pick = _Pick(alias, spec)
        elif isinstance(spec, Mapping) and set(spec) & _LIST_OPTIONS:
            pick = _Pick(alias, spec.get("field", alias), spec.get("select"), spec)
        else:
            pick = _Pick(alias, alias, spec)
        f = model.field(pick.field)
        if f.secret_credential:
            raise DefinitionError(f"`{model.name}.{f.name}` is secret")
        if f.is_ref and pick.options and pick.select is None:
            pick = _Pick(pick.alias, pick.field, [])
        picks.append(pick)
    return picks


@dataclass
class _PendingList:
    """A to-many path whose parent rows are known once the parent is projected."""

    path: str
    parent_key: str
    # Paths of struct fields that exist for this list alone.
    hidden: tuple[str, ...]
    # Given what restricts the links: a function of them, the key of the one parent, or nothing.
    build: Callable[[Callable[[DataFrame], DataFrame] | Column | None], Result]


def project(
    store: Store, model: Model, base: DataFrame, select, carry: Sequence[str] = ()
) -> tuple[DataFrame, list[_PendingList], str]:
    """Selected columns of ``base`` (which holds the model's stored columns), to-one paths
    joined in; also the pending lists and the column with the stored key.

    A read hook may rewrite the key, so under hooks the stored one is kept beside it.
    """
    df, pending = base, []
    raw = model.pk
    if model.on_read:
        raw = _RAW_KEY
        df, carry = df.withColumn(raw, F.col(model.pk)), [*carry, raw]
    staged: dict[str, Column] = {model.pk: F.col(model.pk)}
    output: dict[str, str] = {model.pk: model.pk}
    for i, pick in enumerate(_picks(model, select)):
        f = model.field(pick.field)
        if f.is_array:
            pending.append(_pending_list(store, model, f, pick, raw))
        elif f.is_ref and pick.select is not None:
            child = store.catalog.model(f.ref_model)
            child_df, child_lists, child_key = project(store, child, store.scan(child.name), pick.select)
            key, value = f"__k{i}", f"__v{i}"
            keep = [c for c in child_df.columns if c != _RAW_KEY or child_lists]
            packed = child_df.select(
                F.col(child_key).alias(key), F.struct(*[F.col(f"`{c}`") for c in keep]).alias(value)
            )
            df = df.join(packed, F.col(f"`{f.name}`") == F.col(key), "left")
            stage = f.name if f.name not in staged else f"{f.name}#{i}"
            staged[stage] = F.when(F.col(key).isNotNull(), F.col(value))
            output[pick.alias] = stage
            inside = (_RAW_KEY,) if _RAW_KEY in keep else ()
            pending += [
                _PendingList(
                    f"{pick.alias}.{p.path}",
                    f"{pick.alias}.{p.parent_key}",
                    tuple(f"{pick.alias}.{h}" for h in (*p.hidden, *inside)),
                    p.build,
                )
                for p in child_lists
            ]
        else:
            stage = f.name if f.name not in staged or f.name == model.pk else f"{f.name}#{i}"
            staged[stage] = F.col(f"`{f.name}`")
            output[pick.alias] = stage
    df = df.select(*carry, *[c.alias(n) for n, c in staged.items()])
    if model.on_read:
        absent = {
            f.name: store.catalog.value_type(f.type) for f in model.stored if not f.secret_credential
        }
        df = apply_read_hooks(model.on_read, df, absent)
    df = df.select(*carry, *[F.col(f"`{stage}`").alias(alias) for alias, stage in output.items()])
    return df, pending, raw


# The stored key, where a read hook may have rewritten the visible one.
_RAW_KEY = "__raw"


def _attach(full: DataFrame, key: str, pending: list[_PendingList], restrict, hidden=()) -> Result:
    hidden = [*hidden, *([_RAW_KEY] if _RAW_KEY in full.columns else [])]
    hidden += dict.fromkeys(h for p in pending for h in p.hidden)
    result = Result(_without(full, hidden), key, full=full, hidden=hidden)
    for p in pending:
        limit = restrict(p.parent_key) if restrict else None
        result.lists[p.path] = p.build(limit)
        result.parent_keys[p.path] = p.parent_key
    return result


def _among(records: DataFrame, base: DataFrame | None = None, key: str | None = None):
    """Keep only links whose source is one of the records. The records' own keys (column ``key``)
    come from ``base``, as they were before to-one paths were joined in."""

    def restrict(parent_key: str):
        if base is not None and parent_key == key:
            keys = base.toDF("__parent")
        else:
            keys = records.select(_column(parent_key).alias("__parent"))
        return lambda links: links.join(keys, F.col(SOURCE) == F.col("__parent"), "left_semi")

    return restrict


def _pending_list(store: Store, model: Model, f: Field, pick: _Pick, key: str) -> _PendingList:
    def build(limit) -> Result:
        one = isinstance(limit, Column)
        links = store.links_of(model.name, f.name, limit) if one else store.links(model.name, f.name)
        links = links.select(F.col("source").alias(SOURCE), F.col("target").alias("_target"))
        if limit is not None and not one:
            links = limit(links)
        if f.is_ref_array:
            return _reference_list(store, f, links, pick)
        return _value_list(f, links, pick)

    return _PendingList(pick.alias, key, (), build)


def _range(options: Mapping) -> tuple[int, int | None]:
    return max((options.get("from_") or 1) - 1, 0), options.get("to")


def _order(options: Mapping) -> tuple[str | None, str] | None:
    order = options.get("order_by")
    if order is None:
        return None
    if isinstance(order, str):
        # One word is a direction for values, a field otherwise.
        return (None, order) if order in _DIRECTIONS else (order, "ASCENDING")
    name, direction = order
    if direction not in _DIRECTIONS:
        raise ValueError(f"unknown order `{direction}`")
    return name, direction


# Null placement: ascending puts nulls last, descending first.
_DIRECTIONS = {
    "ASCENDING": lambda c: c.asc_nulls_last(),
    "DESCENDING": lambda c: c.desc_nulls_first(),
    "SHUFFLED": lambda c: c.asc_nulls_last(),
}


def _ranked_list(
    df: DataFrame, options: Mapping, order, by: Column, tie: str, sizes: DataFrame
) -> DataFrame:
    offset, limit = _range(options)
    if order is None and offset == 0 and limit is None:
        return df
    direction = order[1] if order else "ASCENDING"
    key = F.rand() if direction == "SHUFFLED" else by
    df = df.withColumn("__by", key)
    keys = [_DIRECTIONS[direction](F.col("__by")), F.col(tie).asc()]
    narrow = None if direction == "SHUFFLED" else [SOURCE, "__by", tie]
    return ranked(df, SOURCE, keys, POSITION, offset, limit, ties=True, sizes=sizes, narrow=narrow).drop("__by")


def _reference_list(store: Store, f: Field, links: DataFrame, pick: _Pick) -> Result:
    child = store.catalog.model(f.ref_model)
    options = pick.options
    rows = filter_model(store, child.name, store.scan(child.name), options.get("filter"))
    rows = links.join(rows, F.col("_target") == F.col(child.pk)).drop("_target")
    order = _order(options)
    by = child.field(order[0]).name if order and order[0] else child.pk
    # Trim before populating, so that only kept elements are joined further.
    rows = _ranked_list(rows, options, order, F.col(by), child.pk, links)
    carry = [c for c in (SOURCE, POSITION) if c in rows.columns]
    records, pending, raw = project(store, child, rows, pick.select, carry)
    return _attach(records, child.pk, pending, _among(records, rows.select(child.pk), raw))


def _value_list(f: Field, links: DataFrame, pick: _Pick) -> Result:
    rows = links.withColumnRenamed("_target", VALUE)
    rows = filter_values(rows, VALUE, f.type.of, pick.options.get("filter"))
    rows = _ranked_list(rows, pick.options, _order(pick.options), F.col(VALUE), VALUE, links)
    columns = [c for c in (SOURCE, POSITION, VALUE) if c in rows.columns]
    return Result(rows.select(*columns), VALUE)


# -- entry points ----------------------------------------------------------


def read(store: Store, model: str, pk, select=None) -> Result:
    """The record whose primary key is ``pk``; raises ``RecordNotFound`` when there is none.

    Of a stored table, and of the lists of the record, only files that may hold the key are opened.
    """
    m = store.catalog.model(model)
    key = F.lit(pk).cast(store.catalog.value_type(m.primary.type))
    found = store.lookup(model, key)
    if found.select(m.pk).isEmpty():
        raise RecordNotFound(f"{model} of key {pk!r} does not exist")
    records, pending, raw = project(store, m, found, select)

    def restrict(parent_key: str):
        return key if parent_key == raw else _among(records)(parent_key)

    return _attach(records, m.pk, pending, restrict)


def read_many(store: Store, model: str, keys: DataFrame, select=None) -> Result:
    """The records whose primary key occurs in ``keys`` (its first column)."""
    m = store.catalog.model(model)
    wanted = keys.select(F.col(f"`{keys.columns[0]}`").alias("__wanted"))
    base = store.scan(model).join(wanted, F.col(m.pk) == F.col("__wanted"), "left_semi")
    records, pending, raw = project(store, m, base, select)
    return _attach(records, m.pk, pending, _among(records, base.select(m.pk), raw))


def populated(store: Store, model: str, rows: DataFrame, select=None) -> Result:
    """Given records of the model (its stored columns) with the selected fields looked up in the store.

    A record that is given more than once stays so; its lists belong to its key and come once.
    """
    m = store.catalog.model(model)
    records, pending, raw = project(store, m, rows, select)
    return _attach(records, m.pk, pending, _among(records, rows.select(m.pk), raw))


def list_(
    store: Store,
    model: str,
    filter=None,
    order_by=None,
    from_: int | None = None,
    to: int | None = None,
    select=None,
) -> Result:
    """Records that pass ``filter``, ordered and ranged, with the selected fields.

    ``from_`` is the 1-based first row, ``to`` the number of rows. Ties are
    broken by the primary key.
    """
    m = store.catalog.model(model)
    options = {"from_": from_, "to": to, "order_by": order_by}
    order = _order(options)
    offset, limit = _range(options)
    ranged = offset > 0 or limit is not None
    base = filter_model(store, model, store.scan(model), filter)
    sort, carry = [], []
    known = None
    if ranged and not filter and order is not None and order[0] is not None and order[1] != "SHUFFLED":
        if not m.field(order[0]).secret_credential:
            known = ordered_page(store, model, m.field(order[0]).name, order[1], offset, limit)
    if known is not None:
        base, sort, carry = _kept_page(store, m, known, limit)
    elif order is not None:
        name, direction = order
        if name is not None and m.field(name).secret_credential:
            raise DefinitionError(f"`{model}.{name}` is secret")
        by = F.rand() if direction == "SHUFFLED" else F.col(m.field(name).name if name else m.pk)
        base, carry = base.withColumn("__by", by), ["__by"]
        sort = [_DIRECTIONS[direction](F.col("__by"))]
    if known is None:
        sort.append(F.col(m.pk).asc())
    if ranged and known is None:
        base, sort, carry = _page(base, m.pk, sort, offset, limit, order is not None and order[1] == "SHUFFLED")
    elif order is not None and known is None:
        base, carry = base.withColumn("__tie", F.col(m.pk)), [*carry, "__tie"]
        sort[-1] = F.col("__tie").asc()
    records, pending, raw = project(store, m, base, select, carry)
    narrowed = ranged or bool(filter)
    keys = base.select(m.pk)
    if ranged and any(p.parent_key == raw for p in pending):
        keys = checkpointed(keys)  # a page is found once, however many lists hang on it
    # Stored links have sources that exist (see quality.check_refs), so an
    # unfiltered list needs no semi-join.
    result = _attach(records, m.pk, pending, _among(records, keys, raw) if narrowed else None, carry)
    if ranged or order is not None:
        result.sort = sort
        result.records = _without(records.orderBy(*sort), result.hidden)
    return result


# Records of a page up to which the files that hold them are looked up first.
_PAGE_KEYS = 1_000


def _kept_page(store: Store, m: Model, known: DataFrame, limit: int | None) -> tuple[DataFrame, list[Column], list[str]]:
    """The records of a page whose keys and places (``key``, ``row``) a kept order has given."""
    rows = known.select(F.col("key").alias("__key"), F.col("row").alias("__row"))
    if limit is not None and limit <= _PAGE_KEYS:
        rows = F.broadcast(checkpointed(rows))
        base = store.holding(m.name, rows.select("__key"))
    else:
        base = store.scan(m.name)
    return base.join(rows, F.col(m.pk) == F.col("__key")).drop("__key"), [F.col("__row").asc()], ["__row"]


def _page(
    df: DataFrame, pk: str, sort: list[Column], offset: int, limit: int | None, drawn: bool
) -> tuple[DataFrame, list[Column], list[str]]:
    """The rows of a page, how to sort them, and the columns that sort needs."""
    if limit is not None and offset + limit <= GLOBAL_LIMIT_ROWS:
        page = df.orderBy(*sort).offset(offset).limit(limit).withColumn("__tie", F.col(pk))
        if drawn:
            page = checkpointed(page)  # the nested lists must see the same draw
        by = [c for c in ("__by", "__tie") if c in page.columns]
        return page, [*sort[:-1], F.col("__tie").asc()], by
    # A long page or an open end would pass through one task as a global limit. Only keys and
    # sort values are numbered; the records are looked up, and the number is their order.
    keys = df.select(*[c for c in (pk, "__by") if c in df.columns])
    rows = number_rows(keys, sort, "__row").where(F.col("__row") > offset)
    if limit is not None:
        rows = rows.where(F.col("__row") <= offset + limit)
    rows = rows.select(F.col(pk).alias("__key"), "__row")
    page = df.drop("__by").join(rows, F.col(pk) == F.col("__key")).drop("__key")
    return page, [F.col("__row").asc()], ["__row"]


# -- aggregates ------------------------------------------------------------


def next_key(df: DataFrame, field: str) -> DataFrame:
    """One row: the next free key, MAX + 1 or 1 when there is no record."""
    return df.agg((F.coalesce(F.max(field), F.lit(0)) + 1).cast("bigint").alias("next_key"))


def exists_data(store: Store) -> DataFrame:
    """Per model: does it hold any record? Reads at most one row of each."""
    parts = []
    for m in store.catalog.models:
        one = store.scan(m.name, [m.pk]).limit(1).agg(F.count("*").alias("n"))
        parts.append(one.select(F.lit(m.name).alias("model"), (F.col("n") > 0).alias("has_data")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
