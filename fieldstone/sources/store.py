"""A store names the DataFrames behind a catalog: one per model, one per array field.

On disk a store is a folder of parquet versions. A version writes only the files
whose rows changed (see ``files``); its row in the history (see ``history``) comes
last and says where every table of that version lies, so readers see all of it or none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import Catalog
from fieldstone.session import local_frame, tune
from fieldstone.sources import derived as kept
from fieldstone.sources import history
from fieldstone.sources.derived import Derived
from fieldstone.sources.files import Edit, edited, files_holding, files_with, folder_of, frame_of, manifest, rewrite, write_table
from fieldstone.sources.history import LEASE, VersionConflict, last_version, remove_folders

LinkKey = tuple[str, str]
# A frame, or how to open it when it is first scanned.
Table = DataFrame | Callable[[], DataFrame]

# Tables of a version that are written at the same time.
WRITERS = 8

# A number that was handed out, or how to find it when it is needed.
Mark = int | Callable[[], int]


@dataclass
class Changes:
    """New frames for the tables an operation touched, and what it returns.

    ``edits`` say the same as functions of the tables' rows, by the tables' names, so that a stored table
    need not be rewritten whole; ``footprint`` lists what was changed and what was relied on;
    ``sequences`` holds the highest number ever used of automatic fields.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    links: dict[LinkKey, DataFrame] = field(default_factory=dict)
    result: object = None
    edits: dict[str, list[Edit]] = field(default_factory=dict)
    footprint: list[DataFrame] | None = None
    sequences: dict[str, Mark] = field(default_factory=dict)


@dataclass(frozen=True)
class Trail:
    """Edits of a table since the state at a location."""

    location: str
    edits: tuple[Edit, ...]


class Store:
    def __init__(
        self,
        spark: SparkSession,
        catalog: Catalog,
        tables: Mapping[str, Table] | None = None,
        links: Mapping[LinkKey, Table] | None = None,
        path: str | None = None,
        locations: Mapping[str, str] | None = None,
        version: int = 0,
        sequences: Mapping[str, Mark] | None = None,
        file_rows: int | None = None,
        derived: Mapping[str, Derived | None] | None = None,
    ):
        self.spark = tune(spark)
        self.catalog = catalog
        self.tables = dict(tables or {})
        self.link_tables = dict(links or {})
        self.path = path
        # Tables that still equal what lies at a location.
        self.locations = dict(locations or {})
        # The published version it derives from; 0 for none.
        self.version = version
        self.sequences = dict(sequences or {})
        # Rows of a file at most; Spark's settings alone decide if it is None.
        self.file_rows = file_rows
        # Orders and counts that are kept with its versions; None for those that the next one makes.
        self.derived = dict(derived or {})
        # Where that version's tables lie, what has been edited since then, and what of it is not written.
        self._published = dict(self.locations)
        self._trails: dict[str, Trail] = {}
        self._pending: dict[str, Trail] = {}
        # Marks of the changes since that version; None once a change left none.
        self._footprint: list[DataFrame] | None = []

    # -- scans ---------------------------------------------------------

    def scan(self, model: str, fields: Iterable[str] | None = None) -> DataFrame:
        """The model's table, only the named columns."""
        m = self.catalog.model(model)
        df = _opened(self.tables, model)
        if df is None:
            df = local_frame(self.spark, [], self.catalog.struct(model))
        names = [f.name for f in m.stored] if fields is None else list(fields)
        return df.select(*names)

    def links(self, model: str, field: str) -> DataFrame:
        """The array field's link table (source, target)."""
        f = self.catalog.model(model).field(field)
        if not f.is_array:
            raise ValueError(f"`{model}.{field}` is not an array")
        df = _opened(self.link_tables, (model, field))
        if df is None:
            return local_frame(self.spark, [], self.catalog.link_struct(model, field))
        return df.select("source", "target")

    # -- composition ---------------------------------------------------

    def apply(self, changes: Changes) -> Store:
        """The store as it is after the changes."""
        touched = set(changes.tables) | {_link_name(k) for k in changes.links}
        after = self._copy(
            tables={**self.tables, **changes.tables},
            links={**self.link_tables, **changes.links},
            locations={k: v for k, v in self.locations.items() if k not in touched},
            sequences={**self.sequences, **changes.sequences},
        )
        for name in touched:
            edits = tuple(changes.edits.get(name, ()))
            place = self.locations.get(name)
            pending = self._pending.get(name) or (Trail(place, ()) if place else None)
            trail = self._trails.get(name) or (Trail(place, ()) if place and place == self._published.get(name) else None)
            for held, known in ((after._pending, pending), (after._trails, trail)):
                held.pop(name, None)
                if known and edits:
                    held[name] = Trail(known.location, known.edits + edits)
        if touched and self.path is not None:
            known = self._footprint is not None and changes.footprint is not None
            after._footprint = [*self._footprint, *changes.footprint] if known else None
        return after

    def _copy(self, **changes) -> Store:
        """A copy that derives from the same version in the same way."""
        values = dict(
            catalog=self.catalog,
            tables=self.tables,
            links=self.link_tables,
            path=self.path,
            locations=self.locations,
            version=self.version,
            sequences=self.sequences,
            file_rows=self.file_rows,
            derived=self.derived,
        )
        values.update(changes)
        other = Store(self.spark, **values)
        other._published, other._footprint = self._published, self._footprint
        other._trails, other._pending = dict(self._trails), dict(self._pending)
        return other

    def replaced(self, **changes) -> Store:
        """A copy with some of catalog, tables, links or locations replaced. How its tables came about is
        not known any more, so it can be published but not put on top of another writer's version."""
        other = self._copy(**changes)
        other._trails, other._pending, other._footprint, other.derived = {}, {}, None, {}
        return other

    # -- look-ups by key -------------------------------------------------

    def lookup(self, model: str, key: Column, fields: Iterable[str] | None = None) -> DataFrame:
        """The model's rows of one key. Of a stored table only the files whose range holds the key are opened."""
        pk = self.catalog.model(model).pk
        return self._near(model, key, fields).where(F.col(f"`{pk}`") == key)

    def _near(self, model: str, key: Column, fields: Iterable[str] | None) -> DataFrame:
        if model not in self.locations:
            return self.scan(model, fields)
        files = files_with(self.spark, self.locations[model], key)
        df = _declared(frame_of(self.spark, self.locations[model], files), self.catalog.struct(model))
        return df if fields is None else df.select(*fields)

    def holding(self, model: str, keys: DataFrame) -> DataFrame:
        """The part of a stored table whose files may hold one of a few keys."""
        files = files_holding(self.spark, self.locations[model], keys)
        return _declared(frame_of(self.spark, self.locations[model], files), self.catalog.struct(model))

    def links_of(self, model: str, field: str, source: Column) -> DataFrame:
        """The array field's links of one record, from the files that may hold them."""
        name = _link_name((model, field))
        if name not in self.locations:
            return self.links(model, field).where(F.col("source") == source)
        files = files_with(self.spark, self.locations[name], source)
        df = frame_of(self.spark, self.locations[name], files)
        return _declared(df, self.catalog.link_struct(model, field)).where(F.col("source") == source)

    def sequence(self, model: str, field: str) -> int:
        """The highest number ever used in an automatic field, 0 for none. It is kept with every version and
        looked for in the rows only while no version knows it, so numbers of deleted records stay used."""
        name = _link_name((model, field))
        mark = self.sequences.get(name)
        if mark is None:
            m = self.catalog.model(model)
            known = field == m.pk and model in self.locations
            rows = manifest(self.spark, self.locations[model]) if known else self.scan(model, [field])
            mark = rows.agg(F.max("greatest" if known else field).alias("m")).first()["m"] or 0
        elif callable(mark):
            mark = mark()
        self.sequences[name] = mark
        return mark

    # -- kept orders and counts ------------------------------------------

    def keep_order(self, model: str, field: str, direction: str = "ASCENDING") -> Store:
        """From the next published version on, pages of the model in this order are found without sorting it."""
        m = self.catalog.model(model)
        if direction not in ("ASCENDING", "DESCENDING") or m.field(field).is_array:
            raise ValueError(f"`{model}` cannot be kept in the order of `{field}` {direction}")
        return self._copy(derived={kept.order_name(model, field, direction): None} | self.derived)

    def keep_counts(self, model: str, field: str) -> Store:
        """From the next published version on, lengths of the array are read, not counted."""
        if not self.catalog.model(model).field(field).is_array:
            raise ValueError(f"`{model}.{field}` is not an array")
        return self._copy(derived={kept.count_name(model, field): None} | self.derived)

    def _derived(self) -> dict[str, Derived]:
        """What is kept, as of these locations: made where it is missing or has been outgrown."""
        current = {}
        for name, known in self.derived.items():
            base = kept.base_name(name)
            location = self.locations[base]
            if known is None or kept.outgrown(self, known, location):
                folder = f"{self.path}/v{self.version + 1}/{base}-kept-{uuid.uuid4().hex}"
                known = kept.make(self, name, location, folder)
            current[name] = known
        return current

    # -- versions on disk ----------------------------------------------

    @staticmethod
    def versions(spark: SparkSession, path: str) -> DataFrame:
        """The version history, one row per published version."""
        return history.versions(spark, path)

    @staticmethod
    def open(
        spark: SparkSession, path: str, catalog: Catalog | None = None, version: int | None = None, file_rows: int | None = None
    ) -> Store:
        """Open a published version (the newest by default)."""
        number = version if version is not None else last_version(spark, path)
        row = Store.versions(spark, path).where(F.col("version") == number).first() if number else None
        if row is None:
            raise ValueError(f"no such version in {path}")
        catalog = catalog or Catalog.from_dict(json.loads(row["catalog"]))
        locations = dict(row["tables"])
        return Store(
            spark, catalog, path=path, locations=locations, version=number, sequences=row["sequences"],
            derived={k: Derived(*json.loads(v)) for k, v in (row["derived"] or {}).items()}, file_rows=file_rows, **_opened_at(spark, catalog, locations),
        )

    def publish(self, path: str | None = None, rebase: bool = False, lease: float = LEASE) -> Store:
        """Write what changed as a new version and open it.

        Files that no change touches are referred to, not rewritten. Nothing is visible until the version's
        row is there. If another writer has published since this store was opened, ``VersionConflict`` is
        raised and nothing is lost. With ``rebase`` the changes are then put on top of the newest version,
        as if they had been made there, unless both concern the same records, values or references.
        """
        target = self
        if path is not None and path != self.path:
            target = self.replaced(path=path, locations={}, version=last_version(self.spark, path))
            target._published, target.derived = {}, dict.fromkeys(self.derived)
        for m in self.catalog.models:
            if any(callable(hook) for hook in (*m.on_write, *m.on_read, *m.on_delete)):
                raise ValueError(f"`{m.name}` has a hook without a name: register it and give its name to publish")
        owner = uuid.uuid4().hex
        while True:
            newest = last_version(self.spark, target.path)
            if newest != target.version:
                if not rebase:
                    raise VersionConflict(f"version {newest} of {target.path} is newer than version {target.version}")
                target = target.rebased(newest)
            version, before = target.version + 1, set(target.locations.values())
            settled = target.settle()
            footprint, derived = settled._written_footprint(version), settled._derived()
            try:
                claim = history.claim_version(self.spark, settled.path, version, owner, lease)
                try:
                    row = {
                        "catalog": json.dumps(self.catalog.to_dict()),
                        "tables": settled.locations,
                        "sequences": settled._known_sequences(),
                        "derived": {k: json.dumps([d.location, d.base]) for k, d in derived.items()},
                        "footprint": footprint,
                    }
                    history.record_version(self.spark, settled.path, version, row)
                finally:
                    history.release(self.spark, claim)
                break
            except VersionConflict:
                fresh = {d.location for k, d in derived.items() if d != self.derived.get(k)}
                written = {folder_of(x) for x in (set(settled.locations.values()) - before) | fresh}
                remove_folders(self.spark, written | ({footprint} if footprint else set()))
                if not rebase or last_version(self.spark, target.path) == target.version:
                    raise
        return Store.open(self.spark, settled.path, self.catalog, version, self.file_rows)

    def _written_footprint(self, version: int) -> str | None:
        """Where the marks of this version are; None if its changes left none."""
        if self._footprint is None or not self.version:
            return None
        empty = local_frame(self.spark, [], history.FOOTPRINT)
        place = f"{self.path}/v{version}/_footprint-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, self._footprint, empty).distinct().write.parquet(place)
        return place

    def _known_sequences(self) -> dict[str, int]:
        automatic = [(m.name, f.name) for m in self.catalog.models for f in m.stored if f.auto_increment]
        return {_link_name(k): self.sequence(*k) for k in automatic}

    def rebased(self, version: int) -> Store:
        """The changes since the version this store derives from, on top of a newer one.

        The marks of both are compared first. Tables that only this store changed are taken as they are;
        edits of the others are carried out once more, on the newer rows.
        """
        newer = Store.open(self.spark, self.path, version=version, file_rows=self.file_rows)
        changed = {k for k in {*self.locations, *self._table_names()} if self.locations.get(k) != self._published.get(k)}
        rows = Store.versions(self.spark, self.path).where((F.col("version") > self.version) & (F.col("version") <= version))
        places = [r["footprint"] for r in rows.select("footprint").collect()]  # one for each version in between
        same = self.catalog.to_dict() == newer.catalog.to_dict()
        if not same or self._footprint is None or None in places or changed - set(self._trails):
            raise VersionConflict(f"version {version} of {self.path} is newer, and these changes cannot be put on top of it")
        if self._footprint:
            others = self.spark.read.schema(history.FOOTPRINT).parquet(*places)
            found = history.clashes(self.spark, reduce(DataFrame.unionByName, self._footprint), others).take(3)
            if found:
                named = ", ".join(f"{r['name']} {r['value']}" for r in found)
                raise VersionConflict(f"a newer version of {self.path} concerns the same: {named}")
        after = newer._copy(derived=self.derived | newer.derived)
        after._footprint = self._footprint
        for name in changed:
            trail, key = self._trails[name], tuple(name.split("."))
            tables, own, kind = (
                (after.link_tables, self.link_tables, key) if len(key) == 2 else (after.tables, self.tables, name)
            )
            place = after.locations.pop(name)
            after._trails[name] = Trail(place, trail.edits)
            if place == trail.location:
                tables[kind] = own[kind]
                if name in self.locations:
                    after.locations[name] = self.locations[name]
                else:
                    after._pending[name] = self._pending[name]
            else:
                tables[kind] = edited(newer.links(*key) if len(key) == 2 else newer.scan(name), trail.edits)
                after._pending[name] = Trail(place, trail.edits)
        for name, mark in self.sequences.items():
            model, _, field_name = name.partition(".")
            after.sequences[name] = max(newer.sequence(model, field_name), mark() if callable(mark) else mark)
        return after

    def _table_names(self) -> list[str]:
        return [n for m in self.catalog.models for n in (m.name, *[_link_name((m.name, f.name)) for f in m.arrays])]

    def settle(self) -> Store:
        """Write what no location holds, without making it visible."""
        if self.path is None:
            raise ValueError("the store has no path")
        names = [n for n in self._table_names() if n not in self.locations]
        # Independent jobs; small tables fill the executors that a large one leaves idle.
        with ThreadPoolExecutor(max_workers=WRITERS) as pool:
            locations = {**self.locations, **dict(pool.map(lambda n: (n, self._write(n)), names))}
        settled = self._copy(locations=locations, **_opened_at(self.spark, self.catalog, locations))
        settled._pending = {}
        return settled

    def _write(self, name: str) -> str:
        """Persist one table (a model's, or an array's as ``Model.field``); returns its location."""
        # The random part keeps two writers of one version apart and never
        # overwrites a folder that this very job reads.
        folder = f"{self.path}/v{self.version + 1}/{name}-{uuid.uuid4().hex}"
        model, _, array = name.partition(".")
        m = self.catalog.model(model)
        key, unique = ("source", ()) if array else (m.pk, tuple(f.name for f in m.stored if f.is_unique and not f.primary))
        if name in self._pending:
            trail = self._pending[name]
            declared = self.catalog.link_struct(model, array) if array else self.catalog.struct(model)
            return rewrite(self.spark, trail.location, trail.edits, folder, key, lambda df: _declared(df, declared), self.file_rows, unique)
        return write_table(self.links(model, array) if array else self.scan(model), folder, key, self.file_rows, unique)


def _link_name(key: LinkKey) -> str:
    return f"{key[0]}.{key[1]}"


def _opened_at(spark: SparkSession, catalog: Catalog, locations: Mapping[str, str]) -> dict:
    """Readers for the tables of a catalog that have a location."""
    tables, links = {}, {}
    for m in catalog.models:
        if m.name in locations:
            tables[m.name] = _reader(spark, locations[m.name], catalog.struct(m.name))
        for f in m.arrays:
            name = _link_name((m.name, f.name))
            if name in locations:
                links[(m.name, f.name)] = _reader(spark, locations[name], catalog.link_struct(m.name, f.name))
    return {"tables": tables, "links": links}


def _opened(tables: dict, key) -> DataFrame | None:
    table = tables.get(key)
    if table is not None and not isinstance(table, DataFrame):
        table = tables[key] = table()
    return table


def _reader(spark: SparkSession, location: str, declared: T.StructType) -> Callable[[], DataFrame]:
    return lambda: _declared(frame_of(spark, location), declared)


def _declared(df: DataFrame, declared: T.StructType) -> DataFrame:
    """Types are as stored (a Date may be a timestamp); the metadata is as declared."""
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in declared])
