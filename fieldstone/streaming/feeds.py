"""Subscriptions to records and change feeds, in batch and on streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from fieldstone.catalog import Catalog
from fieldstone.operators.predicates import filter_model
from fieldstone.operators.query import Result, populated, project
from fieldstone.session import checkpointed, tune
from fieldstone.sources.files import files_apart, frame_of
from fieldstone.sources.store import Store

NEW, CHANGE, REMOVE = "NEW", "CHANGE", "REMOVE"


def stream_read(sdf: DataFrame, store: Store, model: str, pk, select=None) -> DataFrame:
    """Every arriving version of one record, with the selected fields."""
    m = store.catalog.model(model)
    key = F.lit(pk).cast(store.catalog.value_type(m.primary.type))
    return _selected(sdf.where(F.col(m.pk) == key), store, model, select)


def stream_list(sdf: DataFrame, store: Store, model: str, filter=None, select=None) -> DataFrame:
    """Arriving records that pass the filter. References are looked up in the store's
    tables; there is no order or range over a stream."""
    return _selected(filter_model(store, model, sdf, filter), store, model, select)


def _selected(sdf: DataFrame, store: Store, model: str, select) -> DataFrame:
    records, lists, _ = project(store, store.catalog.model(model), sdf, select)
    if lists:
        raise ValueError("a stream cannot populate to-many fields")
    return records.drop("__raw")


def subscribe(
    sdf: DataFrame, path: str, model: str, deliver: Callable[[Result, int], None], filter=None, select=None, pk=None
) -> DataStreamWriter:
    """A stream of records that are looked up anew in every micro-batch.

    Each batch opens the newest version of the store at ``path``, fills to-one and to-many fields from it and
    gives the result to ``deliver`` with the batch's number, so a change of a referenced record shows in the next
    batch. ``filter`` and ``pk`` choose among the arriving records. The batch is written once, since several
    frames of the result read it. Start the returned writer, with a checkpoint location of its own.
    """

    def batch(rows: DataFrame, number: int) -> None:
        store = Store.open(rows.sparkSession, path)
        m = store.catalog.model(model)
        arrived = filter_model(store, model, checkpointed(rows), filter)
        if pk is not None:
            arrived = arrived.where(F.col(m.pk) == F.lit(pk).cast(store.catalog.value_type(m.primary.type)))
        deliver(populated(store, model, arrived, select), number)

    return sdf.writeStream.foreachBatch(batch)


def change_feed(prev: DataFrame, curr: DataFrame, catalog: Catalog, model: str) -> DataFrame:
    """What happened between two snapshots: key, ``event``, ``before`` and ``after``."""
    m = catalog.model(model)
    columns = [f.name for f in m.stored if f.name in curr.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        record = F.struct(*[F.col(f"`{c}`") for c in columns])
        return df.select(F.col(f"`{m.pk}`").alias(f"__{name}"), record.alias(name))

    joined = side(prev, "before").join(side(curr, "after"), F.col("__before") == F.col("__after"), "full")
    event = (
        F.when(F.col("__before").isNull(), F.lit(NEW))
        .when(F.col("__after").isNull(), F.lit(REMOVE))
        .when(~F.col("before").eqNullSafe(F.col("after")), F.lit(CHANGE))
    )
    key = F.coalesce("__before", "__after").alias(m.pk)
    return joined.select(key, event.alias("event"), "before", "after").where(F.col("event").isNotNull())


def version_feed(spark: SparkSession, path: str, model: str, since: int, until: int | None = None) -> DataFrame:
    """What happened to a model's records between two published versions, as ``change_feed`` tells it.

    The manifests of both are compared first. A record in a file that both refer to is the same in both, so
    only the files of one side are read and joined.
    """
    old, new = (Store.open(spark, path, version=v) for v in (since, until))
    kept = old.catalog.by_index(new.catalog.model(model).index)
    fields = new.catalog.model(model).stored
    if kept is None:
        prev = new.scan(model).where(F.lit(False))
        return change_feed(prev, new.scan(model), new.catalog, model)
    before, after = old.locations[kept.name], new.locations[model]
    gone, fresh = files_apart(spark, before, after)
    prev, curr = frame_of(spark, before, gone), frame_of(spark, after, fresh)
    # A field is the one of the same index, whatever it was called; a new one was null.
    was = {f.name: kept.by_index(f.index) for f in fields}
    columns = [
        (F.col(f"`{was[f.name].name}`") if was[f.name] is not None and not was[f.name].is_array else F.lit(None))
        .cast(curr.schema[f.name].dataType)
        .alias(f.name)
        for f in fields
    ]
    return change_feed(prev.select(*columns), curr, new.catalog, model)


def stream_changes(sdf: DataFrame, catalog: Catalog, model: str, tombstone_ms: int | None = None) -> DataFrame:
    """The same events from a stream of upserts and deletes.

    ``sdf`` has the model's columns, ``_op`` ("upsert" or "delete") and ``_seq``,
    the order of changes to a record. Per trigger a record yields its net change;
    what is older than the last change seen is ignored. A removal carries the
    last known record. It is remembered, so that a late change does not bring the record
    back, for ``tombstone_ms``; for ever without it. With it the stream runs on processing
    time and never counts as finished, so it suits streams that run all the time.
    """
    m = catalog.model(model)
    fields = [f for f in sdf.schema if m.has(f.name)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    key = T.StructField("__key", sdf.schema[m.pk].dataType)
    record = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in fields]), {"ignoreNullFields": "false"})
    rows = sdf.select(
        F.col(f"`{m.pk}`").alias("__key"),
        F.col("_seq").cast("bigint").alias("seq"),
        (F.col("_op") == "delete").alias("gone"),
        record.alias("record"),
    )
    # A map-side combine: a hot key sends one row per batch, not all its rows.
    rows = rows.mapInPandas(_latest_rows(), rows.schema)
    tune(sdf.sparkSession)  # state of this kind lives in RocksDB
    events = rows.groupBy("__key").transformWithStateInPandas(
        statefulProcessor=_change_processor(tombstone_ms),
        outputStructType=T.StructType(
            [key, T.StructField("event", T.StringType()), T.StructField("record", T.StringType())]
        ),
        outputMode="Append",
        timeMode="None" if tombstone_ms is None else "ProcessingTime",
    )
    return events.select(F.col("event"), F.from_json("record", schema).alias("record")).select("event", "record.*")


# The two below are made by functions so that they travel to workers by value.


def _latest_rows():
    def latest(batches):
        for batch in batches:
            yield batch.sort_values("seq", kind="stable").drop_duplicates("__key", keep="last")

    return latest


def _change_processor(tombstone_ms: int | None) -> StatefulProcessor:
    new, change, remove = NEW, CHANGE, REMOVE

    class Changes(StatefulProcessor):
        def init(self, handle) -> None:
            self.live = handle.getValueState("live", "seq bigint, record string")
            # Keeps the order of a removed record.
            self.gone = handle.getValueState("gone", "seq bigint", ttlDurationMs=tombstone_ms)

        def handleInputRows(self, key, rows, timerValues):
            live = self.live.get() if self.live.exists() else None
            gone = self.gone.get() if self.gone.exists() else None
            seen = max([s[0] for s in (live, gone) if s is not None], default=None)
            last = pd.concat([batch.loc[[batch["seq"].idxmax()]] for batch in rows])
            last = last.sort_values("seq").tail(1)
            seq, removed, record = int(last["seq"].iloc[0]), bool(last["gone"].iloc[0]), last["record"].iloc[0]
            if seen is not None and seq <= seen:
                return
            was, now = None if live is None else live[1], None if removed else record
            if removed:
                self.live.clear()
                self.gone.update((seq,))
            else:
                self.live.update((seq, record))
                self.gone.clear()
            if was == now:
                return
            event = new if was is None else remove if now is None else change
            yield pd.DataFrame({"__key": [key[0]], "event": [event], "record": [was if now is None else now]})

        def close(self) -> None:
            pass

    return Changes()
