"""Change feeds and subscriptions; streams run until their input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstone.catalog import FLOAT, INT, Catalog, Field, Model
from fieldstone.plans.registry import query
from fieldstone.session import scratch_path
from fieldstone.sources.warehouse import EVENT, open_warehouse
from fieldstone.streaming.feeds import change_feed, stream_changes, stream_list, stream_read

STATUS = Catalog(
    (
        Model(
            "Status",
            1,
            (Field("user", INT, 1, primary=True), Field("event_type", EVENT, 2), Field("value", FLOAT, 3)),
        ),
    )
)
# The month of events is looked at before and after its middle.
_MIDDLE = "2024-01-16"

_STATUS_SQL = f"""
WITH half AS (SELECT user_id, event_id, event_type, value, ts >= TIMESTAMP '{_MIDDLE}' AS late FROM events),
was AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
        FROM half WHERE NOT late GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'),
last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
         FROM half WHERE late GROUP BY user_id),
later AS (
  SELECT coalesce(was.user_id, last.user_id) AS user_id,
         CASE WHEN last.user_id IS NULL THEN NULL
              WHEN last.event_type = 'error' THEN CASE WHEN was.user_id IS NOT NULL THEN 'REMOVE' END
              WHEN was.user_id IS NULL THEN 'NEW'
              WHEN was.event_type <> last.event_type OR was.value <> last.value THEN 'CHANGE' END AS event,
         was.event_type AS old_type, was.value AS old_value, last.event_type AS new_type, last.value AS new_value
  FROM was FULL JOIN last ON was.user_id = last.user_id)
"""


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = open_warehouse(spark, folder).scan("Event", ["event_id", "ts", "user", "event_type", "value"])
    middle = F.lit(_MIDDLE).cast("timestamp_ntz")
    return events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)


def _latest(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("event_type", "value"), "event_id").alias("s")
    return events.groupBy("user").agg(last).select("user", "s.event_type", "s.value")


@query(
    _STATUS_SQL
    + """
    SELECT user_id AS "user", event, old_type, CASE WHEN event <> 'REMOVE' THEN new_type END AS new_type
    FROM later WHERE event IS NOT NULL
    """,
    name="change_feed",
)
def change_events(spark, folder):
    """Every user's last status at mid-month and at the end; an error ends the status."""
    early, late = _halves(spark, folder)
    prev = _latest(early).where("event_type <> 'error'")
    last = _latest(late)
    unchanged = prev.join(last.select("user"), "user", "left_anti")
    curr = last.where("event_type <> 'error'").unionByName(unchanged)
    feed = change_feed(prev, curr, STATUS, "Status")
    return feed.select(
        "user", "event", F.col("before.event_type").alias("old_type"), F.col("after.event_type").alias("new_type")
    )


@query(
    """
    SELECT n_nationkey::BIGINT AS c_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer
    ON c_nationkey = n_nationkey AND n_nationkey = 7 GROUP BY 1
    """
)
def change_none(spark, folder):
    """A snapshot compared with one in which one nation's customers are richer: no other nation has events."""
    store = open_warehouse(spark, folder)
    before = store.scan("Customer")
    richer = F.when(F.col("nation") == 7, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    feed = change_feed(before, before.withColumn("c_acctbal", richer), store.catalog, "Customer")
    changed = feed.groupBy(F.col("before.nation").alias("c_nationkey")).agg(F.count("*").alias("n"))
    nations = store.scan("Nation", ["n_nationkey"]).select(F.col("n_nationkey").alias("c_nationkey"))
    return nations.join(changed, "c_nationkey", "left").select(F.col("c_nationkey").cast("bigint"), F.coalesce("n", F.lit(0)).alias("n"))


def _stream(spark: SparkSession, folder: str, name: str, model: str, columns: dict[str, str]) -> DataFrame:
    """A table as a stream of files, with the model's column names and types."""
    raw = spark.read.parquet(f"{folder}/{name}.parquet").schema
    schema = open_warehouse(spark, folder).scan(model).schema
    sdf = spark.readStream.schema(raw).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return sdf.select(*[F.col(columns.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in schema])


def _run(sdf: DataFrame, path: str, checkpoint: str) -> None:
    """Write a stream to parquet until its input is used up."""
    writer = sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    stream = writer.trigger(availableNow=True).start(path)
    try:
        stream.awaitTermination()
    finally:
        stream.stop()


def _drained(spark: SparkSession, sdf: DataFrame) -> DataFrame:
    path = scratch_path(spark, "stream")
    _run(sdf, path, scratch_path(spark, "stream-checkpoint"))
    return spark.read.schema(sdf.schema).parquet(path)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 7", name="stream_read")
def stream_one(spark, folder):
    """A subscription to one order."""
    store = open_warehouse(spark, folder)
    orders = _stream(spark, folder, "orders", "Order", {"customer": "o_custkey"})
    return _drained(spark, stream_read(orders, store, "Order", 7, ["o_totalprice", "o_orderstatus"]))


@query(
    """
    SELECT event_id, value, c_name FROM events JOIN customer ON c_custkey = user_id
    WHERE event_type = 'purchase' AND value > 50 AND ts > TIMESTAMP '2024-01-03' AND c_acctbal > 0
    """,
    name="stream_list",
)
def stream_filtered(spark, folder):
    """A subscription to a filtered list, with the user looked up in a table."""
    store = open_warehouse(spark, folder)
    events = _stream(spark, folder, "events", "Event", {"user": "user_id"})
    filters = [
        {"event_type": {"eq": "purchase"}, "value": {"gt": 50}, "ts": {"after": "2024-01-03T00:00:00Z"}},
        {"user": {"c_acctbal": {"gt": 0}}},
    ]
    sdf = stream_list(events, store, "Event", filters, ["value", {"user": ["c_name"]}])
    return _drained(spark, sdf).select("event_id", "value", "user.c_name")


@query(
    _STATUS_SQL
    + """
    SELECT user_id AS "user", 'NEW' AS event, event_type FROM was
    UNION ALL SELECT user_id, event, CASE WHEN event = 'REMOVE' THEN old_type ELSE new_type END
    FROM later WHERE event IS NOT NULL
    """,
    name="stream_changes",
)
def stream_events(spark, folder):
    """The events as a live feed: the first half of the month, then, resumed, the second."""
    source = scratch_path(spark, "status")
    path, checkpoint = scratch_path(spark, "feed"), scratch_path(spark, "feed-checkpoint")
    changes = None
    for half in _halves(spark, folder):
        op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
        rows = half.select("user", "event_type", "value", op.alias("_op"), F.col("event_id").alias("_seq"))
        rows.write.mode("append").parquet(source)
        sdf = spark.readStream.schema(rows.schema).parquet(source)
        changes = stream_changes(sdf, STATUS, "Status")
        _run(changes, path, checkpoint)
    return spark.read.schema(changes.schema).parquet(path).select("user", "event", "event_type")
