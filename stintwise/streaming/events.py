"""Event-log jobs: rate limits, confirmations, change logs and windows, in batch and as streams."""

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stintwise.functions.skew import before_block, blocks, null_safe_join
from stintwise.session import work_table

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def read_events(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now and write its rows as parquet."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class Limit(NamedTuple):
    """At most `most` rows that `counts` in the hour before, for each value of `key`."""

    key: str
    counts: Column
    most: int


def recent_counts(log: DataFrame, limit: Limit, attempts: Column, name: str) -> DataFrame:
    """(_id, `name`): for every attempt the rows its key has that count, later than an hour before it
    and before it.

    That is a difference of two ranks among the key's counting rows: those before the attempt's time,
    and those up to an hour before. All three kinds of times stand in one order, cut into ranges, and
    the counts of earlier ranges are carried into each. A key with a busy hour spans many ranges."""
    key, at = F.col(limit.key).alias("_key"), F.col("_us")
    counting = log.where(limit.counts).select(key, at, F.lit(1).alias("_one"), F.lit(0).alias("_sign"), F.lit(None).cast("bigint").alias("_id"))
    asking = log.where(attempts).select(key, "_us", "_id")
    now = asking.select("_key", "_us", F.lit(0).alias("_one"), F.lit(1).alias("_sign"), "_id")
    then = asking.select("_key", (at - HOUR_US).alias("_us"), F.lit(0).alias("_one"), F.lit(-1).alias("_sign"), "_id")
    rows = counting.unionByName(now).unionByName(then).where(F.col("_key").isNotNull())
    blocked = blocks(rows, ["_key"], [F.col("_us")])  # rows of one time of one key stay together
    carried = before_block(blocked, ["_key"], F.sum("_one"), "_carried")
    order = Window.partitionBy("_key", "_block").orderBy("_us")
    before = F.sum("_one").over(order.rangeBetween(Window.unboundedPreceding, -1))
    upto = F.sum("_one").over(order.rangeBetween(Window.unboundedPreceding, 0))
    rank = F.col("_carried") + F.coalesce(F.when(F.col("_sign") > 0, before).otherwise(upto), F.lit(0))
    return (
        blocked.join(carried, ["_key", "_block"])
        .withColumn("_rank", rank * F.col("_sign"))
        .where(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.sum("_rank").cast("bigint").alias(name))
    )


def rate_limit(log: DataFrame, attempts: Column, limits: dict[str, Limit]) -> DataFrame:
    """The rows of `log` (ts, any more) that are `attempts`, with the counts that `limits` name, of the
    trailing hour, and whether one of them blocks. A row without a key is not held by that limit."""
    rows = work_table(
        log.withColumn("_us", micros(F.col("ts"))).withColumn("_id", F.monotonically_increasing_id()),
        "attempts",
    )
    out = rows.where(attempts)
    for name, limit in limits.items():
        out = out.join(recent_counts(rows, limit, attempts, name), "_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0).cast("bigint"))
        )
    blocks_ = F.lit(False)
    for name, limit in limits.items():
        blocks_ = blocks_ | (F.col(name) >= limit.most)
    return out.withColumn("blocked", blocks_).drop("_us", "_id")


def confirmed_in_ttl(actions: DataFrame, ttl_us: int = DAY_US) -> DataFrame:
    """Each request with the confirmation that takes it within the time allowed, else expired.
    `actions` has (id, key, ts, action). A confirmation takes the newest request before it and only
    that: a request with a newer one before the next confirmation is expired.

    So the key's next action decides. Actions stand in ranges of (key, time), each range looks ahead in
    itself, and the first action of the next range that has the key is carried back to its last. A key
    with very many actions spans many ranges."""
    confirm = F.col("action") == "confirm"
    placed = actions.withColumn("_us", micros(F.col("ts"))).withColumn("_confirms", confirm)
    order = [F.col("_us"), F.col("_confirms"), F.col("id")]
    blocked = blocks(placed, ["key"], order)
    mark = F.struct("_us", F.col("_confirms").alias("confirms"), "id")
    next_block = Window.partitionBy("key").orderBy("_block")
    firsts = (
        blocked.groupBy("key", "_block")
        .agg(F.min(mark).alias("_first"))
        .select("key", "_block", F.lead("_first").over(next_block).alias("_later"))
    )
    inside = Window.partitionBy("key", "_block").orderBy(*order)
    valid = F.col("_next.confirms") & (F.col("_next._us") - F.col("_us") <= ttl_us)
    return (
        null_safe_join(blocked, firsts, ["key", "_block"])
        .withColumn("_next", F.coalesce(F.lead(mark).over(inside), "_later"))
        .where(F.col("action") == "request")
        .select(
            F.col("id").alias("request_id"),
            "key",
            F.when(valid, F.col("_next.id")).alias("confirm_id"),
            F.when(valid, "confirmed").otherwise("expired").alias("outcome"),
        )
    )


OUTCOMES = "request_id bigint, key bigint, confirm_id bigint, outcome string"
OPEN = "us array<bigint>, confirms array<boolean>, ids array<bigint>, open_id bigint, open_us bigint"


def settled(
    key: int, waiting: list[tuple[int, bool, int]], request: tuple[int, int] | None, upto: int, ttl_us: int
) -> tuple[list[tuple], list[tuple[int, bool, int]], tuple[int, int] | None]:
    """What a key's actions up to the time `upto` decide: (rows, actions still waiting, the open request
    as (id, time)). An open request ends with the key's next action, or once its time is over."""
    rows = []
    waiting = sorted(waiting)
    cut = bisect.bisect_right(waiting, (upto, True, 1 << 63))
    for us, confirms, number in waiting[:cut]:
        if request is not None:
            good = confirms and us - request[1] <= ttl_us
            rows.append((request[0], key, number if good else None, "confirmed" if good else "expired"))
            request = None
        if not confirms:
            request = (number, us)
    if request is not None and request[1] + ttl_us < upto:
        rows.append((request[0], key, None, "expired"))
        request = None
    return rows, waiting[cut:], request


def confirmations_stream(actions: DataFrame, lateness: str, ttl_us: int = DAY_US) -> DataFrame:
    """The outcome of every request of a stream of actions (id, key, ts, action), as `confirmed_in_ttl`,
    once no action can come that would change it.

    A key's state holds its actions that the watermark has not passed and its one open request; a timer
    of event time wakes the key when the watermark passes the next of them, or the request's last moment.
    A confirmation is used once, by the newest request before it; the others expire, and so does a
    request whose time runs out. Actions later than the watermark are dropped, as everywhere in a stream.
    Actions without a key take no part."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, request = [], None
        if state.exists:
            us, confirms, ids, open_id, open_us = state.get
            waiting = list(zip(us, confirms, ids, strict=True))
            request = None if open_id is None else (open_id, open_us)
        if not state.hasTimedOut:
            for frame in frames:
                waiting += zip(frame["us"].tolist(), frame["confirms"].tolist(), frame["id"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        rows, waiting, request = settled(keys[0], waiting, request, mark * 1000, ttl_us)
        if not waiting and request is None:
            if state.exists:
                state.remove()
        else:
            us, confirms, ids = (list(c) for c in zip(*waiting, strict=True)) if waiting else ([], [], [])
            state.update((us, confirms, ids, *(request or (None, None))))
            # a timer rings once the watermark is beyond it
            rings = [-(-us[0] // 1000) - 1] if waiting else []
            rings += [(request[1] + ttl_us) // 1000] if request else []
            state.setTimeoutTimestamp(max(min(rings), mark + 1))
        if rows:
            frame = pd.DataFrame(rows, columns=["request_id", "key", "confirm_id", "outcome"])
            yield frame.astype({"confirm_id": "Int64"})

    marked = actions.where(F.col("key").isNotNull()).withWatermark("ts", lateness)
    return (
        marked.select(
            "key", "id", "ts", micros(F.col("ts")).alias("us"), (F.col("action") == "confirm").alias("confirms")
        )
        .groupBy("key")
        .applyInPandasWithState(step, OUTCOMES, OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    )


def subscription_state(events: DataFrame, key: str = "key") -> DataFrame:
    """Latest status per key."""
    return events.groupBy(key).agg(
        F.max_by(F.struct("status", "ts"), F.struct("ts", "id")).alias("_last")
    ).select(key, "_last.*")


def change_log(before: DataFrame, after: DataFrame, key: str, secret: str) -> DataFrame:
    """Row-level changes between two snapshots, with old and new images without the secret field."""
    shown = [c for c in before.columns if c != secret]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            key,
            F.to_json(F.struct(*shown)).alias(f"{name}_data"),
            F.struct(*[c for c in df.columns if c != key]).alias(f"_{name}"),
        )

    action = (
        F.when(F.col("old_data").isNull(), "row_inserted")
        .when(F.col("new_data").isNull(), "row_deleted")
        .otherwise("row_updated")
    )
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    return (
        side(before, "old")
        .join(side(after, "new"), key, "full")
        .where(changed)
        .select(key, action.alias("action"), "old_data", "new_data")
    )


LOG_SCHEMA = "key bigint, id bigint, action string, old_data string, new_data string"


def without_secret(image: Column, schema: str, secret: str) -> Column:
    """A row image (JSON) without its secret field; null for a deleted row."""
    return F.when(image.isNotNull(), F.to_json(F.from_json(image, schema).dropFields(secret)))


def change_log_stream(images: DataFrame) -> DataFrame:
    """Append-only change events of a stream of writes (key, id, ts, image); a null image deletes the
    row. A key's state is the last image of its row, as it may be shown; a deleted row leaves no
    state. Deleting what is not there is no event. Only the states of a batch's keys are written.

    A batch's writes of one key are put in order by (ts, id) in one task, so how much a batch takes in
    bounds what a busy key can hold there; between batches the order is that of arrival."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        writes = pd.concat(list(frames)).sort_values(["ts", "id"], kind="stable")
        rows = []
        for number, image in zip(writes["id"].tolist(), writes["image"].tolist(), strict=True):
            image = image if isinstance(image, str) else None
            if image is not None or last is not None:
                action = "row_deleted" if image is None else "row_inserted" if last is None else "row_updated"
                rows.append((keys[0], number, action, last, image))
            last = image
        if last is not None:
            state.update((last,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "id", "action", "old_data", "new_data"])

    return images.groupBy("key").applyInPandasWithState(
        step, LOG_SCHEMA, "last string", "append", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, width: str, lateness: str) -> DataFrame:
    """Tumbling windows per event type; late events count until the watermark passes the window."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "event_type",
            "n",
            "total",
        )
    )
