"""Racing tables landed from the given tables.

The lap table is built once per session and written partitioned by year, round and session type,
so that every later query prunes partitions and reads only the columns it needs.
"""

import uuid
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintwise.constants import SESSION_KEYS, WEEKEND_KEYS
from stintwise.functions.skew import (
    attach,
    before_block,
    blocks,
    number_blocks,
    row_numbers,
)
from stintwise.session import shared_folder, work_table

RAW = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
        "value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

CORNERS = [(1, 400.0), (2, 1200.0), (3, 2000.0), (4, 2800.0), (5, 3600.0), (6, 4400.0)]

DRIVER_KEYS = [*SESSION_KEYS, "driver"]
LAP_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
TYPES = ["FP1", "Q", "SPRINT", "R"]
HELD = 5_000_000
"""Rows of a driver that one task may hold."""


def session_of() -> tuple[Column, Column, Column]:
    """Year, round and session type of a line."""
    month, quarter = F.month("l_shipdate"), F.quarter("l_shipdate")
    kind = F.when(
        quarter.isin(1, 3), F.when(F.col("l_linestatus") == "F", "FP1").otherwise("Q")
    ).otherwise(F.when(F.col("l_returnflag") == "R", "SPRINT").otherwise("R"))
    return F.year("l_shipdate"), F.when(month <= 6, 1).otherwise(2), kind


def driver_teams(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("driver"), F.col("n_name").alias("constructor")
    )


def session_entries(lineitem: DataFrame, teams: DataFrame) -> DataFrame:
    year, round_, kind = session_of()
    return lineitem.select(
        year.alias("year"),
        round_.alias("round"),
        kind.alias("session_type"),
        F.col("l_suppkey").alias("driver"),
        "l_returnflag",
        *LAP_ORDER,
    ).join(teams, "driver")


def packed(flags: list[Column]) -> Column:
    """Truth values as two bits each of one number; 2 is null."""
    bits = [F.shiftleft(F.coalesce(f.cast("int"), F.lit(2)), 2 * i) for i, f in enumerate(flags)]
    return reduce(lambda a, b: a + b, bits)


def unpacked(i: int) -> Column:
    bits = F.shiftright("_flags", 2 * i).bitwiseAND(3)
    return F.when(bits < 2, bits == 1)


def short_entries(lineitem: DataFrame) -> DataFrame:
    """What laps need of a line, in few bytes: `_session` counts years, rounds and types, `_flags` packs
    what is told by tax, discount and flag. Lines without a date are in no session."""
    year, round_, kind = session_of()
    tax, discount = F.round(F.col("l_tax") * 100), F.round(F.col("l_discount") * 100)
    flags = [
        discount < 10,
        (tax == 8) & (F.col("l_returnflag") == "R"),
        F.coalesce(tax == 7, F.lit(False)),
        discount == 9,
    ]
    type_ = F.array_position(F.array(*[F.lit(k) for k in TYPES]), kind) - 1
    return lineitem.where(F.col("l_shipdate").isNotNull()).select(
        ((year * 2 + round_ - 1) * len(TYPES) + type_).cast("int").alias("_session"),
        F.col("l_suppkey").alias("driver"),
        "l_quantity",
        packed(flags).alias("_flags"),
        *LAP_ORDER,
    )


def in_stints() -> tuple[Column, Column]:
    """Stint and tyre age of a lap."""
    before = F.col("lap_number") - 1
    return (F.floor(before / 8) + 1).cast("int"), (before % 8 + 1).cast("int")


def lap_time() -> Column:
    _, age = in_stints()
    return F.round(F.lit(80.0) + F.col("l_quantity") / 10.0 + F.lit(0.05) * age, 3)


CLOCKED = ["_session", "driver", "constructor", "lap_number", "lap_time_s", "_flags", "session_time_s"]


def clocked_laps(entries: DataFrame) -> DataFrame:
    """Laps with their numbers and clock, of drivers that one task may hold: `entries` lies by driver."""
    order = Window.partitionBy("_session", "driver").orderBy(*LAP_ORDER)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        entries.withColumn("lap_number", F.row_number().over(order).cast("bigint"))
        .withColumn("lap_time_s", lap_time())
        .withColumn("session_time_s", F.round(F.sum("lap_time_s").over(upto), 3))
        .select(*CLOCKED)
    )


def clocked_in_blocks(entries: DataFrame) -> DataFrame:
    """The same for drivers with any share of the rows, over range-partitioned blocks."""
    keys, order = ["_session", "driver"], [F.col(c) for c in LAP_ORDER]
    numbered = number_blocks(blocks(entries, keys, order), keys, order, "lap_number")
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy("lap_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    clocked = work_table(
        numbered.withColumn("lap_time_s", lap_time()).withColumn("_clock", F.sum("lap_time_s").over(inside)),
        "clock",
    )
    started = before_block(clocked, keys, F.max("_clock"), "_start")
    return (
        clocked.join(started, [*keys, "_block"])
        .withColumn("session_time_s", F.round(F.col("_start") + F.col("_clock"), 3))
        .select(*CLOCKED)
    )


def spelt_out(placed: DataFrame) -> DataFrame:
    """Laps with all their columns."""
    stint, age = in_stints()
    weekend = F.floor(F.col("_session") / len(TYPES))
    type_ = (F.col("_session") % len(TYPES)).cast("int")
    tyre = (F.col("driver") + F.col("stint_number")) % 3
    return (
        placed.withColumn("stint_number", stint)
        .withColumn("tyre_age", age)
        .select(
            F.floor(weekend / 2).cast("int").alias("year"),
            (weekend % 2 + 1).cast("int").alias("round"),
            F.array(*[F.lit(k) for k in TYPES])[type_].alias("session_type"),
            "driver",
            "constructor",
            "lap_number",
            "stint_number",
            "tyre_age",
            F.when(tyre == 0, "SOFT").when(tyre == 1, "MEDIUM").otherwise("HARD").alias("compound"),
            "lap_time_s",
            unpacked(0).alias("is_accurate"),
            unpacked(1).alias("deleted"),
            F.when(unpacked(2), "4").otherwise("1").alias("track_status"),
            ((F.col("tyre_age") == 1) & (F.col("stint_number") > 1)).alias("is_outlap"),
            (F.col("tyre_age") == 8).alias("is_inlap"),
            unpacked(3).alias("rainfall"),
            "session_time_s",
            "position",
        )
    )


def with_sectors(laps: DataFrame) -> DataFrame:
    t, n = F.col("lap_time_s"), F.col("lap_number")
    return (
        laps.withColumn("sector1_s", t * F.lit(0.30) + (n % 3) / 100)
        .withColumn("sector2_s", t * F.lit(0.36) + (n % 5) / 100)
        .withColumn("sector3_s", t - F.col("sector1_s") - F.col("sector2_s"))
    )


def land_laps(lineitem: DataFrame, teams: DataFrame, held: int = HELD) -> DataFrame:
    """Lap numbers, session clock and running order, from short rows that are dealt by driver once and
    ranged by session and lap once; all other columns follow from them. Drivers with more than `held`
    rows, if there are any, go over range-partitioned blocks, as laps do: one driver or one lap may
    hold any share of the rows."""
    entries = short_entries(lineitem)
    large = work_table(
        entries.groupBy("driver").agg(F.count("*").alias("_n")).where(F.col("_n") > held).select("driver"),
        "large",
    )
    if large.isEmpty():
        clocked = clocked_laps(entries.repartition("driver").join(teams, "driver"))
    else:
        few = entries.join(F.broadcast(large), "driver", "left_anti")
        many = entries.join(F.broadcast(large), "driver", "left_semi")
        clocked = clocked_laps(few.repartition("driver").join(teams, "driver")).unionByName(
            clocked_in_blocks(many.join(teams, "driver"))
        )
    order = [F.col("session_time_s"), F.col("driver")]
    return with_sectors(spelt_out(row_numbers(clocked, ["_session", "lap_number"], order, "position")))


def classification(laps: DataFrame) -> DataFrame:
    """One row per session and driver: laps done, clock, finishing order, best lap of stints 1-3."""
    done = laps.groupBy(*DRIVER_KEYS).agg(
        F.min("constructor").alias("constructor"),
        F.max("lap_number").alias("laps"),
        F.max("session_time_s").alias("clock_s"),
        *[
            F.min(F.when(F.col("stint_number") == k, F.col("lap_time_s"))).alias(f"q{k}_time_s")
            for k in (1, 2, 3)
        ],
    )
    placed = row_numbers(
        done,
        SESSION_KEYS,
        [-F.col("laps"), F.col("clock_s"), F.col("driver")],
        "position",
    )
    lead = F.col("position") == 1
    led = attach(
        placed,
        SESSION_KEYS,
        F.max(F.when(lead, F.col("laps"))).alias("_laps"),
        F.max(F.when(lead, F.col("clock_s"))).alias("_clock"),
        few=True,
    )
    status = (
        F.when(F.col("driver") % 17 == 0, "Retired")
        .when(F.col("laps") < F.col("_laps"), "Lapped")
        .otherwise("Finished")
    )
    return led.select(
        *DRIVER_KEYS,
        "constructor",
        F.col("position").cast("string").alias("position"),
        F.col("laps").cast("double").alias("laps"),
        status.alias("status"),
        F.when(lead, F.col("clock_s")).otherwise(F.col("clock_s") - F.col("_clock")).alias("time_s"),
        "q1_time_s",
        "q2_time_s",
        "q3_time_s",
    )


def calendar(laps_source: DataFrame) -> DataFrame:
    """One wide row per weekend: five session names and start times, some missing or unknown."""
    start = F.min("l_shipdate")
    names = {"FP1": "Practice 1", "Q": "Qualifying", "SPRINT": "Sprint", "R": "Race"}
    wide = laps_source.groupBy(*WEEKEND_KEYS).agg(
        start.alias("event_date"),
        *[
            F.min(F.when(F.col("session_type") == code, F.col("l_shipdate"))).alias(f"_{code}")
            for code in names
        ],
    )
    number = F.col("year") * 2 + F.col("round")
    hour = F.expr("INTERVAL '1' HOUR")
    return wide.select(
        *WEEKEND_KEYS,
        F.format_string("Grand Prix %d-%d", "year", "round").alias("event_name"),
        F.when(number % 3 == 0, "Italy").otherwise("Spain").alias("country"),
        F.when(number % 4 == 0, "Monza")
        .when(number % 4 == 1, "Barcelona")
        .when(number % 4 == 2, "Imola")
        .otherwise("Nowhere")
        .alias("location"),
        "event_date",
        F.lit("Practice 1").alias("session1"),
        F.when(number % 2 == 0, "Sprint Shootout").otherwise("Filming Day").alias("session2"),
        F.lit("Qualifying").alias("session3"),
        F.lit("Sprint").alias("session4"),
        F.when(number % 5 != 0, "Race").alias("session5"),
        F.col("_FP1").alias("session1_date_utc"),
        F.lit(None).cast("timestamp_ntz").alias("session2_date_utc"),
        F.col("_Q").alias("session3_date_utc"),
        F.lit(None).cast("timestamp_ntz").alias("session4_date_utc"),
        F.when(number % 3 != 0, F.col("_R")).alias("session5_date_utc"),
        (F.col("_FP1") + hour).alias("session1_date"),
        F.col("_SPRINT").alias("session2_date"),
        F.col("_Q").alias("session3_date"),
        (F.col("_SPRINT") + hour).alias("session4_date"),
        F.when(number % 2 == 0, F.col("_R")).alias("session5_date"),
    )


def telemetry_laps(embeddings: DataFrame, nation: DataFrame) -> DataFrame:
    """One row per lap holding its samples as arrays, so kernels run in place without a shuffle."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    n = F.col("lap_id")
    samples = embeddings.select(
        F.col("vec_id").alias("lap_id"),
        F.col("label").alias("driver"),
        F.floor(F.col("label") / 2).cast("int").alias("_team"),
        e.alias("e"),
    )
    at = lambda fn: F.transform("e", fn)
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e")
    return (
        samples.join(nation, F.col("_team") == nation.n_nationkey)
        .withColumn("_kind", (F.floor(n / 2) % 3).cast("int"))
        .withColumn(
            "_step",
            F.lit(80.0) + (n % 4) * F.lit(0.5) + F.when(n % 29 == 0, F.lit(4.0)).otherwise(0.0),
        )
        .select(
            F.lit(2000).alias("year"),
            (n % 2 + 1).cast("int").alias("round"),
            F.when(F.col("_kind") == 0, "FP1")
            .when(F.col("_kind") == 1, "Q")
            .otherwise("R")
            .alias("session_type"),
            "driver",
            F.col("n_name").alias("constructor"),
            "lap_id",
            F.when(F.floor(n / 6) % 10 < 7, "SOFT").otherwise("MEDIUM").alias("compound"),
            (F.lit(80.0) + mean * F.lit(10.0)).alias("lap_time_s"),
            (n % 11 != 0).alias("is_representative"),
            (n % 13 != 0).alias("is_clean"),
            at(lambda x, i: i * F.col("_step")).alias("distance_m"),
            at(lambda x: F.lit(230.0) + F.lit(300.0) * x).alias("speed_kmh"),
            at(lambda x: F.when(x > -0.1, F.lit(100.0)).otherwise(F.lit(50.0))).alias("throttle"),
            at(lambda x: x < -0.2).alias("brake"),
            at(lambda x, i: i.cast("double") / 10).alias("time_s"),
            at(lambda x: F.floor((F.lit(230.0) + F.lit(300.0) * x) / 50).cast("double")).alias(
                "gear"
            ),
            at(lambda x, i: (i * 64).cast("double")).alias("x"),
            at(lambda x: F.lit(5.0) * x).alias("y"),
        )
    )


class Tables:
    """The landed tables of one folder, each built at most once per Spark session."""

    _known: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self._stored: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir.rstrip("/"))
        return cls._known[key]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(
        self, name: str, make, partition_by: list[str] | None = None, ranged: bool = False
    ) -> DataFrame:
        """Write `make()` once to the shared folder and read it back from there. `ranged` states that its
        rows stand by `partition_by` as it is, so that they need not be dealt anew."""
        if name not in self._stored:
            df = make()
            path = f"{self.folder}/{name}"
            if partition_by:
                if not ranged:
                    df = df.hint("rebalance", *partition_by)
                df.write.partitionBy(*partition_by).parquet(path)
            else:
                df.write.parquet(path)
            self._stored[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._stored[name]

    @cached_property
    def teams(self) -> DataFrame:
        return driver_teams(self.raw("supplier"), self.raw("nation"))

    @cached_property
    def entries(self) -> DataFrame:
        return session_entries(self.raw("lineitem"), self.teams)

    @property
    def laps(self) -> DataFrame:
        return self.stored("laps", lambda: land_laps(self.raw("lineitem"), self.teams), SESSION_KEYS, ranged=True)

    @property
    def results_raw(self) -> DataFrame:
        return self.stored("results_raw", lambda: classification(self.laps))

    @property
    def calendar(self) -> DataFrame:
        return self.stored("calendar", lambda: calendar(self.entries))

    @cached_property
    def telemetry(self) -> DataFrame:
        return telemetry_laps(self.raw("embeddings"), self.raw("nation"))

    @cached_property
    def weather(self) -> DataFrame:
        """One row per session minute: rain if any lap ending in it was wet."""
        return (
            self.laps.groupBy(*SESSION_KEYS, F.floor(F.col("session_time_s") / 60).alias("minute"))
            .agg(F.bool_or("rainfall").alias("rainfall"))
            .select(*SESSION_KEYS, (F.col("minute") * 60.0).cast("double").alias("time_s"), "rainfall")
        )
