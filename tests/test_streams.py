import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintwise.functions.skew import blocks
from stintwise.operators import season as N
from stintwise.sources.sink import drop_unused, last_manifest, names_in, read_sessions, replace_sessions
from stintwise.streaming import events as E
from stintwise.streaming import ingest as I

LAPS = "year int, round int, session_type string, driver int, lap_time_s double"


def laps(spark, session, drivers, t=90.0):
    return spark.createDataFrame([(2025, 1, session, d, t) for d in drivers], LAPS)


def test_session_waits_until_complete(spark, tmp_path):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "target", "state"))
    seen = []
    schema = laps(spark, "R", [1]).schema

    def run():
        I.ingest(spark, landing, target, state, schema, lambda t: seen.append(t.count()))
        return {
            (r.session_type, r["count"])
            for r in read_sessions(spark, target, schema)
            .groupBy("session_type")
            .count()
            .collect()
        }

    I.land(laps(spark, "R", range(6)), landing)
    I.land(laps(spark, "Q", range(3)), landing)
    assert run() == {("R", 6)}
    assert run() == {("R", 6)}  # nothing new: nothing is read again
    assert len(seen) == 1
    I.land(laps(spark, "Q", range(3, 8)), landing)
    assert run() == {("R", 6), ("Q", 8)}
    assert seen == [2, 1]


def rows_of(spark, path, schema, **how):
    return sorted((r.session_type, r.driver, r.lap_time_s) for r in read_sessions(spark, path, schema, **how).collect())


def test_readers_see_all_of_a_write_or_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = laps(spark, "R", [1]).schema
    assert rows_of(spark, path, schema) == [] and last_manifest(spark, path) == 0
    both = laps(spark, "R", [1]).union(laps(spark, "Q", [1]))
    assert replace_sessions(both, path) == 1
    old = [("Q", 1, 90.0), ("R", 1, 90.0)]
    bound = read_sessions(spark, path, schema)  # asked before the next write, read after it

    staged = []

    def accept(df):  # between the staged files and the manifest
        staged.append(rows_of(spark, path, schema))
        return df.select("year", "round", "session_type").distinct()

    new = laps(spark, "R", [1, 2], 80.0).union(laps(spark, "SPRINT", [3], 80.0))
    assert replace_sessions(new, path, accept=accept) == 2
    assert staged == [old]
    assert sorted((r.session_type, r.driver, r.lap_time_s) for r in bound.collect()) == old
    assert rows_of(spark, path, schema, number=1) == old
    now = [("Q", 1, 90.0), ("R", 1, 80.0), ("R", 2, 80.0), ("SPRINT", 3, 80.0)]
    assert rows_of(spark, path, schema) == now
    one = spark.createDataFrame([("SPRINT",)], "session_type string")
    assert rows_of(spark, path, schema, only=one) == now[-1:]
    assert rows_of(spark, path, schema, only=one.where("false")) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = laps(spark, "R", [1]).schema
    replace_sessions(laps(spark, "R", [1]), path)
    broken = laps(spark, "R", [1, 2]).withColumn(
        "lap_time_s", F.when(F.col("driver") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0)
    )
    with pytest.raises(Exception, match="lost"):
        replace_sessions(broken, path)
    assert rows_of(spark, path, schema) == [("R", 1, 90.0)] and last_manifest(spark, path) == 1
    replace_sessions(laps(spark, "R", [5]), path)
    replace_sessions(laps(spark, "R", [6]), path)
    drop_unused(spark, path, schema, keep=1)
    assert rows_of(spark, path, schema) == [("R", 6, 90.0)]
    assert len([n for n in names_in(spark, f"{path}/data") if n.startswith("_version")]) == 1


def test_a_write_goes_on_from_one_that_came_first(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = laps(spark, "R", [1]).schema

    def accept(df):
        if last_manifest(spark, path) == 0:
            replace_sessions(laps(spark, "Q", [7]), path)
        return df.select("year", "round", "session_type").distinct()

    assert replace_sessions(laps(spark, "R", [1]), path, accept=accept) == 2
    assert rows_of(spark, path, schema) == [("Q", 7, 90.0), ("R", 1, 90.0)]


def test_a_race_makes_its_season_anew_and_practice_does_not(spark, tmp_path):
    source, rounds, season = (str(tmp_path / n) for n in ("source", "rounds", "season"))
    schema = laps(spark, "R", [1]).schema
    weekend, year = ["year", "round"], ["year"]
    asked = []

    def sums(df):
        asked.append(("rounds", sorted({tuple(r) for r in df.select(*weekend).collect()})))
        return df.where("session_type = 'R'").groupBy(*weekend).agg(F.sum("lap_time_s").alias("total"))

    def whole(df):
        asked.append(("season", sorted({tuple(r) for r in df.select(*weekend).collect()})))
        return df.groupBy(*year).agg(F.sum("total").alias("total"))

    like = lambda ddl: spark.createDataFrame([], ddl).schema
    sum_rows, season_rows = like("total double, year int, round int"), like("total double, year int")
    keys = ["year", "round", "session_type"]
    outputs = [
        I.Output(rounds, sum_rows, weekend, None, source, schema, keys, sums),
        I.Output(season, season_rows, year, frozenset("R"), rounds, sum_rows, weekend, whole),
    ]
    hook = I.recompute(spark, outputs)

    def arrives(rows):
        replace_sessions(rows, source)
        hook(rows.select(*keys).distinct())
        return {r["year"]: r["total"] for r in read_sessions(spark, season, season_rows, year).collect()}

    def race(number, of=2025, t=90.0):
        return laps(spark, "R", [1, 2], t).withColumn("round", F.lit(number)).withColumn("year", F.lit(of))

    assert arrives(race(1).union(race(2)).union(race(1, 2024))) == {2025: 360.0, 2024: 180.0}
    asked.clear()
    assert arrives(laps(spark, "FP1", [1])) == {2025: 360.0, 2024: 180.0}
    assert asked == [("rounds", [(2025, 1)])]
    asked.clear()
    assert arrives(race(2, t=80.0)) == {2025: 340.0, 2024: 180.0}  # a round replaced
    assert asked == [("rounds", [(2025, 2)]), ("season", [(2025, 1), (2025, 2)])]


def test_season_of_rounds_equals_the_whole(spark):
    values = [(2025, r, c, float(r * r % 7 + len(c) * 0.1)) for r in range(1, 9) for c in ("A", "BB") if r != 3 or c == "A"]
    df = spark.createDataFrame(values, "year int, round int, constructor string, value double")
    got = {r.constructor: r for r in N.season_of_rounds(N.round_sums(df)).collect()}
    plain = {r.constructor: r for r in N.metric_mean_spread(df).collect()}
    last = spark.createDataFrame([(2025, 8)], "year int, current_round int")
    recent = {r.constructor: r for r in N.metric_mean_spread(df, last).collect()}
    for c in ("A", "BB"):
        assert got[c].n == plain[c].n
        assert got[c]["mean"] == pytest.approx(plain[c]["mean"]) and got[c].spread == pytest.approx(plain[c].spread)
        assert got[c].recent_mean == pytest.approx(recent[c]["mean"])


def at(minutes):
    return dt.datetime(2025, 1, 1) + dt.timedelta(minutes=minutes)


def test_two_limits_in_the_hour_before(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i, str(rng.choice(["ip1", "ip2", None], p=[0.7, 0.2, 0.1])), int(rng.integers(0, 4)), at(int(m)), str(k))
        for i, (m, k) in enumerate(zip(rng.integers(0, 600, 250), rng.choice(["try", "held", "sent"], 250), strict=True))
    ]
    rows = [(i, None if a == "None" else a, *rest) for i, a, *rest in rows]
    log = spark.createDataFrame(rows, "id int, address string, mail int, ts timestamp, kind string").repartition(5)
    kind = F.col("kind")
    limits = {"by_address": E.Limit("address", kind.isin("try", "held"), 5), "to_mail": E.Limit("mail", kind == "sent", 3)}
    got = {r.id: (r.by_address, r.to_mail, r.blocked) for r in E.rate_limit(log, kind == "try", limits).collect()}
    hour = dt.timedelta(hours=1)
    want = {}
    for i, a, m, t, k in rows:
        if k == "try":
            near = [r for r in rows if t - hour < r[3] < t]
            x = sum(r[1] == a and r[4] != "sent" for r in near) if a else 0
            y = sum(r[2] == m and r[4] == "sent" for r in near)
            want[i] = (x, y, x >= 5 or y >= 3)
    assert got == want and {w[2] for w in want.values()} == {True, False}


def test_a_busy_hour_of_one_key_spans_many_tasks(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        "id", F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 50_000).alias("ts")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = rows.withColumn("_us", E.micros(F.col("ts"))).withColumn("_id", F.col("id"))
        placed = blocks(log, ["key"], [F.col("_us")])
        assert placed.select("_block").distinct().count() >= 8
        got = E.rate_limit(rows, F.lit(True), {"n": E.Limit("key", F.lit(True), 5)})
        assert got.where("n != least(id, 71999)").count() == 0  # 72,000 steps of 50 ms an hour
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_confirmation_by_brute_force(spark):
    rng = pd.Series(range(200))
    frame = pd.DataFrame(
        {
            "id": rng,
            "key": rng * 7 % 5,
            "ts": [at(int(i * i * 3 % 20000)) for i in rng],
            "action": ["request" if i % 3 else "confirm" for i in rng],
        }
    )
    got = {
        r.request_id: r.confirm_id
        for r in E.confirmed_in_ttl(spark.createDataFrame(frame)).collect()
    }
    frame["late"] = (frame.action == "confirm").astype(int)
    order = frame.sort_values(["ts", "late", "id"])
    for row in frame[frame.action == "request"].itertuples():
        mine = order[order.key == row.key].reset_index(drop=True)
        after = mine[mine.index > mine.index[mine.id == row.id][0]].head(1)
        # The key's next action takes the request if it is a confirmation in time.
        good = len(after) and after.action.iloc[0] == "confirm"
        in_time = good and after.ts.iloc[0] <= row.ts + dt.timedelta(hours=24)
        want = after.id.iloc[0] if in_time else None
        assert got[row.id] == want


def test_change_log_hides_the_secret(spark):
    schema = "id int, email string, secret string"
    before = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2"), (3, "c", "s3")], schema)
    after = spark.createDataFrame([(1, "a", "new"), (2, "b", "s2"), (4, "d", "s4")], schema)
    got = {r.id: (r.action, r.old_data, r.new_data) for r in E.change_log(before, after, "id", "secret").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "row_updated", 3: "row_deleted", 4: "row_inserted"}
    assert not any("s" + str(i) in str(v) for v in got.values() for i in range(1, 5))
    assert got[4][2] == '{"id":4,"email":"d"}'


def arriving(spark, folder, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_change_stream_carries_the_last_image_over_batches(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "key bigint, id bigint, ts timestamp, image string"

    def run(*rows):
        stream = arriving(spark, folder, schema, [(k, i, at(i), v) for k, i, v in rows])
        E.run_once(E.change_log_stream(stream), out, state)

    run((1, 2, "b"), (1, 1, "a"), (2, 1, "x"), (4, 1, None))
    run((1, 3, "c"), (3, 1, "n"), (1, 4, "d"), (2, 2, None))
    run((2, 3, None), (2, 4, "y"), (3, 2, None), (3, 3, "m"), (None, 9, "z"))
    rows = spark.read.schema(E.LOG_SCHEMA).parquet(out).collect()
    got = {(r.key, r.id): (r.action, r.old_data, r.new_data) for r in rows}
    assert len(rows) == len(got)
    assert got == {
        (1, 1): ("row_inserted", None, "a"),
        (1, 2): ("row_updated", "a", "b"),
        (2, 1): ("row_inserted", None, "x"),
        (1, 3): ("row_updated", "b", "c"),
        (1, 4): ("row_updated", "c", "d"),
        (3, 1): ("row_inserted", None, "n"),
        (2, 2): ("row_deleted", "x", None),
        (2, 4): ("row_inserted", None, "y"),
        (3, 2): ("row_deleted", "n", None),
        (3, 3): ("row_inserted", None, "m"),
        (None, 9): ("row_inserted", None, "z"),
    }


def test_images_lose_their_secret(spark):
    rows = [('{"id":1,"mail":"a","hash":"s1"}',), ('{"id":2,"hash":"s2"}',), (None,)]
    df = spark.createDataFrame(rows, "image string")
    got = df.select(E.without_secret(F.col("image"), "id int, mail string, hash string", "hash")).collect()
    assert [r[0] for r in got] == ['{"id":1,"mail":"a"}', '{"id":2}', None]


def test_confirmations_of_a_stream_equal_the_batch(spark, tmp_path):
    """Actions arrive in four parts, out of order by less than the watermark; a last one closes all."""
    rng = np.random.default_rng(9)
    minutes = np.sort(rng.integers(0, 9000, 160))
    rows = [(i, int(rng.integers(0, 6)), at(int(m)), ["request", "confirm"][int(rng.integers(0, 2))]) for i, m in enumerate(minutes)]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, key long, ts timestamp, action string"
    closing = [(999, 77, at(90_000), "confirm")]
    parts = [rows[:40:2], rows[1:40:2] + rows[40:80], rows[80:120], rows[120:][::-1], closing, [(1000, 77, at(90_001), "confirm")]]
    for part in parts:
        E.run_once(E.confirmations_stream(arriving(spark, folder, schema, part), "5 days"), out, state)
    got = spark.read.schema(E.OUTCOMES).parquet(out).collect()
    want = E.confirmed_in_ttl(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.outcome for r in got} == {"confirmed", "expired"}
    used = [r.confirm_id for r in got if r.confirm_id is not None]
    assert len(used) == len(set(used))


def test_a_confirmation_is_used_once_and_by_the_newest_request(spark):
    rows = [(1, "k", at(0), "request"), (2, "k", at(5), "request"), (3, "k", at(9), "confirm"),
            (4, "k", at(12), "confirm"), (5, "k", at(15), "request")]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp, action string")
    got = {r.request_id: (r.confirm_id, r.outcome) for r in E.confirmed_in_ttl(df).collect()}
    assert got == {1: (None, "expired"), 2: (3, "confirmed"), 5: (None, "expired")}


def test_change_log_sees_values_moved_across_null(spark):
    schema = "key int, a string, b string, secret string"
    before = spark.createDataFrame([(1, "x", None, "s"), (2, "x", None, "s"), (3, "u", "v", "s")], schema)
    after = spark.createDataFrame([(1, None, "x", "s"), (2, "x", None, "t"), (3, "u", "v", "s")], schema)
    got = {r.key: r.action for r in E.change_log(before, after, "key", "secret").collect()}
    assert got == {1: "row_updated", 2: "row_updated"}


def test_ingest_reads_only_the_touched_folders(spark, tmp_path, monkeypatch):
    landing, target, state = (str(tmp_path / n) for n in ("landing", "target", "state"))
    schema = laps(spark, "R", [1]).schema
    I.land(laps(spark, "R", range(6)), landing)
    I.ingest(spark, landing, target, state, schema)
    read = []
    publish = I.replace_sessions

    def watched(df, *args, **more):
        read.append({f.split("session_type=")[1].split("/")[0] for f in df.inputFiles()})
        return publish(df, *args, **more)

    monkeypatch.setattr(I, "replace_sessions", watched)
    I.land(laps(spark, "Q", range(6)), landing)
    I.ingest(spark, landing, target, state, schema)
    assert read == [{"Q"}]
    assert read_sessions(spark, target, schema).count() == 12
