import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.functions import kernels as N
from stintwise.operators import corners as K
from stintwise.operators import telemetry as T

LAP = "year int, round int, session_type string, driver int, constructor string, lap_id int"
KEYS = (2025, 1, "Q", 1, "Team", 7)


def lap(spark, **arrays):
    types = {"brake": "array<boolean>"}
    schema = LAP + "".join(f", {k} {types.get(k, 'array<double>')}" for k in arrays)
    values = [[v.item() if hasattr(v, "item") else v for v in a] for a in arrays.values()]
    return spark.createDataFrame([KEYS + tuple(values)], schema)


def low_pass(values, dt):
    alpha = dt / (1 / (2 * np.pi * 1.5) + dt)
    out = [float(values[0])]
    for v in values[1:]:
        out.append(alpha * v + (1 - alpha) * out[-1])
    for i in range(len(out) - 2, -1, -1):
        out[i] = alpha * out[i] + (1 - alpha) * out[i + 1]
    return np.array(out)


def accel(speed, time):
    dt = float(np.median(np.diff(time)))
    return low_pass(np.gradient(low_pass(speed, dt) / 3.6, time), dt)


def clip_reference(d, sp, th, br, t):
    """The clip rules applied sample by sample."""
    dt = float(np.median(np.diff(t)))
    smooth, acc = low_pass(sp, dt), accel(sp, t)
    flat = (th >= 98) & ~br
    runs, i = [], 0
    while i < len(d):
        j = i
        while j < len(d) and flat[j]:
            j += 1
        if j > i and (d[j - 1] - d[i] >= 250 or sp[i:j].max() >= 250):
            runs.append((i, j, bool(j < len(d) and br[j])))
        i = max(j, i + 1)
    top = max((sp[a:b].max() for a, b, _ in runs), default=0.0)
    out = []
    for a, b, braked in runs:
        s, v2 = smooth[a:b], (smooth[a:b] / 3.6) ** 2
        peak = int(np.argmax(s))
        rising = [k for k in range(1, b - a) if s[k] > s[k - 1] and s[k] >= 200]
        line = None
        if len(rising) >= 6:
            fit = np.polyfit(v2[rising], acc[a:b][rising], 1)
            line = fit if fit[0] < 0 else None
        state, value = [], []
        for k in range(b - a):
            if k <= peak or s[k] < 280 or s[k] > s[peak] - 3:
                state.append(0)
                value.append(0.0)
                continue
            r = acc[a + k]
            if line is not None:
                r = float(np.clip(r - (line[1] + line[0] * v2[k]), -15, 15))
                state.append(0 if r > -2 else 1 if r > -6.5 else 2)
            else:
                state.append(0 if r >= -2 else 1 if r >= -6 else 2)
            value.append(r)
        k, metres, worst = 0, {1: 0.0, 2: 0.0}, []
        while k < len(state):
            e = k
            while e < len(state) and state[e]:
                e += 1
            if e - k >= 3:
                worst += value[k:e]
                for q in range(k, e - 1):
                    metres[state[q]] += d[a + q + 1] - d[a + q]
            k = max(e, k + 1)
        clip = metres[1] + metres[2]
        is_clip = bool(s[peak] >= 0.85 * top and clip >= 40)
        severity = min(worst) if is_clip and worst else 0.0
        out.append((d[a], s[peak], metres[1], metres[2], is_clip, braked, severity, line is not None))
    return out


def trace(kind):
    n = 160
    d = np.arange(n) * 8.0
    t = np.arange(n) * 0.1
    sp = np.concatenate([np.linspace(150, 330, 90), np.linspace(330, 298, 40), np.linspace(298, 120, 30)])
    th, br = np.full(n, 100.0), np.zeros(n, bool)
    if kind == "fade":
        th[130:], br[130:] = 0.0, True
    if kind == "sharp":
        sp[92:130] = np.linspace(326, 282, 38)
        th[130:] = 40.0
    if kind == "two":
        th[60:66] = 20.0
        th[130:], br[132:] = 0.0, True
    if kind == "noise":
        sp = sp + np.random.default_rng(2).normal(0, 3, n)
        th[130:] = 0.0
    return d, sp, th, br, t


@pytest.mark.parametrize("kind", ["fade", "sharp", "two", "noise"])
def test_clip_detection_matches_rules(spark, kind):
    d, sp, th, br, t = trace(kind)
    rows = T.detect_clipping(
        lap(spark, distance_m=d, speed_kmh=sp, throttle=th, brake=br, time_s=t)
    ).orderBy("start_m")
    got = rows.collect()
    want = clip_reference(d, sp, th, br, t)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g.start_m == w[0]
        assert g.peak_kmh == pytest.approx(w[1])
        assert (g.depletion_m, g.superclip_m) == pytest.approx(w[2:4])
        assert (g.is_clip, g.end_reason == "brake", g.method == "ddr") == (w[4], w[5], w[7])
        assert g.clip_severity_ms2 == pytest.approx(w[6], abs=1e-7)
        assert g.clip_m == pytest.approx(g.depletion_m + g.superclip_m)
    if kind == "fade":
        assert any(g.is_clip for g in got)
    summary = T.clip_summary(rows).collect()[0]
    assert summary.n_straights == len(want)
    assert summary.n_clips == sum(w[4] for w in want)


def test_kernels_match_plain_loops(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.uniform(0.05, 0.2, 50))
    v = rng.normal(220, 20, 50)
    rows = lap(spark, v=v, t=t)
    got = rows.select(
        N.lowpass("v", "t").alias("a"),
        N.longitudinal_accel("v", "t").alias("b"),
        T.gradient(F.col("v"), F.col("t")).alias("c"),
    ).collect()[0]
    made = rows.select(F.lit(1).alias("lap_id"), F.col("t").alias("distance_m"), F.col("v").alias("speed_kmh"))
    clock = T.time_from_distance(made).orderBy("sample_idx").collect()
    dt = float(np.median(np.diff(t)))
    assert got.a == pytest.approx(low_pass(v, dt))
    assert got.b == pytest.approx(accel(v, t))
    assert got.c == pytest.approx(np.gradient(v, t))
    assert [r.sample_idx for r in clock] == list(range(1, 51))
    assert [r.time_s for r in clock] == pytest.approx(
        np.concatenate([[0], np.cumsum(np.diff(t) / np.maximum(v[:-1] / 3.6, 1))])
    )


def test_laps_of_different_length_share_a_batch(spark):
    rows = lap(spark, v=[1.0, 5.0, 2.0, 8.0], t=[0.0, 0.1, 0.2, 0.3]).union(
        lap(spark, v=[3.0, 4.0], t=[0.0, 0.2])
    ).union(lap(spark, v=[9.0], t=[0.0]))
    got = [r[0] for r in rows.coalesce(1).select(N.lowpass("v", "t")).collect()]
    assert got[0] == pytest.approx(low_pass([1, 5, 2, 8], 0.1))
    assert got[1] == pytest.approx(low_pass([3, 4], 0.2))
    assert got[2] == [9.0]


def test_lateral_acceleration_on_an_arc(spark):
    t = np.arange(400) * 0.1
    radius, speed = 80.0, 40.0
    angle = speed / radius * t
    rows = lap(spark, x=10 * radius * np.cos(angle), y=10 * radius * np.sin(angle), t=t)
    got = np.array(rows.select(N.lateral_accel("x", "y", "t")).collect()[0][0])
    assert np.median(got[50:-50]) == pytest.approx(speed**2 / radius, rel=0.05)
    short = lap(spark, x=[0.0, 1.0], y=[0.0, 1.0], t=[0.0, 0.1])
    assert short.select(N.lateral_accel("x", "y", "t")).collect()[0][0] == [0.0, 0.0]


def dtw(a, b):
    cost = {(-1, -1): 0.0}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best = min(cost.get(k, np.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
            cost[i, j] = abs(x - y) + best
    return cost[len(a) - 1, len(b) - 1]


def test_dtw_of_unequal_lengths(spark):
    rng = np.random.default_rng(8)
    pairs = [(rng.normal(0, 1, n).tolist(), rng.normal(0, 1, m).tolist()) for n, m in ((5, 9), (9, 4), (1, 1))]
    rows = spark.createDataFrame(pairs, "a array<double>, b array<double>").coalesce(1)
    got = [r[0] for r in rows.select(N.dtw_distance("a", "b")).collect()]
    assert got == pytest.approx([dtw(a, b) for a, b in pairs])


def test_fingerprint_drops_the_odd_lap(spark):
    d = np.arange(0, 400, 4.0)
    shape = 180 + 0.004 * (d - 200) ** 2

    def row(i, speed):
        return (2025, 1, "Q", 1, "Team", i, "SOFT", True, d.tolist(), speed.tolist(),
                np.where(d > 230, 90.0, 0.0).tolist(), ((d > 130) & (d < 190)).tolist(),
                np.full(len(d), 3.0).tolist())

    laps = spark.createDataFrame(
        [row(0, shape), row(1, shape + 1), row(2, shape - 1), row(3, shape + 60)],
        LAP + ", compound string, is_clean boolean, distance_m array<double>, speed_kmh array<double>,"
        " throttle array<double>, brake array<boolean>, gear array<double>",
    )
    got = K.fingerprints(laps, [(1, 200.0)]).collect()
    assert len(got) == 1
    assert got[0].clean_laps == 3
    assert got[0].min_speed_kmh == pytest.approx(180, abs=0.1)
    assert got[0].gear == 3
    assert got[0].brake_point_m < 10 and got[0].throttle_point_m > 100


def test_aligned_trace_ends_on_the_lap_gap(spark):
    def row(i, length, seconds):
        d = np.linspace(0, length, 60)
        t = 12.0 + np.linspace(0, seconds, 60)
        flat = [100.0] * 60
        return (2025, 1, "Q", i, "T", i, seconds, True, d.tolist(), flat, flat, t.tolist())

    laps = spark.createDataFrame(
        [row(1, 1000.0, 30.0), row(2, 1010.0, 30.2), row(3, 1500.0, 29.0)],
        LAP + ", lap_time_s double, is_representative boolean, distance_m array<double>,"
        " speed_kmh array<double>, throttle array<double>, time_s array<double>",
    )
    got = {r.driver: r for r in T.aligned_traces(laps).collect()}
    assert set(got) == {1, 2}  # the 1500 m lap is implausible, and so cannot be the pole lap
    assert got[1].is_pole and not got[2].is_pole
    assert got[2].delta_s[-1] == pytest.approx(0.2)
    assert set(got[1].delta_s) == {0.0}


def test_zone_wraps_the_line_and_takes_the_furthest_trap(spark):
    d = np.arange(0, 1001, 50.0)
    rows = K.zone_speeds(
        lap(spark, distance_m=d, speed_kmh=100 + d / 10), [(1, 300.0), (2, 700.0)]
    )
    got = {r.zone: (r.max_speed_kmh, r.trap_speed_kmh) for r in rows.collect()}
    assert got == {0: (200.0, 200.0), 1: (165.0, 165.0)}
