import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stintwise.functions import expressions as X
from stintwise.functions import text_rules as R
from stintwise.operators import evidence as V
from stintwise.operators import text as T
from stintwise.plans import ORACLES, QUERIES
from stintwise.plans.marts import Marts


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text"))).collect()[0][0]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (T.round_prose_numbers, "at 81.98835714285714 and 0.1234567, not 1.25", "at 82 and 0.123, not 1.25"),
        (T.round_prose_numbers, "nothing", "nothing"),
        (T.format_lap_times, "104.361 seconds, 59.9 s and 81.2s", "1:44.361, 59.9 s and 1:21.2"),
        (T.strip_em_dashes, "a — b—c – d–e", "a, b, c - d-e"),
        (T.first_sentence, " One v1.2 done. Two? ", "One v1.2 done."),
        (T.bind_units, "0.058 s and 3 laps", "0.058\u00a0s and 3 laps"),
        (T.measurement_tokens, "Haas F1 ran 3.994 seconds, 11th, lap 7, served", ["3.994 seconds", "11th", "7,"]),
        (V.quantity_values, "150-250 km/h band, -3.5 seconds (42 mph)", [250.0, -3.5, 42.0]),
        (V.leaf_numbers, '{"a": 1.5, "b": "x 7", "c": [2, -3e1]}', [1.5, 2.0, -30.0]),
        (V.metres, "13.02 m/s², 350 m and 40 metres", [350.0, 40.0]),
        (X.normalize_email, "  Bob@X.com ", "bob@x.com"),
        (X.normalize_email, "bob@x", None),
        (X.compound_letter, "ultrasoft", "U"),
        (T.message_kind, "CAR 4 (NOR) COLLISION - DELETED", None),
        (T.message_kind, "INCIDENT INVOLVING CAR 4 (NOR) NOTED", "incident"),
        (T.message_kind, "CAR 4 STOPPED ON TRACK", "retirement"),
    ],
)
def test_functions(spark, fn, text, want):
    assert one(spark, text, fn) == want


def texts(spark, *rows):
    return spark.createDataFrame(
        [(str(i), "", r) for i, r in enumerate(rows)], "doc_id string, header string, text string"
    )


def evidence(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, tool string, item string")


def docs(df):
    return sorted(r.doc_id for r in df.collect())


def test_patterns(spark):
    rows = texts(
        spark,
        "Out after just five laps.",
        "67.5 km/h (42 mph) slower",
        "12 km/h slower, 331 km/h on the straights",
        "Alpine's Alpine held on",
        "Its retirement followed; it retired due to an incident at turn 4",
    )
    got = {(r.doc_id, r.rule) for r in T.pattern_flags(rows).collect()}
    assert got == {
        ("0", "after_laps"),
        ("1", "speed_gap"),
        ("3", "doubled_possessive"),
        ("4", "retired_by_incident"),
    }


def test_lap_context(spark):
    rows = texts(
        spark,
        "It retired on lap 37.",
        "A collision on lap 12 ended it; it retired later.",
        "He overtook two cars on lap 5.",
        "Pitted on lap 9.",
        "It retired on lap 3. " + "x" * 80 + " A penalty came on lap 40.",
    )
    got = [(r.doc_id, r.detail) for r in T.lap_context_flags(rows).collect()]
    assert sorted(got) == [("0", "on lap 37"), ("2", "on lap 5"), ("4", "on lap 3")]


def test_incident_rows(spark):
    rows = spark.createDataFrame(
        [
            (1, "12", "COLLISION BETWEEN CAR 4 (NOR) AND CAR 1 (VER)", 1),
            (1, "13", "COLLISION BETWEEN CAR 4 (NOR) AND CAR 1 (VER)", 2),
            (1, "nan", "SAFETY CAR DEPLOYED", 3),
            (1, "4", "CAR 4 (NOR) TIME DELETED", 4),
        ],
        "round int, lap_text string, message string, seq int",
    )
    got = {(r.lap, r.driver, r.kind) for r in T.incident_events(rows, ["round"]).collect()}
    assert got == {(12, "NOR", "collision"), (12, "VER", "collision"), (None, None, "safety_car")}


def test_untraceable(spark):
    rows = texts(spark, "0.412 seconds and 9.9 seconds off", "7.7 seconds", "5.0001 seconds")
    found = evidence(
        spark,
        ("0", "a", '{"gap": 0.4121}'),
        ("0", "b", '{"x": 3}'),
        ("2", "a", '{"gap": 5.0002}'),
    )
    got = [(r.doc_id, r.value) for r in V.untraceable_numbers(rows, found).collect()]
    assert got == [("0", 9.9)]  # text 1 has no evidence at all and is skipped


def test_single_source(spark):
    rows = texts(spark, "1.5 seconds", "1.5 seconds and 8 seconds", "1.5 seconds")
    found = evidence(
        spark,
        *[(d, "get_session_results", '{"gap": 1.5}') for d in "012"],
        ("2", "get_stint_summary", '{"avg": 1.5}'),
    )
    assert docs(V.single_source(rows, found, V.from_results(), "results_only")) == ["0"]
    wrapped = '{"category":"deployment","magnitude":1.5,"source_refs":%s}'
    for refs in ('{"session_type":"Q"}', '[{"session_type":"SQ"}]', '{"subject":"x","refs":[{"session_type":"Q"}]}'):
        cands = evidence(spark, ("0", "get_candidate_insights", wrapped % refs))
        assert docs(V.single_source(rows, cands, V.from_qualifying(), "qualifying_only")) == ["0"]


def test_causation(spark):
    rows = texts(*[spark] + ["It retired after an incident."] * 3)
    found = evidence(
        spark,
        ("0", "get_race_control_events", '{"kind":"incident"}'),
        ("1", "get_race_control_events", '{"kind":"incident"}'),
        ("1", "get_race_control_events", '{"kind":"collision"}'),
    )
    assert docs(V.false_causation(rows, found)) == ["0"]


def test_superlatives_and_clusters(spark):
    rows = texts(spark, "The shortest clip at 180 m", "The lowest clip of the field at 320 m",
                 "clip of 310 m and 350 metres", "clip of 100 m and 350 metres")
    found = evidence(
        spark,
        *[(d, "get_deployment", '{"total_clip_m":300,"max_clip_m":%d}' % m) for d in "01" for m in (150, 190)],
    )
    got = {r.doc_id: r.detail for r in V.false_superlative(rows, found).collect()}
    assert got["0"].startswith("shortest-clip claim (180.0m)")
    assert got["1"].startswith("lowest-clip/deployment claim (320.0m)")
    assert docs(V.weak_cluster(rows)) == ["2"]


def test_session_codes_keep_the_word_sprint(spark):
    rows = texts(spark, "fast in Q", "the sprint was fine", "SPRINT pace", "won in R today", "IQ test")
    assert docs(V.session_codes(rows)) == ["0", "2", "3"]


def test_conflicts(spark):
    rows = spark.createDataFrame(
        [
            (1, "a", "Alpine was slowest in qualifying"),
            (1, "b", "Alpine was fastest in qualifying"),
            (2, "c", "Haas was slowest in qualifying"),
            (2, "d", "Haas was fastest, a race strength"),
            (3, "e", "Ferrari was slowest"),
        ],
        "g int, doc_id string, text string",
    )
    assert docs(V.cross_doc_conflict(rows, ["g"])) == ["a", "b"]


def test_hints_once_per_text(spark):
    flags = spark.createDataFrame(
        [("0", "r", "Front Row"), ("0", "r", "front row"), ("0", "r", "unknown"),
         ("1", "r", "results-only finding: every cited number")],
        "doc_id string, rule string, detail string",
    )
    got = [r.doc_id for r in T.fix_hints(flags).collect()]
    assert sorted(got) == ["0", "1"]


def test_the_phrase_query_looks_for_all_watched_phrases(spark):
    rows = [("a", "The License of the car"), ("b", "whst the first win"), ("c", "nothing")]
    tables = SimpleNamespace(texts=spark.createDataFrame(rows, "doc_id string, text string"))
    got = {(r["doc_id"], r["detail"]) for r in QUERIES["phrase_flags"](tables).collect()}
    assert got == {("a", "license"), ("b", "whst the"), ("b", "first win")}
    assert "'license'" in ORACLES["phrase_flags"] and "'whst the'" in ORACLES["phrase_flags"]


HELD = [
    "after just 12 laps", "after twelve laps", "completed 3 laps", "retired after 9", "pole to flag in the sprint",
    "led from pole in the sprint", "231.5 km/h (x) slower", "DRS", "car's car", "it's it", "K's \u212a", "\u0130's i",
    "Retired, due to an incident", "after an incident it retired", "retirement after incident", "traces to", "DNF",
    "On Lap 7", "passed", "noted", "was 0.310\t seconds \x0boff in qualifying through sector 2", "3.5 seconds behind",
    "lowest clip of the field at 310 m", "clip of 307 m and 355 Metres", "shortest clip at 99.5\tm", "shortest clip", "fewest ERS", "310 m", "300 metres", "99m", "in the grid", "clip",
    "braking zone", "deployment", "in Q", "SQ", "in\u000bR", "\u212aq", "q\u0301", "\u00e9q", "SPRINT", "sprint", "7%",
    "5 kph", "(42 mph)", "8 s", "8s", "8\x0bs", "9 Sec", "13.02 m/s\u00b2", "hit the wa\u212all", "chec\u212aED", "a", ".", "\n",
    *R.PHRASES[::9],
]


def random_texts(count):
    rng = random.Random(11)
    held = [*HELD, *(h.upper() for h in HELD), *(h.title() for h in HELD)]
    between = [" ", " ", " ", ", ", "", "\n", "\u00a0", "x", "\u0130"]
    made = ["".join(p for h in rng.choices(held, k=rng.randint(1, 5)) for p in (h, rng.choice(between))) for _ in range(count)]
    return [(f"{i}", t) for i, t in enumerate([*held, *made, None, "", "nothing to see here"])]


CHECKS = {
    "phrase": T.phrase_flags,
    "pattern": T.pattern_flags,
    "lap_context": T.lap_context_flags,
    "weak_cluster": V.weak_cluster,
    "session_code": V.session_codes,
    "quantity": V.cited,
    "false_causation": lambda t: V.false_causation(t, evidence_of(t)),
    "sector_context": lambda t: V.sector_context_mismatch(t, evidence_of(t)),
    "false_superlative": lambda t: V.false_superlative(t, evidence_of(t)),
}


def evidence_of(texts):
    items = [
        ("get_race_control_events", '{"kind":"incident","lap":1}'),
        ("get_deployment", '{"total_clip_m":60,"max_clip_m":55}'),
        ("get_deployment", '{"total_clip_m":70,"max_clip_m":65}'),
        ("get_candidate_insights", '{"source_refs":{"refs":[{"type":"sector_delta","deficit_s":0.31}]}}'),
    ]
    tools = texts.sparkSession.createDataFrame(items, "tool string, item string")
    return texts.select("doc_id").distinct().crossJoin(tools)


@pytest.fixture(scope="module")
def told(spark):
    rows = spark.createDataFrame(random_texts(1500), "doc_id string, text string").repartition(4).cache()
    return rows, T.suspects(rows).cache()


@pytest.mark.parametrize("check", R.NEEDED)
def test_suspects_hold_every_text_that_a_check_tells_of(told, check):
    rows, suspects = told
    want = sorted(map(str, CHECKS[check](rows).collect()))
    assert want and sorted(map(str, CHECKS[check](T.suspected(suspects, check)).collect())) == want


def test_texts_that_no_check_tells_of_are_no_suspects(spark):
    rows = spark.createDataFrame([("a", "nothing 5 miles off"), ("b", None), ("c", "8 s")], "doc_id string, text string")
    assert [(r["doc_id"], r["may"]) for r in T.suspects(rows).collect()] == [("c", 1 << list(R.NEEDED).index("quantity"))]


def test_the_gates_scan_the_documents_once(spark):
    flags = QUERIES["doc_flags"](Marts.of(spark, "/root/testdata/sf0.001"))
    assert not [f for f in flags.inputFiles() if "documents" in f]
