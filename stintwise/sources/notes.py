"""Race notes and their evidence, written from the classification and the pace table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.constants import WEEKEND_KEYS



def doc_id() -> Column:
    return F.format_string("%d-%d-%d", "year", "round", "driver")


def race_rows(results: DataFrame, team_pace: DataFrame) -> DataFrame:
    gaps = team_pace.where(F.col("session_type") == "R").select(
        *WEEKEND_KEYS, "constructor", F.round(F.col("gap_s") + F.lit(1e-9), 3).alias("gap_s")
    )
    return (
        results.where(F.col("session_type") == "R")
        .join(gaps, [*WEEKEND_KEYS, "constructor"])
        .select(
            *WEEKEND_KEYS,
            "driver",
            "constructor",
            "gap_s",
            "position",
            F.col("laps").cast("int").alias("laps"),
            doc_id().alias("doc_id"),
        )
    )


def notes(rows: DataFrame) -> DataFrame:
    c = F.col
    d = c("driver").cast("int")
    say = F.format_string
    text = (
        F.when(d % 20 == 1, say("%s was %.3f seconds off in qualifying through sector 2.", "constructor", "gap_s"))
        .when(d % 10 == 0, say("%s ran %.3f seconds off the pace in the race after just %d laps.", "constructor", "gap_s", "laps"))
        .when(d % 40 == 39, say("%s finished %.3f seconds behind the winner.", "constructor", "gap_s"))
        .when(d % 10 == 1, say("%s ran %.3f seconds off the pace in the race.", "constructor", "gap_s"))
        .when(d % 10 == 2, say("%s retired on lap %d when it pulled off.", "constructor", "laps"))
        .when(d % 10 == 3, say("A collision for %s on lap %d was noted.", "constructor", "laps"))
        .when(d % 10 == 4, say("%s was %d km/h slower and its retirement traces to an incident.", "constructor", d % 60 + 31))
        .when(d % 10 == 5, say("%s's %s started from the front row and led throughout.", "constructor", "constructor"))
        .when(d % 10 == 6, say("%s overtook rivals on lap %d in Q with the lowest clip of the field at %d m.", "constructor", "laps", d % 50 + 300))
        .when(d % 20 == 7, say("%s clip lengths were %d m and %d metres before the braking zone.", "constructor", d % 40 + 280, d % 40 + 100))
        .when(d % 10 == 7, say("%s clip lengths were %d m and %d metres before the braking zone.", "constructor", d % 7 + 300, d % 90 + 340))
        .when(d % 10 == 8, say("%s was the slowest in qualifying with a straight-line deficit.", "constructor"))
        .otherwise(say("%s had the highest top speed in qualifying and in the race.", "constructor"))
    )
    header = F.when(d % 4 == 0, say("%s by %.3f seconds", "constructor", "gap_s")).otherwise(c("constructor"))
    return rows.select(*WEEKEND_KEYS, "doc_id", "driver", header.alias("header"), text.alias("text"))


def evidence(rows: DataFrame) -> DataFrame:
    d = F.col("driver").cast("int")
    say = F.format_string
    shifted = F.col("gap_s") + F.when(d % 7 == 0, 0.5).otherwise(0.0)

    def record(tool: str, wanted: Column, item: Column) -> Column:
        return F.when(wanted, F.struct(F.lit(tool).alias("tool"), item.alias("item")))

    records = F.array_compact(
        F.array(
            record("get_constructor_ranking", d % 20 != 10, say('{"constructor":"%s","race_pace_gap_s":%.3f}', "constructor", shifted)),
            record("get_session_results", d % 20 == 10, say('{"position":%d,"gap_to_leader_s":%.3f}', "position", "gap_s")),
            record("get_race_control_events", d % 3 != 0, say('{"kind":"incident","lap":%d}', "laps")),
            record("get_race_control_events", d % 3 == 0, say('{"kind":"collision","lap":%d}', "laps")),
            record("get_deployment", d % 10 > 5, say('{"driver":"%d","total_clip_m":%d,"max_clip_m":%d}', d, d % 40 + 280, d % 40 + 100)),
            record("get_deployment", d % 10 > 5, say('{"driver":"X","total_clip_m":320,"max_clip_m":%d}', d % 7 + 110)),
            record(
                "get_candidate_insights",
                d % 20 == 1,
                say('{"category":"sector","source_refs":{"subject":"%s","refs":[{"type":"sector_delta","deficit_s":%.3f,"session_type":"practice"}]}}', "constructor", "gap_s"),
            ),
        )
    )
    return rows.select("doc_id", F.inline(records))


def incident_messages(events: DataFrame) -> DataFrame:
    code = F.format_string("D%02d", F.col("user_id") % 100)
    kind = F.col("event_type")
    say = F.format_string
    message = (
        F.when(kind == "error", say("TURN 4 INCIDENT INVOLVING CAR (%s) NOTED - CAUSING A COLLISION", code))
        .when(kind == "purchase", say("5 SECOND TIME PENALTY FOR CAR (%s)", code))
        .when(kind == "signup", F.lit("SAFETY CAR DEPLOYED"))
        .when(kind == "click", say("CAR (%s) TIME DELETED - TRACK LIMITS", code))
        .otherwise(say("CAR (%s) STOPPED ON TRACK", code))
    )
    return events.select(
        F.month("ts").alias("round"),
        F.when(F.col("event_id") % 9 == 0, "nan")
        .otherwise((F.col("user_id") % 60 + 1).cast("string"))
        .alias("lap_text"),
        message.alias("message"),
        F.col("event_id").alias("seq"),
    )
