"""Stored intermediate tables, each written once per session from the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.constants import SESSION_KEYS
from stintwise.operators import catalog as C
from stintwise.operators import corners as K
from stintwise.operators import laps as L
from stintwise.operators import pace as P
from stintwise.operators import season as N
from stintwise.operators import signals as G
from stintwise.operators import telemetry as T
from stintwise.operators import text as X
from stintwise.sources import notes as W
from stintwise.sources.landing import CORNERS, Tables

PACE = [
    *L.DRIVER_KEYS,
    "constructor",
    "lap_number",
    "stint_number",
    "tyre_age",
    "compound",
    "lap_time_s",
    "gap_s",
    "total_laps",
    "pace_s",
]


class Marts(Tables):
    @property
    def pace_table(self) -> DataFrame:
        """Laps that count for pace, with what their pace is read by; `opening` marks the ones left out
        of distributions."""

        def make() -> DataFrame:
            kept = L.pace_laps(L.gap_to_car_ahead(self.laps)).select(*PACE)
            return L.mark_opening_lap(kept, self.laps)

        return self.stored("pace", make)

    @property
    def kept(self) -> DataFrame:
        return self.pace_table.drop("opening")

    @property
    def paced(self) -> DataFrame:
        return self.pace_table.where(~F.col("opening")).drop("opening")

    @property
    def results(self) -> DataFrame:
        return self.stored("results", lambda: C.session_results(self.results_raw))

    @property
    def sessions(self) -> DataFrame:
        return self.stored("sessions", lambda: self.laps.select(*SESSION_KEYS).distinct())

    @property
    def team_pace(self) -> DataFrame:
        return self.stored("team_pace", lambda: P.constructor_median_gaps(self.paced))

    @property
    def race_pace(self) -> DataFrame:
        """Team pace of each weekend's race, or of its sprint where there was no race."""
        race = C.pick_session(self.sessions, ["R", "SPRINT"])
        return self.team_pace.join(race, SESSION_KEYS)

    @property
    def items(self) -> DataFrame:
        return C.published_items(self.race_pace)

    @property
    def prints(self) -> DataFrame:
        return self.stored("prints", lambda: K.corner_prints(self.telemetry, CORNERS))

    @property
    def pairs(self) -> DataFrame:
        return self.stored("pairs", lambda: K.attribution(self.prints))

    @property
    def zones(self) -> DataFrame:
        return self.stored(
            "zones", lambda: K.zone_speeds(K.fastest(self.telemetry, "is_clean"), CORNERS)
        )

    @property
    def sector_bests(self) -> DataFrame:
        return self.stored("sector_bests", lambda: L.sector_bests(self.laps))

    @property
    def quali_rows(self) -> DataFrame:
        return self.stored("quali_rows", lambda: K.lap_character(self.telemetry))

    @property
    def quali_corners(self) -> DataFrame:
        return self.stored("quali_corners", lambda: K.lap_corner_speeds(self.telemetry, CORNERS))

    @property
    def clip_straights(self) -> DataFrame:
        return self.stored(
            "clip_straights",
            lambda: T.detect_clipping(K.fastest(self.telemetry, "is_representative")),
        )

    @property
    def accel(self) -> DataFrame:
        return self.stored("accel", lambda: T.accel_samples(self.telemetry))

    @property
    def clips(self) -> DataFrame:
        return T.clip_summary(self.clip_straights)

    @property
    def clean_air(self) -> DataFrame:
        return self.stored("clean_air", lambda: P.clean_air_pace(self.paced))

    @property
    def wear(self) -> DataFrame:
        return self.stored("wear", lambda: P.degradation_fits(self.paced))

    @property
    def race_wear(self) -> DataFrame:
        return self.wear.join(C.pick_session(self.sessions, ["R", "SPRINT"]), SESSION_KEYS)

    @property
    def stints(self) -> DataFrame:
        return self.stored("stints", lambda: L.stint_summary(L.gap_to_car_ahead(self.laps, prunable=True)))

    @property
    def snapshot(self) -> DataFrame:
        return self.stored("snapshot", lambda: self.season_snapshot())

    def season_snapshot(self, max_round: int | None = None) -> DataFrame:
        return N.season_snapshot(
            self.sessions,
            self.race_pace,
            self.quali_rows,
            self.sector_bests,
            self.race_wear,
            max_round,
        )

    @property
    def trends(self) -> DataFrame:
        def make() -> DataFrame:
            gaps, _ = N.quali_metrics(self.quali_rows, self.sessions)
            return N.season_trends(self.race_pace, gaps)

        return self.stored("trends", make)

    @property
    def signals(self) -> DataFrame:
        return self.stored("signals", lambda: G.all_signals(self))

    @property
    def candidates(self) -> DataFrame:
        return self.stored(
            "candidates", lambda: G.candidates(self.signals, self.snapshot, self.results)
        )

    @property
    def note_rows(self) -> DataFrame:
        return W.race_rows(self.results, self.team_pace)

    @property
    def notes(self) -> DataFrame:
        return self.stored("notes", lambda: W.notes(self.note_rows))

    @property
    def evidence(self) -> DataFrame:
        return self.stored("evidence", lambda: W.evidence(self.note_rows))

    @property
    def texts(self) -> DataFrame:
        """Race notes and the given documents, whole."""
        documents = self.raw("documents").select(F.col("doc_id").cast("string"), "text")
        return self.notes.select("doc_id", "text").unionByName(documents)

    @property
    def suspects(self) -> DataFrame:
        return self.stored("suspects", lambda: X.suspects(self.texts))
