"""Fixed values of the domain: thresholds, lookup tables and name lists."""

SESSION_KEYS = ["year", "round", "session_type"]
WEEKEND_KEYS = ["year", "round"]

# --- fixed values: session names, codes, durations -------------------------
SESSION_CODES = {
    "Practice 1": "FP1",
    "Practice 2": "FP2",
    "Practice 3": "FP3",
    "Qualifying": "Q",
    "Sprint Qualifying": "SQ",
    "Sprint Shootout": "SQ",
    "Sprint": "SPRINT",
    "Race": "R",
}
SESSION_MINUTES = {"FP1": 60, "FP2": 60, "FP3": 60, "Q": 60, "SQ": 45, "SPRINT": 45, "R": 120}
DATA_LAG_MINUTES = 60
STALE_AFTER_HOURS = 6
MIN_SESSION_DRIVERS = 5
SESSION_ORDER = ["FP1", "FP2", "FP3", "SQ", "SPRINT", "Q", "R"]
RACE_LIKE = ["R", "SPRINT"]
QUALI_LIKE = ["Q", "SQ"]
PRACTICE = ["FP1", "FP2", "FP3"]
INDICATIVE = ["FP1", "FP2", "FP3", "SQ"]

# --- fixed values: points and tyres ----------------------------------------
RACE_POINTS = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}
SPRINT_POINTS = {1: 8, 2: 7, 3: 6, 4: 5, 5: 4, 6: 3, 7: 2, 8: 1}
COMPOUND_LETTERS = {"SOFT": "S", "MEDIUM": "M", "HARD": "H", "INTERMEDIATE": "I", "WET": "W"}
KMH_TO_MPH = 0.621371

# --- fixed values: fuel, pace and wear -------------------------------------
FUEL_SECONDS_PER_KG = 0.025
FUEL_KG_PER_RACE = 70.0
PACE_CEILING = 0.10
DIRTY_AIR_S = 0.5
MIN_FIT_LAPS = 5
REFERENCE_AGE = 13
WEAR_FLAG_RATIO = 1.5

# --- fixed values: corners, straights and telemetry ------------------------
CORNER_HALF_WINDOW_M = 75.0
STRAIGHT_MARGIN_M = 50.0
LOW_SPEED_KMH = 125.0
MID_SPEED_KMH = 200.0
MIN_CORNER_LAPS = 5
TARGET_CORNER_LAPS = 8
TEAMMATE_CONFIDENCE = 0.6
UNRELIABLE_FACTOR = 0.5
QUALI_FULL_THROTTLE = 99.0
FULL_THROTTLE = 98.0
MAX_THROTTLE = 100.0
MAX_LATERAL_MS2 = 2.0
MAX_LONGITUDINAL_MS2 = 20.0
MAX_LENGTH_DEVIATION_M = 100.0
GRID_STEP_M = 10.0
CORNER_GRID_POINTS = 50
CUTOFF_HZ = 1.5
MIN_STRAIGHT_M = 250.0
MIN_STRAIGHT_TOP_KMH = 250.0
MIN_CLIP_M = 40.0
MIN_CLIP_SAMPLES = 3
CLIP_SPEED_KMH = 280.0
CLIP_TOP_SHARE = 0.85
CLIP_DROP_KMH = 3.0
RISING_SPEED_KMH = 200.0
MIN_RISING_SAMPLES = 6
DEPLETION_MS2 = -2.0
SUPERCLIP_RESIDUAL_MS2 = -6.5
SUPERCLIP_GATE_MS2 = -6.0
MAX_RESIDUAL_MS2 = 15.0
MIN_CORNER_LOSS_KMH = 40.0
TOP_TEAMS = 5

# --- fixed values: season and signals --------------------------------------
RACE_WEIGHT = 0.6
QUALI_WEIGHT = 0.4
HALF_LIFE_ROUNDS = 6.0
SPEED_BIN_KMH = 10.0
MIN_BIN_SAMPLES = 5
MIN_BAND_BINS = 2
PUNCH_LO, HOLD_LO = 250.0, 290.0
SCATTER_POINTS = 2000
HARVEST_BAND = (150.0, 250.0)
MIN_BAND_POINTS = 8
MAX_CORNER_DELTA = 18.0
MAX_STRAIGHT_DEFICIT = 20.0
REAL_STRAIGHT_KMH = 300.0
PROFILE_CORNER_KMH = 15.0
PROFILE_STRAIGHT_KMH = 20.0
PROFILE_CONFIDENCE = 0.5
MIN_CLEAN_AIR_LAPS = 5
CLEAN_AIR_RANK_DELTA = 2
MIN_POSITION_SWING = 2
PROGRESSION_MIN_S = 0.05
RESIDUAL_MIN_S = 0.05
MIN_CLIP_DEFICIT_M = 100.0
MIN_SLOPE_DEVIATION = 0.01
OBVIOUS_DISCOUNT = 0.5
EXPECTATION_FLOOR = 0.15

# Circuit length in km by locality.
CIRCUIT_KM = {
    "Melbourne": 5.278,
    "Shanghai": 5.451,
    "Suzuka": 5.807,
    "Sakhir": 5.412,
    "Jeddah": 6.174,
    "Miami Gardens": 5.412,
    "Imola": 4.909,
    "Monte Carlo": 3.337,
    "Montréal": 4.361,
    "Barcelona": 4.657,
    "Spielberg": 4.318,
    "Silverstone": 5.891,
    "Budapest": 4.381,
    "Spa-Francorchamps": 7.004,
    "Zandvoort": 4.259,
    "Monza": 5.793,
    "Baku": 6.003,
    "Marina Bay": 4.940,
    "Austin": 5.513,
    "Mexico City": 4.304,
    "São Paulo": 4.309,
    "Las Vegas": 6.201,
    "Lusail": 5.419,
    "Yas Island": 5.281,
    "Madrid": 5.474,
}

# Power-unit supply, works team first.
POWER_UNITS = {
    "Mercedes": ["Mercedes", "Alpine", "McLaren", "Williams"],
    "Ferrari": ["Ferrari", "Haas F1 Team", "Cadillac"],
    "Red Bull": ["Red Bull Racing", "Racing Bulls"],
    "Honda": ["Aston Martin"],
    "Audi": ["Audi"],
}

# Driver names by three-letter code.
DRIVER_NAMES = {
    "VER": "Max Verstappen",
    "RUS": "George Russell",
    "ANT": "Kimi Antonelli",
    "NOR": "Lando Norris",
    "PIA": "Oscar Piastri",
    "LEC": "Charles Leclerc",
    "HAM": "Lewis Hamilton",
    "ALO": "Fernando Alonso",
    "STR": "Lance Stroll",
    "GAS": "Pierre Gasly",
    "OCO": "Esteban Ocon",
    "ALB": "Alexander Albon",
    "SAI": "Carlos Sainz",
    "COL": "Franco Colapinto",
    "HAD": "Isack Hadjar",
    "LAW": "Liam Lawson",
    "HUL": "Nico Hulkenberg",
    "BOR": "Gabriel Bortoleto",
    "BEA": "Oliver Bearman",
    "BOT": "Valtteri Bottas",
    "PER": "Sergio Perez",
    "LIN": "Arvid Lindblad",
}

# What one address and one e-mail may do in an hour.
MOST_FROM_ADDRESS = 5
MOST_TO_EMAIL = 3
