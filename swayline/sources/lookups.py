"""Literal lookup tables."""

# Contest-source name -> observation-source name.
GROUP_NAMES = {
    "Adelaide": "Adelaide Crows",
    "Geelong": "Geelong Cats",
    "Gold Coast": "Gold Coast SUNS",
    "GWS": "GWS GIANTS",
    "Sydney": "Sydney Swans",
    "West Coast": "West Coast Eagles",
    "Footscray": "Western Bulldogs",
}

# Names that are spelled the same in both sources.
SHARED_GROUP_NAMES = [
    "Brisbane Lions", "Carlton", "Collingwood", "Essendon", "Fremantle", "Hawthorn",
    "Melbourne", "North Melbourne", "Port Adelaide", "Richmond", "St Kilda",
]

# Role -> position codes.
ROLE_CODES = {
    "forward": ["HFFL", "FF", "CHF", "FPL", "FPR", "HFFR"],
    "midfielder": ["WR", "WL", "C", "R", "RR"],
    "defender": ["FB", "HBFR", "BPR", "CHB", "HBFL", "BPL"],
    "ruck": ["RK"],
    "sub": ["SUB"],
    "bench": ["INT"],
}

# One entity known under two names.
ENTITY_ALIASES = {"Cam Ellis-Yolmen": "Cameron Ellis-Yolmen"}


def group_name_table(spark, pairs=None, shared=None):
    """Two-column lookup (contest_name, observation_name), one row per group."""
    pairs = GROUP_NAMES if pairs is None else pairs
    shared = SHARED_GROUP_NAMES if shared is None else shared
    rows = list(pairs.items()) + [(name, name) for name in shared]
    return spark.createDataFrame(rows, "contest_name string, observation_name string")
