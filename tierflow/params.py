"""Constants of the models; values that other systems' results depend on are marked as fixed."""

from __future__ import annotations

from statistics import NormalDist

# Score bands from the best on, as (least score, grade, penalty units), and what differs in mode Double.
GRADE_BANDS = (
    (995_000, "SSS+", 0), (990_000, "SSS", 1), (985_000, "SS+", 2), (980_000, "SS", 3), (975_000, "S+", 4), (970_000, "S", 5),
    (960_000, "AAA+", 7), (950_000, "AAA", 9), (940_000, "AA+", 11), (920_000, "AA", 14), (900_000, "A+", 17), (800_000, "A", 22),
    (700_000, "B", 30), (600_000, "C", 40), (500_000, "D", 50), (0, "F", 60),
)
DOUBLE_PENALTIES = {"AA": 13, "A+": 15, "A": 20, "B": 25, "C": 30, "D": 40, "F": 50}
# Medals from the least to the best, as (name, code, bonus units), and what differs in mode Double.
MEDALS = (
    ("Rough Game", "RG", 0), ("Fair Game", "FG", 1), ("Talented Game", "TG", 2), ("Marvelous Game", "MG", 3),
    ("Superb Game", "SG", 4), ("Extreme Game", "EG", 7), ("Ultimate Game", "UG", 8.5), ("Perfect Game", "PG", 10),
)
DOUBLE_BONUSES = {"Extreme Game": 6, "Ultimate Game": 8}
# Factors of archive values by least score.
ARCHIVE_FACTORS = (
    (995_000, 1.00), (990_000, 0.96), (985_000, 0.92), (980_000, 0.88), (975_000, 0.84), (970_000, 0.80),
    (960_000, 23 / 30), (950_000, 22 / 30), (925_000, 21 / 30), (900_000, 20 / 30), (825_000, 18 / 30),
)
# Names of the seven effect bands, from the easiest on.
BANDS = ("Overrated", "Very Easy", "Easy", "Medium", "Hard", "Very Hard", "Underrated")

# Grades to aim at in the group mode by whole difficulty.
GROUP_GOALS = {
    10: "SSS+", 11: "SSS+", 12: "SSS", 13: "SS", 14: "S", 15: "S", 16: "S", 17: "AAA", 18: "AAA",
    19: "AA+", 20: "AA+", 21: "AA+", 22: "A", 23: "A", 24: "A",
}

# Thresholds of the ladders' groups, by mode; a group's rungs are numbered from 1.
TITLE_STEPS = (
    ("Beginner", (0,)),
    ("Intermediate", (5000, 6000, 7000, 8000, 9000, 10000, 11000, 12000, 13000, 14000)),
    ("Advanced", (15000, 15250, 15500, 15750, 16000, 16250, 16500, 16750, 17000, 17250)),
    ("Expert", (17500, 17700, 17900, 18100, 18300, 18500, 18600, 18700, 18800, 18900)),
    ("Master", (19000,)),
)
RANK_STEPS = (
    ("Unranked", (0,)), ("Bronze", (10000, 10500, 11000, 11500, 12000)), ("Silver", (12500, 13000, 13500, 14000, 14500)),
    ("Gold", (15000, 15200, 15400, 15600, 15800)), ("Platinum", (16000, 16200, 16400, 16600, 16800)),
    ("Diamond", (17000, 17200, 17400, 17600, 17800)), ("Red Beryl", (18000, 18200, 18400, 18600, 18800)),
    ("Alexandrite", (19000, 19200, 19400, 19600, 19800)), ("Highest", (20000,)),
)
GROUP_STEPS = (
    ("No title", (0,)), ("Level", (1000, 2000, 3000, 4000, 5000, 6000, 7000, 8000, 9000, 10000)),
    ("Advanced", (12000,)), ("Expert", (14000,)), ("Master", (16000,)),
)

MODES = ("Single", "Double")
GROUP, GROUP_ANCHORS, GROUP_MEDAL = "CoOp", (10.0, 16.0, 24.9), "Fair Game"
MIN_LEVEL, BASE_FIRST, BASE_LAST, MIN_ATTEMPTS = 16, 11, 30, 50
FRACTION, FALLBACK, PUBLISHED, PROVISIONAL, LIMITED = 0.2, 100, 10, 5, 20
BIN, BIN_SCORE, BIN_ROWS, BIN_LEVELS = 2500, 900_000, 30, 3
SCALE, RANGE_ITEMS, DEFAULT_K, LEAST_K, MOST_K = 0.4, 30, 5.0, 0.5, 20.0
CLIP = 2.5 * 1.4826
TOP, SHOWN, RATING_TOP, RADIUS = 50, 50, 20, 1.0
PEER_TARGETS, PEER_RADII = (20, 10, 5), (0.2, 0.3, 0.4, 0.5)
#: Folds of entities, step of a surface's axes, radii of its smoothing and of its support, and the least support.
FOLDS, STEP, SMOOTH, SUPPORT_RADIUS, LEAST_SUPPORT = 5, 0.1, 8, 5, 5
#: Weight of the population's medals, what an unseen medal counts, and how many archive medals may count at most.
MEDAL_PRIOR, MEDAL_ROOM, MEDAL_CAPS, DEFAULT_CAP = 8.0, 0.25, (5, 10, 20, 40, 80), 20
RESAMPLES, SEED = 500, 20260807
#: Points of a mean score in one bin of abilities.
ABILITY_BIN = 250
#: Rows of a key that are resampled as one array, or whose values one aggregate or one window takes up.
HELD = 50_000
SOURCE_WEIGHTS = {"archive": 1.0, "current": 2.0}
#: Multiplier of the reference result (grade S with the second medal) of the skill rating.
REFERENCE = (750 - 5 * 5 + 1) / 750


def normal_maximum(n: int) -> float:
    """Expected largest of ``n`` standard normal draws (Blom); 0 for one or none."""
    return NormalDist().inv_cdf((n - 0.375) / (n + 0.25)) if n > 1 else 0.0


def compression(n: int) -> float:
    """How much the range of a folder with ``n`` measured items is drawn in."""
    return 1.0 if n <= RANGE_ITEMS else min(1.0, normal_maximum(RANGE_ITEMS) / normal_maximum(n))


def rungs(steps: tuple) -> list[tuple[str, int]]:
    """(label, threshold) of each rung, numbered where a group has several."""
    return [(f"{name} {i}" if len(bounds) > 1 else name, b) for name, bounds in steps for i, b in enumerate(bounds, 1)]
