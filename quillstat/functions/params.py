"""Fixed values that define the semantics: column specifications, court, thresholds."""

# Fixed values: (source column, label, kind); kinds: int, f1 (one decimal), pct (fraction to per cent), min (minutes).
BOX = [
    ("minutes", "MIN", "min"), ("points", "PTS", "int"), ("reboundsTotal", "REB", "int"), ("assists", "AST", "int"),
    ("steals", "STL", "int"), ("blocks", "BLK", "int"), ("turnovers", "TOV", "int"), ("foulsPersonal", "PF", "int"),
    ("reboundsOffensive", "OREB", "int"), ("reboundsDefensive", "DREB", "int"), ("plusMinusPoints", "+/-", "int"),
]
SHOOT = [
    ("fieldGoalsMade", "FGM", "int"), ("fieldGoalsAttempted", "FGA", "int"), ("fieldGoalsPercentage", "FG%", "pct"),
    ("threePointersMade", "3PM", "int"), ("threePointersAttempted", "3PA", "int"), ("threePointersPercentage", "3P%", "pct"),
    ("freeThrowsMade", "FTM", "int"), ("freeThrowsAttempted", "FTA", "int"), ("freeThrowsPercentage", "FT%", "pct"),
]
ADV = [
    ("offensiveRating", "ORTG", "f1"), ("defensiveRating", "DRTG", "f1"), ("netRating", "NETRTG", "f1"),
    ("usagePercentage", "USG%", "pct"), ("trueShootingPercentage", "TS%", "pct"), ("effectiveFieldGoalPercentage", "eFG%", "pct"),
    ("assistPercentage", "AST%", "pct"), ("reboundPercentage", "REB%", "pct"), ("offensiveReboundPercentage", "OREB%", "pct"),
    ("defensiveReboundPercentage", "DREB%", "pct"), ("turnoverRatio", "TOV ratio", "f1"), ("pace", "PACE", "f1"),
    ("possessions", "POSS", "int"), ("PIE", "PIE%", "pct"),
]
MISC = [
    ("pointsPaint", "PITP", "int"), ("pointsFastBreak", "FB-PTS", "int"), ("pointsSecondChance", "SCP", "int"),
    ("pointsOffTurnovers", "PTS OFF TOV", "int"), ("blocksAgainst", "BLKA", "int"), ("foulsDrawn", "PFD", "int"),
]
HUSTLE = [
    ("deflections", "Deflections", "int"), ("chargesDrawn", "Charges drawn", "int"), ("contestedShots", "Contested shots", "int"),
    ("contestedShots2pt", "Contested 2PT", "int"), ("contestedShots3pt", "Contested 3PT", "int"), ("screenAssists", "Screen assists", "int"),
    ("screenAssistPoints", "Screen ast pts", "int"), ("looseBallsRecoveredOffensive", "Loose balls (off)", "int"),
    ("looseBallsRecoveredDefensive", "Loose balls (def)", "int"), ("looseBallsRecoveredTotal", "Loose balls", "int"),
    ("offensiveBoxOuts", "Box outs (off)", "int"), ("defensiveBoxOuts", "Box outs (def)", "int"), ("boxOuts", "Box outs", "int"),
]
TRACK = [
    ("distance", "Distance (mi)", "f1"), ("speed", "Avg speed (mph)", "f1"), ("touches", "Touches", "int"), ("passes", "Passes", "int"),
    ("secondaryAssists", "Secondary ast", "int"), ("freeThrowAssists", "FT ast", "int"), ("reboundChancesOffensive", "Reb chances (off)", "int"),
    ("reboundChancesDefensive", "Reb chances (def)", "int"), ("reboundChancesTotal", "Reb chances", "int"),
    ("contestedFieldGoalsMade", "Contested FGM", "int"), ("contestedFieldGoalsAttempted", "Contested FGA", "int"),
    ("contestedFieldGoalPercentage", "Contested FG%", "pct"), ("uncontestedFieldGoalsMade", "Uncontested FGM", "int"),
    ("uncontestedFieldGoalsAttempted", "Uncontested FGA", "int"), ("uncontestedFieldGoalsPercentage", "Uncontested FG%", "pct"),
    ("defendedAtRimFieldGoalsMade", "Rim FGM against", "int"), ("defendedAtRimFieldGoalsAttempted", "Rim FGA against", "int"),
    ("defendedAtRimFieldGoalPercentage", "Rim FG% against", "pct"),
]
SUMMARY = [
    ("teamTricode", "TEAM"), ("points", "PTS"), ("pointsInThePaint", "PITP"), ("pointsFastBreak", "FB-PTS"), ("pointsSecondChance", "SCP"),
    ("pointsFromTurnovers", "PTS OFF TOV"), ("benchPoints", "Bench pts"), ("biggestLead", "Biggest lead"), ("leadChanges", "Lead changes"),
    ("timesTied", "Times tied"), ("biggestScoringRun", "Biggest run"),
]
# What the four factors take from the advanced table.
ADVANCED = {"offensiveReboundPercentage": ("oreb_pct", "pct"), "offensiveRating": ("ortg", "f1"), "defensiveRating": ("drtg", "f1"), "netRating": ("netrtg", "f1"), "pace": ("pace", "f1")}
# Shot zones by distance in feet, both ends included; then the two that have no range.
ZONES = [("At the rim (0-4 ft)", 0, 4), ("Paint / short (5-9 ft)", 5, 9), ("Mid-range (10 ft to the arc)", 10, 99)]
THREES = "Three-pointers"
MILE_KM = 1.609344

# Court in metres, frames a second.
FOOT = 0.3048
COURT_L, COURT_W, HOOP_X = 94 * FOOT, 50 * FOOT, 5.25 * FOOT
# Markings. Lane half its width and deep, free-throw, three-point, restricted and centre radii, the corner three from the sideline.
LANE_HALF, LANE_DEPTH, FT_RADIUS, ARC_R, RESTRICTED_R, CENTRE_R, CORNER_Y = 8 * FOOT, 19 * FOOT, 6 * FOOT, 23.75 * FOOT, 4 * FOOT, 6 * FOOT, 3 * FOOT
FPS = 30
# Tracks and motion.
MIN_TRACK_FRAMES, MIN_INSIDE_SHARE, MIN_COLOUR, INSIDE_MARGIN = 15, 0.6, 10, 0.5
MAX_SPEED, STILL_SPEED, SMOOTH_WINDOW, NEAR_FRAMES = 11.0, 0.35, 15, 5
STITCH_GAP, STITCH_SPEED, STITCH_SLACK = 30, 7.0, 0.7
# Possession.
CONTEST, HOLD_ROWS, HOLD_GAP = 0.3, 5, 4
PASS_GAP, PASS_DIST, STEAL_GAP, BASKET_DIST, FLIP_FRAMES = 75, 1.5, 30, 4.5, 45
# Ball.
BALL_SIDE, BALL_ASPECT, OVERLAY_Y = (5, 45), (0.55, 1.8), 640
STATIC_FRAMES, STATIC_REPEATS, STATIC_PX, STATIC_M = 15, 6, 3.0, 0.3
BALL_SPEED, BALL_SLACK, BALL_GAP, BALL_RESTART, NEAR_PLAYER, NEAR_BONUS = 30.0, 0.8, 10, 0.6, 2.2, 0.25
