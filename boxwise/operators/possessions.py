"""Individual possessions and ratings by the published formulas of basketball analysis (D. Oliver).

``p``, ``t`` and ``o`` name the stats of the player, of the own team and of
the opponents. Every division is null where it has no meaning.

``Team_Possessions`` weighs free throws made by 0.44, as the system whose
figures these must match does, where the published formula has attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Box-score stats that the formulas read.
BOX = ["MP", "FGM", "FGA", "FG3M", "FTM", "FTA", "ORB", "DRB", "AST", "STL", "BLK", "TOV", "PF", "PTS"]


def with_totals(box: DataFrame, event: str, team: str) -> DataFrame:
    """Player rows with sums of their team (t_*) and of the event's other teams (o_*), over players with minutes.

    Both are windows over the rows of an event: where the box is dealt by
    event, rows stay in their task and are sorted once. An event's sum takes
    each team's total once, so that an event of one team has others of just 0.
    A row without a team adds to the others of its event's teams, and goes.
    """
    played = box.where((F.coalesce("MP", F.lit(0)) > 0) & F.col(event).isNotNull())
    own, both = Window.partitionBy(event, team).orderBy(team), Window.partitionBy(event)
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = [c for c in box.columns if c not in (event, team)]
    summed = played.select(event, team, *rest, *[F.sum(s).over(whole).alias(f"t_{s}") for s in BOX], (F.row_number().over(own) == 1).alias("_first"))
    others = [(F.sum(F.when(F.col("_first"), F.col(f"t_{s}"))).over(both) - F.col(f"t_{s}")).alias(f"o_{s}") for s in BOX]
    return summed.select("*", *others).where(F.col(team).isNotNull()).drop("_first")


def _d(a, b) -> Column:
    return F.try_divide(a, b)


def possession_columns(df: DataFrame) -> DataFrame:
    """Adds the parts of the formulas and TotPoss, Stops, StopPercent, PProd, FloorPercent, ORtg and DRtg."""
    c = F.col
    steps: list[dict[str, Column]] = [
        {
            "qAST": _d(c("MP"), c("t_MP") / 5) * (1.14 * _d(c("t_AST") - c("AST"), c("t_FGM")))
            + _d(_d(c("t_AST"), c("t_MP")) * c("MP") * 5 - c("AST"), _d(c("t_FGM"), c("t_MP")) * c("MP") * 5 - c("FGM")) * (1 - _d(c("MP"), c("t_MP") / 5)),
            "AST_Part": 0.5 * _d((c("t_PTS") - c("t_FTM")) - (c("PTS") - c("FTM")), 2 * (c("t_FGA") - c("FGA"))) * c("AST"),
            "FT_Part": F.when(c("FTA") == 0, 0.0).otherwise((1 - F.pow(1 - _d(c("FTM"), c("FTA")), F.lit(2))) * 0.4 * c("FTA")),
            "Team_Scoring_Poss": c("t_FGM") + (1 - F.pow(1 - _d(c("t_FTM"), c("t_FTA")), F.lit(2))) * c("t_FTA") * 0.4,
            "Team_ORB_percent": _d(c("t_ORB"), c("t_ORB") + c("o_DRB")),
        },
        {
            "FG_Part": F.when(c("FGA") == 0, 0.0).otherwise(c("FGM")) * (1 - 0.5 * F.coalesce(_d(c("PTS") - c("FTM"), 2 * c("FGA")), F.lit(0.0)) * c("qAST")),
            "Team_Play_percent": _d(c("Team_Scoring_Poss"), c("t_FGA") + c("t_FTA") * 0.4 + c("t_TOV")),
        },
        {"Team_ORB_Weight": _d((1 - c("Team_ORB_percent")) * c("Team_Play_percent"), (1 - c("Team_ORB_percent")) * c("Team_Play_percent") + c("Team_ORB_percent") * (1 - c("Team_Play_percent")))},
        {
            "ORB_Part": c("ORB") * c("Team_ORB_Weight") * c("Team_Play_percent"),
            "kept": 1 - _d(c("t_ORB"), c("Team_Scoring_Poss")) * c("Team_ORB_Weight") * c("Team_Play_percent"),
            "FGxPoss": (c("FGA") - c("FGM")) * (1 - 1.07 * c("Team_ORB_percent")),
            "FTxPoss": F.when(c("FTA") == 0, 0.0).otherwise(F.pow(1 - _d(c("FTM"), c("FTA")), F.lit(2)) * 0.4 * c("FTA")),
        },
        {"ScPoss": (c("FG_Part") + c("AST_Part") + c("FT_Part")) * c("kept") + c("ORB_Part")},
        {"TotPoss": c("ScPoss") + c("FGxPoss") + c("FTxPoss") + c("TOV")},
        {
            "PProd_FG": F.when(c("FGA") == 0, 0.0).otherwise(2.0) * (c("FGM") + 0.5 * c("FG3M")) * (1 - 0.5 * F.coalesce(_d(c("PTS") - c("FTM"), 2 * c("FGA")), F.lit(0.0)) * c("qAST")),
            "PProd_AST": 2 * _d(c("t_FGM") - c("FGM") + 0.5 * (c("t_FG3M") - c("FG3M")), c("t_FGM") - c("FGM")) * 0.5
            * _d((c("t_PTS") - c("t_FTM")) - (c("PTS") - c("FTM")), 2 * (c("t_FGA") - c("FGA"))) * c("AST"),
            "PProd_ORB": c("ORB") * c("Team_ORB_Weight") * c("Team_Play_percent") * _d(c("t_PTS"), c("Team_Scoring_Poss")),
        },
        {"PProd": (c("PProd_FG") + c("PProd_AST") + c("FTM")) * c("kept") + c("PProd_ORB")},
        {
            "FloorPercent": F.when(c("TotPoss") > 0, _d(c("ScPoss"), c("TotPoss"))),
            "ORtg": F.when(c("TotPoss") > 0, 100 * _d(c("PProd"), c("TotPoss"))),
            "Team_Possessions": c("o_FGA") + 0.44 * c("o_FTM") + c("o_TOV") - c("o_ORB"),
            "DOR_percent": _d(c("o_ORB"), c("o_ORB") + c("t_DRB")),
            "DFG_percent": _d(c("o_FGM"), c("o_FGA")),
        },
        {"FMwt": _d(c("DFG_percent") * (1 - c("DOR_percent")), c("DFG_percent") * (1 - c("DOR_percent")) + (1 - c("DFG_percent")) * c("DOR_percent"))},
        {
            "Stops1": c("STL") + c("BLK") * c("FMwt") * (1 - 1.07 * c("DOR_percent")) + c("DRB") * (1 - c("FMwt")),
            "Stops2": (_d(c("o_FGA") - c("o_FGM") - c("t_BLK"), c("t_MP")) * c("FMwt") * (1 - 1.07 * c("DOR_percent")) + _d(c("o_TOV") - c("t_STL"), c("t_MP"))) * c("MP")
            + _d(c("PF"), c("t_PF")) * 0.4 * c("o_FTA") * F.pow(1 - _d(c("o_FTM"), c("o_FTA")), F.lit(2)),
        },
        {"Stops": c("Stops1") + c("Stops2")},
        {
            "StopPercent": _d(c("Stops") * c("o_MP"), c("Team_Possessions") * c("MP")),
            "Team_DRtg": 100 * _d(c("o_PTS"), c("Team_Possessions")),
            "D_Pts": _d(c("o_PTS"), c("o_FGM") + (1 - F.pow(1 - _d(c("o_FTM"), c("o_FTA")), F.lit(2))) * c("o_FTA") * 0.4),
        },
        {"DRtg": c("Team_DRtg") + 0.2 * (100 * c("D_Pts") * (1 - c("StopPercent")) - c("Team_DRtg"))},
    ]
    for step in steps:
        df = df.withColumns(step)
    return df


def per_100(df: DataFrame, stats: list[str]) -> DataFrame:
    """Adds ``*_per100poss``."""
    return df.withColumns({f"{s}_per100poss": _d(F.col(s) * 100, F.col("TotPoss")) for s in stats})
