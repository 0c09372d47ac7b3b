"""Scouting: typed observations, team aggregates, and fusion with match totals.

A game is a :class:`Game`: column map, typed fields, and the lists of statistics to
fuse, each a function that builds a Column. Everything is a plan over whole tables:
observations (event, match, team) joined with matches, never a loop over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars as S

Build = Callable[[], Column]
ORDER = "ingest_order"


@dataclass
class Shared:
    """A statistic shared out in proportion to what scouts saw."""

    key: str
    scout: Column
    official: Column
    auto: Column | None = None
    cap: float | None = None


@dataclass
class Split:
    auto_key: str
    teleop_key: str
    scout_auto: Column
    scout_teleop: Column
    official: Column


@dataclass
class PerRobot:
    key: str
    scout: Column
    official: Callable[[Column], Column]


@dataclass
class Game:
    year: str
    columns: dict[str, str]
    kinds: dict[str, str]  # number | flag | text
    aggregate: Callable[[DataFrame], DataFrame]
    auto_stats: list[Shared] = field(default_factory=list)
    teleop_stats: list[Shared] = field(default_factory=list)
    split_stats: list[Split] = field(default_factory=list)
    robot_stats: list[PerRobot] = field(default_factory=list)
    custom: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None
    custom_keys: list[str] = field(default_factory=list)
    enrich: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] | None = None
    derive: dict[str, Column] = field(default_factory=dict)
    finish: Callable[[DataFrame], DataFrame] | None = None


def column_map(game: Game, overrides: dict[str, str] | None = None) -> dict[str, str]:
    return game.columns | (overrides or {})


def typed_projection(raw: DataFrame, game: Game, overrides: dict[str, str] | None = None, adapter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sheet rows (all text) to observations. A missing header reads as ''; rows
    without a team go. ``ingest_order`` keeps the sheet's order."""
    if ORDER not in raw.columns:
        raw = raw.withColumn(ORDER, F.monotonically_increasing_id())
    if adapter:
        raw = adapter(raw)
    make = {"number": S.leading_number, "flag": S.flag, "text": S.trimmed}
    have = set(raw.columns)
    picked = []
    for name, header in column_map(game, overrides).items():
        src = F.col(f"`{header}`").cast("string") if header in have else F.lit("")
        picked.append(make[game.kinds[name]](src).alias(name))
    out = raw.select(ORDER, *picked)
    return (game.finish(out) if game.finish else out).where("teamNumber != ''")


def _mean(x) -> Column:
    return F.coalesce(F.sum(F.when(~F.col("noShow"), S.c(x).cast("double"))), F.lit(0.0)) / F.greatest(F.count_if(~F.col("noShow")), F.lit(1))


def _rate(cond: Column, among: Column | None = None) -> Column:
    base = ~F.col("noShow") if among is None else ~F.col("noShow") & among
    return S.percent(F.count_if(base & cond), F.count_if(base))


def _comments() -> Column:
    said = F.collect_list(F.when(F.col("comments") != "", F.struct("matchNumber", ORDER, F.col("comments").alias("text"))))
    return F.transform(F.array_sort(said), lambda x: F.struct(x["matchNumber"].alias("matchNumber"), x["text"].alias("text")))


def _matches() -> list[Column]:
    return [F.count_if(~F.col("noShow")).alias("matches"), F.count_if(F.col("noShow")).alias("noShows")]


# -- 2025 ---------------------------------------------------------------------
def _levels(period: str) -> Column:
    return sum((F.col(f"coralL{i}{period}") for i in range(2, 5)), F.col(f"coralL1{period}"))


def _aggregate_2025(obs: DataFrame) -> DataFrame:
    coral = [_mean(f"coralL{i}{p}").alias(f"{n}CoralL{i}") for p, n in (("Auto", "auto"), ("Tele", "teleop")) for i in range(1, 5)]
    algae = [_mean(f"{s}Algae{p}").alias(f"{n}Algae{k}") for p, n in (("Auto", "auto"), ("Tele", "teleop")) for s, k in (("barge", "Barge"), ("proc", "Proc"))]
    totals = [_mean(_levels(p)).alias(f"{n}CoralTotal") for p, n in (("Auto", "auto"), ("Tele", "teleop"))]
    totals += [_mean(F.col(f"bargeAlgae{p}") + F.col(f"procAlgae{p}")).alias(f"{n}AlgaeTotal") for p, n in (("Auto", "auto"), ("Tele", "teleop"))]
    rates = [_rate(F.col(f)).alias(k) for f, k in (("movedInAuto", "pctMovedAuto"), ("touchedCage", "pctCageTouch"), ("died", "pctDied"), ("tippedOver", "pctTipped"), ("defended", "pctDefended"))]
    ends = [_rate(F.lower("endPosition") == v).alias(k) for v, k in (("not parked", "endNone"), ("parked", "endParked"), ("shallow climb", "endShallowCage"), ("deep climb", "endDeepCage"))]
    skill = [_mean("offenseSkill").alias("avgOffense"), _mean("defenseSkill").alias("avgDefense")]
    return obs.groupBy("teamNumber").agg(*_matches(), *coral, *algae, *totals, *rates, *ends, *skill, _comments().alias("comments"))


def _endgame_2025() -> Column:
    e = F.lower("endPosition")
    return F.when(e == "deep climb", 12.0).when(e == "shallow climb", 6.0).when(e == "parked", 2.0).otherwise(0.0)


def _at(path: str) -> Column:
    """A number of the official breakdown, a map from dotted name to text."""
    return F.try_element_at("breakdown", F.lit(path)).try_cast("double")


def _slot(prefix: str) -> Callable[[Column], Column]:
    return lambda i: F.try_element_at("breakdown", F.concat(F.lit(prefix), i.cast("string")))


def _reef(period: str, row: str) -> Column:
    return _at(f"{period}Reef.{row}")


# The official names of the four coral rows.
_ROWS = ("trough", "tba_botRowCount", "tba_midRowCount", "tba_topRowCount")


def reefscape() -> Game:
    """The 2025 game."""
    # Canonical field and the sheet's default header.
    columns = {
        "matchNumber": "Match Number", "teamNumber": "Team Number", "robot": "Robot", "startingPos": "Starting Pos.", "noShow": "No Show", "cagePos": "Cage Pos.",
        "movedInAuto": "Moved in Auto", "coralL1Auto": "Coral 1 Auto", "coralL2Auto": "Coral 2 Auto", "coralL3Auto": "Coral 3 Auto", "coralL4Auto": "Coral 4 Auto",
        "bargeAlgaeAuto": "Barge Algae Auto", "procAlgaeAuto": "Proc. Algae Auto", "dislodgedAlgaeAuto": "Dislodged Algae Auto", "autoFoul": "Auto Foul",
        "coralL1Tele": "Coral 1 Tele", "coralL2Tele": "Coral 2 Tele", "coralL3Tele": "Coral 3 Tele", "coralL4Tele": "Coral 4 Tele", "bargeAlgaeTele": "Barge Algae",
        "procAlgaeTele": "Proc Algae", "tippedOver": "Tipped/Fell Over", "touchedCage": "Touched Cage?", "died": "Died", "endPosition": "End Position", "defended": "Defended",
        "matchResult": "Match Result", "offenseSkill": "Offense Skill", "defenseSkill": "Defense Skill", "yellowRed": "Yellow/Red", "comments": "Comments",
    }
    flags = {"noShow", "movedInAuto", "autoFoul", "tippedOver", "touchedCage", "died", "defended", "yellowRed"}
    texts = {"teamNumber", "robot", "startingPos", "cagePos", "endPosition", "matchResult", "comments"}
    mobility, end = _slot("autoLineRobot"), _slot("endGameRobot")

    def end_points(i: Column) -> Column:
        v = F.lower(end(i))
        return F.when(v.isNull() | (v == ""), None).when(v == "deepcage", 12.0).when(v == "shallowcage", 6.0).when(v == "parked", 2.0).otherwise(0.0)

    return Game(
        year="2025",
        columns=columns,
        kinds={k: "flag" if k in flags else "text" if k in texts else "number" for k in columns},
        aggregate=_aggregate_2025,
        auto_stats=[Shared(f"autoCoralL{i + 1}", F.col(f"coralL{i + 1}Auto"), _reef("auto", r)) for i, r in enumerate(_ROWS)],
        teleop_stats=[Shared(f"teleopCoralL{i + 1}", F.col(f"coralL{i + 1}Tele"), _reef("teleop", r), _reef("auto", r), None if i == 0 else 12) for i, r in enumerate(_ROWS)],
        split_stats=[
            Split("autoAlgaeBarge", "teleopAlgaeBarge", F.col("bargeAlgaeAuto"), F.col("bargeAlgaeTele"), _at("netAlgaeCount")),
            Split("autoAlgaeProc", "teleopAlgaeProc", F.col("procAlgaeAuto"), F.col("procAlgaeTele"), _at("wallAlgaeCount")),
        ],
        robot_stats=[
            PerRobot("autoMobilityPts", F.when(F.col("movedInAuto"), 3.0).otherwise(0.0), lambda i: F.when(mobility(i).isNotNull(), F.when(mobility(i) == "Yes", 3.0).otherwise(0.0))),
            PerRobot("endgamePts", _endgame_2025(), end_points),
        ],
        derive={f"{p}CoralTotal": S.sum_if_all(*[f"{p}CoralL{i}" for i in range(1, 5)]) for p in ("auto", "teleop")},
    )


# Points of each fused statistic.
WEIGHTS_2025 = {
    "autoCoralL1": 3, "autoCoralL2": 4, "autoCoralL3": 6, "autoCoralL4": 7, "teleopCoralL1": 2, "teleopCoralL2": 3, "teleopCoralL3": 4, "teleopCoralL4": 5,
    "autoAlgaeBarge": 4, "teleopAlgaeBarge": 4, "autoAlgaeProc": 2, "teleopAlgaeProc": 2, "autoMobilityPts": 1, "endgamePts": 1,
}
WEIGHTS_2026 = {"autoFuelFused": 1, "teleFuelFused": 1, "autoClimbPts": 1, "endgamePts": 1, "endgameFuelFused": 1}


def points_2025(stats: DataFrame, fused: bool) -> DataFrame:
    """auto, teleop, endgame and total points of a row of fused or raw statistics."""
    pick = lambda start: {k: w for k, w in WEIGHTS_2025.items() if k.startswith(start) and k != "autoMobilityPts"}
    mobility = F.coalesce(F.col("autoMobilityPts"), F.lit(0.0)) if fused else F.col("pctMovedAuto") / 100 * 3
    end = F.coalesce(F.col("endgamePts"), F.lit(0.0)) if fused else (F.col("endParked") * 2 + F.col("endShallowCage") * 6 + F.col("endDeepCage") * 12) / 100
    out = stats.withColumns({"epaAuto": S.weighted_points(pick("auto")) + mobility, "epaTeleop": S.weighted_points(pick("teleop")), "epaEndgame": end})
    return out.withColumn("epaTotal", F.col("epaAuto") + F.col("epaTeleop") + F.col("epaEndgame"))


def match_points_2025(obs: DataFrame) -> DataFrame:
    """One observation's score; a no-show's counts are those of no rows."""
    played = ~F.col("noShow")
    value = lambda f: F.when(played, F.col(f)).otherwise(0.0)
    out = F.when(F.col("movedInAuto"), 3.0).otherwise(0.0) + _endgame_2025()
    for p, n in (("Auto", "auto"), ("Tele", "teleop")):
        for i in range(1, 5):
            out = out + value(f"coralL{i}{p}") * float(WEIGHTS_2025[f"{n}CoralL{i}"])
        out = out + value(f"bargeAlgae{p}") * 4.0 + value(f"procAlgae{p}") * 2.0
    return obs.withColumn("matchEPA", out)


# -- 2026 ---------------------------------------------------------------------
_ROLES = ("Scorer", "Shuttler", "Defender", "Died")


def _climb_points() -> Column:
    w = F.lower("whereClimbed")
    return F.when(F.col("climbedEndgame"), F.when(w == "l3", 30.0).when(w == "l2", 20.0).otherwise(10.0)).otherwise(0.0)


def _any_shift(role: str) -> Column:
    out = F.col(f"shift1{role}")
    for i in (2, 3, 4):
        out = out | F.col(f"shift{i}{role}")
    return out


def _aggregate_2026(obs: DataFrame) -> DataFrame:
    shifts = [_rate(F.col(f"shift{i}{r}")).alias(f"shift{i}{r}Pct") for i in range(1, 5) for r in _ROLES]
    levels = [_rate(F.lower("whereClimbed") == f"l{i}", F.col("climbedEndgame")).alias(f"pctL{i}") for i in (1, 2, 3)]
    return obs.groupBy("teamNumber").agg(
        *_matches(), _rate(F.col("fuelScoredAuto") > 0).alias("autoFuelPct"), _mean("fuelScoredAuto").alias("avgAutoFuel"), _rate(F.col("climbedAuto")).alias("autoClimbPct"),
        _rate(F.col("successClimbAuto")).alias("autoClimbSuccessPct"), _mean(F.when(F.col("climbedAuto"), 15.0).otherwise(0.0)).alias("autoClimbPts"), *shifts,
        _rate(_any_shift("Scorer")).alias("pctScored"), _rate(_any_shift("Defender")).alias("pctDefended"), _rate(_any_shift("Died")).alias("pctDied"),
        _rate(F.col("climbedEndgame")).alias("climbPct"), *levels, _mean(_climb_points()).alias("endgamePts"), _rate(F.col("fuelEndgame")).alias("endgameFuelPct"),
        _mean("scoringEff").alias("avgScoringEff"), _mean("passingSkill").alias("avgPassingSkill"), _mean("defenseSkill").alias("avgDefenseSkill"), _comments().alias("comments"),
    )


def _hub(name: str) -> Column:
    return _at(f"hubScore.{name}")


def _has_hub() -> Column:
    return F.exists(F.map_keys("breakdown"), lambda k: k.startswith("hubScore."))


def enrich_2026(agg: DataFrame, obs: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds activeScorerRate and replaces shift rates by those over matches in which
    the hub was active, where there are any. The last match of a number counts."""
    seen = alliance_side(obs.where(~F.col("noShow")), matches, first=False).where(_has_hub())
    active = {1: F.lit(True)} | {i: F.coalesce(_hub(f"shift{i}Count"), F.lit(0.0)) > 0 for i in (2, 3, 4)}
    sums = []
    for i in range(1, 5):
        sums.append(F.count_if(active[i]).alias(f"_n{i}"))
        sums += [F.count_if(active[i] & F.col(f"shift{i}{r}")).alias(f"_{r}{i}") for r in _ROLES]
    first = F.coalesce(_hub("shift1Count"), F.lit(0.0)) > 0
    periods = [(F.lit(True), "shift1Scorer"), (first, "shift1Scorer"), (active[2], "shift2Scorer"), (active[3], "shift3Scorer"), (active[4], "shift4Scorer"), (F.lit(True), "fuelEndgame")]
    could = sum((F.count_if(a) for a, _ in periods[1:]), F.count_if(periods[0][0]))
    did = sum((F.count_if(a & F.col(f)) for a, f in periods[1:]), F.count_if(periods[0][0] & F.col(periods[0][1])))
    rates = seen.groupBy("teamNumber").agg(*sums, could.alias("_could"), did.alias("_did"))
    out = agg.join(rates, "teamNumber", "left")
    changed = {f"shift{i}{r}Pct": F.when(F.col(f"_n{i}") > 0, S.percent(F.col(f"_{r}{i}"), F.col(f"_n{i}"))).otherwise(F.col(f"shift{i}{r}Pct")) for i in range(1, 5) for r in _ROLES}
    changed["activeScorerRate"] = F.when(F.col("_could") > 0, F.col("_did") / F.col("_could")).otherwise(0.0)
    return out.withColumns(changed).drop(*[c for c in rates.columns if c.startswith("_")])


def _periods(hub: Callable[[str], Column]) -> list[tuple[str, Column, str]]:
    first = F.coalesce(hub("transitionCount"), F.lit(0.0)) + F.coalesce(hub("shift1Count"), F.lit(0.0))
    return [("shift1Scorer", first, "tele"), ("shift2Scorer", hub("shift2Count"), "tele"), ("shift3Scorer", hub("shift3Count"), "tele"), ("shift4Scorer", hub("shift4Count"), "tele"), ("fuelEndgame", hub("endgameCount"), "end")]


def fuse_hub_2026(sides: DataFrame, scouted: DataFrame, aggs: DataFrame) -> DataFrame:
    """Per (match, team): autoFuelFused, teleFuelFused, endgameFuelFused.

    Each period's official count is shared by weight: a scouted robot's flag times
    its effectiveness; an unscouted one's usual rate times its usual effectiveness
    (1 without history). If all weigh nothing, usual weights share, then thirds.
    """
    usual = aggs.select(F.col("teamNumber").alias("mate"), "activeScorerRate", "avgScoringEff", "avgAutoFuel")
    mates = sides.where(_has_hub()).select("matchNumber", "teamNumber", "alliance", "breakdown", F.posexplode("alliance").alias("slot", "mate"))
    row = scouted.select("matchNumber", F.col("teamNumber").alias("mate"), F.lit(True).alias("_seen"), "scoringEff", "fuelScoredAuto", "shift1Scorer", "shift2Scorer", "shift3Scorer", "shift4Scorer", "fuelEndgame")
    m = mates.join(row, ["matchNumber", "mate"], "left").join(usual, "mate", "left")
    assumed = F.when(F.col("avgScoringEff").isNull(), 1.0).otherwise(F.coalesce("activeScorerRate", F.lit(0.0)) * S.truthy_or("avgScoringEff", 1.0))
    mine = F.col("mate") == F.col("teamNumber")
    aggregates = [F.first("breakdown").alias("breakdown")]

    def pair(name: str, weight: Column) -> list[Column]:
        return [F.sum(weight).alias(f"_all_{name}"), F.max(F.when(mine, weight)).alias(f"_own_{name}")]

    for flag, _, _ in _periods(_hub):
        aggregates += pair(flag, F.when(F.col("_seen"), F.when(F.col(flag), S.truthy_or("scoringEff", 1.0)).otherwise(0.0)).otherwise(assumed))
    aggregates += pair("assumed", assumed)
    aggregates += pair("auto", F.when(F.col("_seen"), F.coalesce("fuelScoredAuto", F.lit(0.0))).otherwise(F.coalesce("avgAutoFuel", F.lit(1.0))))
    g = m.groupBy("matchNumber", "teamNumber").agg(*aggregates)

    def share(name: str, fallback: Column) -> Column:
        return F.when(F.col(f"_all_{name}") > 0, F.col(f"_own_{name}") / F.col(f"_all_{name}")).otherwise(fallback)

    third = F.lit(1.0) / 3
    parts: dict[str, list[Column]] = {"tele": [], "end": []}
    for flag, count, period in _periods(_hub):
        parts[period].append(share(flag, share("assumed", third)) * count)
    tele = F.filter(F.array(*parts["tele"]), lambda v: v.isNotNull())
    return g.select(
        "matchNumber", "teamNumber", (share("auto", third) * _hub("autoCount")).alias("autoFuelFused"),
        F.when(F.size(tele) > 0, F.aggregate(tele, F.lit(0.0), lambda a, v: a + v)).alias("teleFuelFused"), parts["end"][0].alias("endgameFuelFused"),
    )


def rebuilt() -> Game:
    """The 2026 game."""
    # Canonical field and the sheet's default header.
    columns = {
        "matchNumber": "Match Number", "teamNumber": "Team Number", "startingPos": "Starting Position", "noShow": "No Show", "autoAction1": "Auto Action 1", "autoAction2": "Auto Action 2",
        "climbedAuto": "Climbed Auto", "successClimbAuto": "Successful Climb", "fuelScoredAuto": "Fuel Scored in Auto?", "climbedEndgame": "Climbed", "whereClimbed": "Climbed",
        "fuelEndgame": "Scored Fuel in Endgame?", "scoringEff": "Scoring Effectiveness", "passingSkill": "Passing Skill", "defenseSkill": "Defense Skill", "shuttleStyle": "Shuttle Style?", "comments": "Comments",
    } | {f"shift{i}{r}": f"{s} {r}?" for i, s in enumerate(("TS1", "S2", "S3", "S4"), 1) for r in _ROLES}
    texts = {"teamNumber", "startingPos", "autoAction1", "autoAction2", "climbedEndgame", "whereClimbed", "shuttleStyle", "comments"}
    numbers = {"matchNumber", "fuelScoredAuto", "scoringEff", "passingSkill", "defenseSkill"}
    auto, end = _slot("autoTowerRobot"), _slot("endGameTowerRobot")

    def finish(d: DataFrame) -> DataFrame:
        level = F.lower("whereClimbed")
        return d.withColumns({"climbedEndgame": ~F.lower("climbedEndgame").isin("", "no"), "whereClimbed": level})

    def end_points(i: Column) -> Column:
        v = F.lower(end(i))
        return F.when(v.isNull() | v.isin("", "none"), None).when(v == "level3", 30.0).when(v == "level2", 20.0).when(v == "level1", 10.0).otherwise(0.0)

    return Game(
        year="2026",
        columns=columns,
        kinds={k: "text" if k in texts else "number" if k in numbers else "flag" for k in columns},
        aggregate=_aggregate_2026,
        robot_stats=[
            PerRobot("autoClimbPts", F.when(F.col("climbedAuto"), 15.0).otherwise(0.0), lambda i: F.when(auto(i).isNotNull() & (auto(i) != "None"), F.when(auto(i).isin("Level1", "true"), 15.0).otherwise(0.0))),
            PerRobot("endgamePts", _climb_points(), end_points),
        ],
        custom=fuse_hub_2026,
        custom_keys=["autoFuelFused", "teleFuelFused", "endgameFuelFused"],
        enrich=enrich_2026,
        derive={"totalFuelFused": F.col("autoFuelFused") + F.col("teleFuelFused") + F.coalesce("endgameFuelFused", F.lit(0.0))},
        finish=finish,
    )


def points_2026(stats: DataFrame, fused: bool) -> DataFrame:
    if fused:
        z = lambda k: F.coalesce(F.col(k), F.lit(0.0))
        parts = {"epaAuto": z("autoFuelFused") + z("autoClimbPts"), "epaTeleop": z("teleFuelFused"), "epaEndgame": z("endgamePts") + z("endgameFuelFused")}
    else:
        parts = {"epaAuto": F.col("autoClimbPct") / 100 * 15, "epaTeleop": F.col("avgScoringEff") * 2, "epaEndgame": (F.col("pctL1") * 10 + F.col("pctL2") * 20 + F.col("pctL3") * 30) / 100}
    return stats.withColumns(parts).withColumn("epaTotal", F.col("epaAuto") + F.col("epaTeleop") + F.col("epaEndgame"))


def fuel_total(breakdown: str = "breakdown") -> Column:
    """An alliance's fuel over all seven periods; null without hub data or auto count."""
    names = ("autoCount", "transitionCount", "shift1Count", "shift2Count", "shift3Count", "shift4Count", "endgameCount")
    value = lambda k: F.try_element_at(breakdown, F.lit(f"hubScore.{k}")).try_cast("double")
    rest = sum((F.coalesce(value(k), F.lit(0.0)) for k in names[2:]), F.coalesce(value(names[1]), F.lit(0.0)))
    return F.when(value("autoCount").isNotNull(), value("autoCount") + rest)


GAMES: dict[str, Callable[[], Game]] = {"2025": reefscape, "2026": rebuilt}


def game_for(event_key: str | None) -> Game | None:
    """The game of an event by its year, or None."""
    make = GAMES.get((event_key or "")[:4])
    return make() if make else None


# -- joins and fusion ---------------------------------------------------------
def unique_match(matches: DataFrame, first: bool = True) -> DataFrame:
    """One match per number: the first (fusion) or the last (enrichment) read."""
    m = matches if ORDER in matches.columns else matches.withColumn(ORDER, F.monotonically_increasing_id())
    own = F.struct(*[c for c in m.columns if c != "matchNumber"])
    pick = (F.min_by if first else F.max_by)(own, F.col(ORDER))
    return m.groupBy("matchNumber").agg(pick.alias("m")).select("matchNumber", "m.*").drop(ORDER)


def observation_index(obs: DataFrame) -> DataFrame:
    """(match, team) to observation; the last duplicate wins."""
    own = F.struct(*[c for c in obs.columns if c not in ("matchNumber", "teamNumber")])
    return obs.groupBy("matchNumber", "teamNumber").agg(F.max_by(own, F.col(ORDER)).alias("o")).select("matchNumber", "teamNumber", "o.*")


def alliance_side(obs: DataFrame, matches: DataFrame, first: bool = True) -> DataFrame:
    """Observations with their match's alliance, breakdown and robot slot (from 1).
    ``matches``: matchNumber, red, blue (arrays), redBreakdown, blueBreakdown (maps).
    Red is looked at before blue. Observations without both are left out."""
    m = unique_match(matches, first).select("matchNumber", "red", "blue", "redBreakdown", "blueBreakdown")
    j = obs.join(m, "matchNumber")
    red, blue = F.array_contains("red", F.col("teamNumber")), F.array_contains("blue", F.col("teamNumber"))
    j = j.withColumns({
        "alliance": F.when(red, F.col("red")).when(blue, F.col("blue")), "breakdown": F.when(red, F.col("redBreakdown")).when(blue, F.col("blueBreakdown")),
    }).where("breakdown is not null")
    return j.withColumn("robot_slot", F.array_position("alliance", F.col("teamNumber"))).drop("red", "blue", "redBreakdown", "blueBreakdown")


def reporting_mode(matches: DataFrame, game: Game) -> DataFrame:
    """One row: whether official teleop counts include auto (cumulative), don't
    (separate), or there is no telling (unknown)."""
    sides = matches.select(F.explode(F.array("redBreakdown", "blueBreakdown")).alias("breakdown")).where("breakdown is not null")
    over, under = F.lit(0), F.lit(0)
    for s in game.teleop_stats:
        if s.cap is not None:
            auto, raw = F.coalesce(s.auto, F.lit(0.0)), F.coalesce(s.official, F.lit(0.0))
            over, under = over + (auto + raw > s.cap).cast("int"), under + (raw < auto).cast("int")
    total = sides.agg(F.coalesce(F.sum(over), F.lit(0)).alias("over"), F.coalesce(F.sum(under), F.lit(0)).alias("under"))
    return total.select("over", "under", F.when(F.col("over") > F.col("under"), "cumulative").when(F.col("under") > F.col("over"), "separate").otherwise("unknown").alias("mode"))


def aggregate_teams(obs: DataFrame, game: Game, matches: DataFrame | None = None) -> DataFrame:
    agg = game.aggregate(obs)
    return game.enrich(agg, obs, matches) if game.enrich and matches is not None else agg


def fuse(obs: DataFrame, matches: DataFrame, game: Game) -> tuple[DataFrame, DataFrame]:
    """(per match and team, per team): scouts' shares of official totals.

    The second has each statistic's mean over matches (nulls left out) and the
    coverage counters total, withTBA and withFullScouting, which count duplicates.
    """
    index = observation_index(obs)
    seen = obs.where(~F.col("noShow"))
    sides = alliance_side(seen, matches)
    scouted = index.select("matchNumber", F.col("teamNumber").alias("mate"), F.struct(*[c for c in index.columns if c not in ("matchNumber", "teamNumber")]).alias("row"))
    slots = sides.select("matchNumber", "teamNumber", ORDER, F.explode("alliance").alias("mate")).join(scouted, ["matchNumber", "mate"], "left")
    stats = [(s.key, s.scout) for s in [*game.auto_stats, *game.teleop_stats]] + [(s.auto_key, s.scout_auto + s.scout_teleop) for s in game.split_stats]
    flat = slots.select("matchNumber", "teamNumber", ORDER, "row.*", (F.col("row").isNotNull()).alias("_seen")) if stats else slots.select("matchNumber", "teamNumber", ORDER, F.col("row").isNotNull().alias("_seen"))
    if stats:
        flat = slots.select("matchNumber", "teamNumber", F.col(ORDER).alias("_order"), F.col("row").isNotNull().alias("_seen"), "row.*")
        sums = flat.groupBy("matchNumber", "teamNumber", "_order").agg(F.every("_seen").alias("_full"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"_all_{k}") for k, x in stats])
    else:
        sums = flat.groupBy("matchNumber", "teamNumber", F.col(ORDER).alias("_order")).agg(F.every("_seen").alias("_full"))
    d = sides.withColumn("_order", F.col(ORDER)).join(sums, ["matchNumber", "teamNumber", "_order"]).crossJoin(F.broadcast(reporting_mode(matches, game)))  # one row
    out = {s.key: S.share_weighted(s.scout, f"_all_{s.key}", s.official) for s in game.auto_stats}
    for s in game.teleop_stats:
        net = F.when(F.col("mode") != "separate", F.greatest(F.lit(0.0), s.official - F.coalesce(s.auto, F.lit(0.0)))).otherwise(s.official)
        out[s.key] = S.share_weighted(s.scout, f"_all_{s.key}", F.when(s.official.isNotNull(), net))
    for s in game.split_stats:
        total = S.share_weighted(s.scout_auto + s.scout_teleop, f"_all_{s.auto_key}", s.official)
        out[s.auto_key], out[s.teleop_key] = S.split_by_ratio(total, s.scout_auto, s.scout_teleop)
    for s in game.robot_stats:
        out[s.key] = F.coalesce(s.official(F.col("robot_slot")), s.scout)
    keys = list(out)
    per = d.select("matchNumber", "teamNumber", "_order", "_full", "mode", *[v.alias(k) for k, v in out.items()])
    # a later duplicate of (match, team) replaces the earlier one
    last = per.groupBy("matchNumber", "teamNumber").agg(F.max_by(F.struct(*keys), "_order").alias("v")).select("matchNumber", "teamNumber", "v.*")
    if game.custom:
        aggs = aggregate_teams(index, game, matches)
        one = sides.dropDuplicates(["matchNumber", "teamNumber"])
        last = last.join(game.custom(one, index, aggs), ["matchNumber", "teamNumber"], "left")
        keys += game.custom_keys
    team = last.groupBy("teamNumber").agg(*[F.avg(k).alias(k) for k in keys])
    counted = per.groupBy("teamNumber").agg(F.count("*").alias("withTBA"), F.count_if("_full").alias("withFullScouting"))
    cover = seen.groupBy("teamNumber").agg(F.count("*").alias("total")).join(counted, "teamNumber", "left").na.fill(0, ["withTBA", "withFullScouting"])
    team = cover.join(team, "teamNumber", "left")
    return last, team.withColumns(game.derive) if game.derive else team


def accounting(obs: DataFrame, matches: DataFrame, stats: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Scouted against official totals per alliance whose robots were all scouted:
    (matchNumber, side, and per statistic scouted, official, delta)."""
    index = observation_index(obs)
    m = unique_match(matches)
    sides = m.select("matchNumber", F.explode(F.array(F.struct(F.lit("red").alias("side"), F.col("red").alias("alliance"), F.col("redBreakdown").alias("breakdown")), F.struct(F.lit("blue").alias("side"), F.col("blue").alias("alliance"), F.col("blueBreakdown").alias("breakdown")))).alias("s")).select("matchNumber", "s.*")
    each = sides.where("breakdown is not null").select("matchNumber", "side", "breakdown", F.size("alliance").alias("_n"), F.explode("alliance").alias("teamNumber")).join(index, ["matchNumber", "teamNumber"])
    g = each.groupBy("matchNumber", "side", "_n").agg(F.count("*").alias("_have"), F.first("breakdown").alias("breakdown"), *[F.sum(scout).alias(f"{k}_scouted") for k, (scout, _) in stats.items()]).where("_have = _n")
    g = g.withColumns({f"{k}_official": official for k, (_, official) in stats.items()})
    g = g.withColumns({f"{k}_delta": F.col(f"{k}_scouted") - F.col(f"{k}_official") for k in stats})
    return g.drop("_have", "_n", "breakdown")


def captured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean delta and percentage captured per statistic (null where officially 0)."""
    cols = []
    for k in keys:
        cols += [F.avg(f"{k}_delta").alias(f"{k}_mean_delta"), F.when(F.sum(f"{k}_official") != 0, F.sum(f"{k}_scouted") / F.sum(f"{k}_official") * 100).alias(f"{k}_pct")]
    return rows.agg(*cols)


def attribution_shares(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Each row's whole-percent share of its group per key, 33 where the group has none."""
    w = Window.partitionBy(*by)
    return rows.withColumns({f"{k}_share": F.when(F.sum(k).over(w) > 0, S.half_up(F.col(k) / F.sum(k).over(w) * 100)).otherwise(F.lit(33)) for k in keys})


def foreign_sheet(raw: DataFrame) -> DataFrame:
    """Row adapter of the archived 2026 sheet with another layout; rows that are
    native already pass."""
    have = set(raw.columns)
    if "m (MatchScouting1)" not in have and "Match Number" in have:
        return raw
    g = lambda k: S.trimmed(F.col(f"`{k}`").cast("string")) if k in have else F.lit("")
    yes = lambda k: (g(k) == "1") | (F.upper(g(k)) == "Y")
    tf = lambda b: F.when(b, "TRUE").otherwise("FALSE")
    zones = F.array_join(F.array_compact(F.array(*[F.when(yes(f"AutoCollect{z}"), z) for z in ("Depot", "Neutral", "Outpost")])), "+")
    defense = F.when(g("PostDefenseRating") == "Not Effective", "2").when(g("PostDefenseRating") == "Average", "5").when(g("PostDefenseRating") == "Very Effective", "8").otherwise("0")
    role = lambda i, r: g(f"Period{i}Role{r}") == "1"
    # Start codes, and the columns of the four period grades.
    where = {"[4]": "Trench", "[36]": "Trench", "[20]": "Hub", "[12]": "Bump", "[28]": "Bump"}
    periods = ("PeriodOnePerformance", "PeriodTwoPerformance", "PeriodThreePerformance", "PeriodFourPerformance")
    start = F.coalesce(*[F.when(g("PrematchAutoStart") == k, v) for k, v in where.items()], F.lit(""))
    grades = F.array_compact(F.array(*[F.when(role(i, "Alliance") | role(i, "Neutral"), letter_grade(g(c))) for i, c in enumerate(periods, 1)]))
    mean = F.aggregate(grades, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(grades), F.lit(1))
    effect = S.half_up(mean * 10) / 10
    out = {
        "Match Number": g("m (MatchScouting1)"), "Team Number": g("Team Number"), "No Show": tf(yes("PostNoShow")), "Auto Action 1": F.when(S.leading_number(g("CalculatedAuto")) > 0, "Scored").otherwise("NoAction"),
        "Auto Action 2": F.when(zones != "", F.concat(F.lit("Collect "), zones)).otherwise(""), "Climbed Auto": tf(yes("AutoClimbYes")), "Successful Climb": tf(yes("AutoClimbYes")),
        "Fuel Scored in Auto?": F.when(g("CalculatedAuto") != "", g("CalculatedAuto")).otherwise("0"),
        "Climbed": F.when(yes("DidEndRung3"), "L3").when(yes("DidEndRung2"), "L2").when(yes("DidEndRung1"), "L1").otherwise("No"),
        "Scored Fuel in Endgame?": tf(yes("EndgameRoleAlliance") | yes("EndgameRoleNeutral")), "Passing Skill": F.when(g("PassingRolePerformance") != "", g("PassingRolePerformance")).otherwise("0"),
        "Defense Skill": defense, "Shuttle Style?": F.lit(""), "Comments": g("PostNote"), "Starting Position": start, "Scoring Effectiveness": effect.cast("string"),
    }
    for i, s in enumerate(("TS1", "S2", "S3", "S4"), 1):
        held = {"Scorer": role(i, "Alliance") | role(i, "Neutral"), "Shuttler": role(i, "Passing"), "Defender": role(i, "Defending"), "Died": role(i, "NonFunctioning")}
        out |= {f"{s} {k}?": tf(v) for k, v in held.items()}
    return raw.select(*([ORDER] if ORDER in have else []), *[v.alias(k) for k, v in out.items()])


def letter_grade(x) -> Column:
    """a to j as 10 to 1, else null."""
    v = F.lower(S.trimmed(x))
    return F.when(v.rlike("^[a-j]$"), F.lit(10) - (F.ascii(v) - F.lit(97)))
