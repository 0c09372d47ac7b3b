"""Scouting plans on hand-made sheets with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from trackloom.plans import scouting as P

MAP = "map<string,string>"
MATCHES = f"matchNumber double, red array<string>, blue array<string>, redBreakdown {MAP}, blueBreakdown {MAP}, ingest_order long"


def sheet(spark, game, rows):
    cols = sorted({game.columns[k] for r in rows for k in r})
    data = [(i, *[str(next((v for k, v in r.items() if game.columns[k] == c), "")) for c in cols]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(["ingest_order long", *[f"`{c}` string" for c in cols]]))


@pytest.fixture(scope="module")
def reef(spark):
    g = P.reefscape()
    rows = [
        dict(matchNumber="1", teamNumber=" 11 ", coralL1Auto="2", coralL2Tele="4x", bargeAlgaeAuto="1", bargeAlgaeTele="3", movedInAuto="Yes", endPosition="Deep Climb", comments="b"),
        dict(matchNumber="1", teamNumber="12", coralL1Auto="6", coralL2Tele="4"),
        dict(matchNumber="1", teamNumber="13"),
        dict(matchNumber="2", teamNumber="11", noShow="x", comments="a"),
        dict(matchNumber="3", teamNumber="11", coralL1Auto="5"),
        dict(matchNumber="4", teamNumber=""),
    ]
    official = {"autoReef.trough": "4", "teleopReef.trough": "4", "autoReef.tba_botRowCount": "2", "teleopReef.tba_botRowCount": "12", "netAlgaeCount": "8", "endGameRobot1": "ShallowCage", "autoLineRobot1": "No"}
    matches = spark.createDataFrame([(1.0, ["11", "12", "13"], ["21", "22", "23"], official, None, 0), (1.0, ["99", "98", "97"], ["21", "22", "23"], official, None, 1)], MATCHES)
    return g, P.typed_projection(sheet(spark, g, rows), g), matches


def test_observations(reef):
    _, obs, _ = reef
    r = obs.where("matchNumber = 1 and teamNumber = '11'").first()
    assert (r.coralL1Auto, r.coralL2Tele, r.movedInAuto, r.robot) == (2.0, 4.0, True, "") and obs.count() == 5


def test_team_aggregates(reef):
    g, obs, _ = reef
    r = {x.teamNumber: x for x in P.aggregate_teams(obs, g).collect()}
    a = r["11"]
    assert (a.matches, a.noShows, a.autoCoralL1, a.pctMovedAuto, a.endDeepCage) == (2, 1, 3.5, 50, 50)
    assert [c.text for c in a.comments] == ["b", "a"]
    assert r["13"].matches == 1 and r["13"].autoCoralTotal == 0.0


def test_no_played_matches_give_zero(spark):
    g = P.reefscape()
    obs = P.typed_projection(sheet(spark, g, [dict(matchNumber="1", teamNumber="7", noShow="true", coralL1Auto="3")]), g)
    r = P.aggregate_teams(obs, g).first()
    assert (r.matches, r.noShows, r.autoCoralL1, r.pctDied) == (0, 1, 0.0, 0)


def test_fusion(reef):
    g, obs, matches = reef
    per, team = P.fuse(obs, matches, g)
    r = per.where("teamNumber = '11'").first()
    assert r.autoCoralL1 == pytest.approx(4 * 2 / 8)
    # 2 + 12 > 12: cumulative, so 10 net, shared 4 : 8
    assert r.teleopCoralL2 == pytest.approx(10 * 4 / 8)
    assert r.teleopCoralL1 == 0.0 and r.autoCoralL4 is None
    assert (r.autoAlgaeBarge, r.teleopAlgaeBarge) == (pytest.approx(2.0), pytest.approx(6.0))
    assert (r.endgamePts, r.autoMobilityPts) == (6.0, 0.0)
    t = {x.teamNumber: x for x in team.collect()}
    assert (t["11"].total, t["11"].withTBA, t["11"].withFullScouting) == (2, 1, 1) and t["11"].autoCoralTotal is None
    assert P.reporting_mode(matches, g).first()["mode"] == "cumulative"


def test_points(reef):
    g, obs, matches = reef
    _, team = P.fuse(obs, matches, g)
    r = P.points_2025(team, fused=True).where("teamNumber = '11'").first()
    # nobody was seen scoring row 2 in auto: a third of 2 each
    assert r.epaAuto == pytest.approx(1 * 3 + 2 / 3 * 4 + 2 * 4) and r.epaTeleop == pytest.approx(5 * 3 + 6 * 4) and r.epaTotal == pytest.approx(r.epaAuto + r.epaTeleop + 6)
    one = P.match_points_2025(obs).where("matchNumber = 1 and teamNumber = '11'").first()
    assert one.matchEPA == pytest.approx(3 + 12 + 2 * 3 + 4 * 3 + 1 * 4 + 3 * 4)
    rows = P.accounting(obs, matches, {"l1": (F.col("coralL1Auto"), F.try_element_at("breakdown", F.lit("autoReef.trough")).cast("double"))})
    r = rows.first()
    assert (r.side, r.l1_scouted, r.l1_official, r.l1_delta) == ("red", 8.0, 4.0, 4.0)
    assert P.captured(rows, ["l1"]).first().l1_pct == 200.0


def test_game_lookup_and_overrides(spark):
    assert P.game_for("2026mawor").year == "2026" and P.game_for(None) is None and P.game_for("1999x") is None
    g = P.reefscape()
    raw = spark.createDataFrame([("5", "3")], "Team string, `Match Number` string")
    assert P.typed_projection(raw, g, {"teamNumber": "Team"}).first().teamNumber == "5"


def test_hub_fusion(spark):
    g = P.rebuilt()
    rows = [dict(matchNumber="1", teamNumber="1", fuelScoredAuto="3", shift1Scorer="true", scoringEff="4", climbedEndgame="L2"), dict(matchNumber="1", teamNumber="2", fuelScoredAuto="1", shift1Scorer="true", scoringEff="0", climbedEndgame="No")]
    obs = P.typed_projection(sheet(spark, g, rows), g)
    first = obs.where("teamNumber = '1'").first()
    assert first.climbedEndgame and first.whereClimbed == "l2"
    hub = {"hubScore.autoCount": "8", "hubScore.transitionCount": "5", "hubScore.shift1Count": "5", "hubScore.shift2Count": "6", "hubScore.endgameCount": "9", "endGameTowerRobot1": "Level3"}
    matches = spark.createDataFrame([(1.0, ["1", "2", "3"], ["4", "5", "6"], hub, None, 0)], MATCHES)
    per, team = P.fuse(obs, matches, g)
    r = per.where("teamNumber = '1'").first()
    # auto: 3 of 3 + 1 + 1 (unscouted: 1)
    assert r.autoFuelFused == pytest.approx(8 * 3 / 5)
    # shift 1: 4 of 4 + 1 (effectiveness 0 counts as 1) + 1 (no history)
    # shift 2: only the unscouted one weighs
    assert r.teleFuelFused == pytest.approx(10 * 4 / 6)
    assert r.endgamePts == 30.0 and r.endgameFuelFused == 0.0
    agg = {x.teamNumber: x for x in P.aggregate_teams(obs, g, matches).collect()}
    # active: transition, shift 1, shift 2, endgame; scored in the first two
    assert agg["1"].activeScorerRate == 0.5 and agg["1"].endgamePts == 20.0
    assert P.points_2026(team, fused=True).where("teamNumber = '1'").first().epaEndgame == 30.0


def test_foreign_sheet(spark):
    raw = spark.createDataFrame([("7", "88", "Y", "1", "12", "Very Effective", "1", "1", "b", "d", "1", "[20]")], "`m (MatchScouting1)` string, `Team Number` string, DidEndRung2 string, AutoCollectDepot string, CalculatedAuto string, PostDefenseRating string, AutoCollectOutpost string, Period1RoleNeutral string, PeriodOnePerformance string, PeriodTwoPerformance string, Period2RolePassing string, PrematchAutoStart string")
    r = P.foreign_sheet(raw).first()
    assert (r["Climbed"], r["Auto Action 2"], r["Defense Skill"], r["Auto Action 1"], r["No Show"]) == ("L2", "Collect Depot+Outpost", "8", "Scored", "FALSE")
    assert (r["TS1 Scorer?"], r["S2 Scorer?"], r["S2 Shuttler?"], r["Scoring Effectiveness"], r["Starting Position"]) == ("TRUE", "FALSE", "TRUE", "9.0", "Hub")
    native = spark.createDataFrame([("1",)], "`Match Number` string")
    assert P.foreign_sheet(native) is native
    assert [x.g for x in spark.createDataFrame([("a",), ("J ",), ("z",)], "v string").select(P.letter_grade("v").alias("g")).collect()] == [10, 1, None]
