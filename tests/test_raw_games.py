"""Raw rows to typed tables, rejects and audits."""

from skirmish.operators import raw_games as R


def raw(spark, rows):
    blank = dict.fromkeys([*R.ALL_COLUMNS, "tier"], "")
    base = blank | {"datetime": "2024-01-02 03:04:05", "team1": "A", "team2": "B", "tier": "tier1", "bestOf": "3"}
    return spark.createDataFrame([base | r for r in rows], ", ".join(f"`{c}` string" for c in blank))


def aliases(spark):
    return spark.createDataFrame([("B", "Beta")], "alias string, canonical string")


def test_series(spark):
    total = {"is_total": "True"}
    df = raw(spark, [total | {"match_id": "1", "score1_match": "2", "score2_match": "1"}, total | {"match_id": "2", "score1_match": "", "bestOf": "2"}, total | {"match_id": "3", "score1_match": "1", "score2_match": "1"}, {"is_total": "False", "match_id": "1"}])
    good, bad = R.series_base(df, aliases(spark))
    row = good.collect()
    assert len(row) == 1 and (row[0]["match_id"], row[0]["team2_canonical"], row[0]["team1_canonical"], row[0]["team1_series_win"], row[0]["bestOf"]) == (1, "Beta", "A", 1, 3)
    assert row[0]["datetime"].year == 2024
    assert {r["match_id"]: r["reject_reason"] for r in bad.collect()} == {"2": "missing_score;missing_bestOf", "3": "tie"}


def players(*ids, side=1, **stats):
    out = {}
    for n, i in enumerate(ids, 1):
        out |= {R.slot(side, n, "id"): str(i), R.slot(side, n): f"p{i}"} | {R.slot(side, n, k): str(v) for k, v in stats.items()}
    return out


def test_maps_and_players(spark):
    game = {"is_total": "False", "map_id": "7", "map_name": "Nuke", "score1_game": "13", "score2_game": "7", "bestOf": ""}
    full = {"kills": 20, "deaths": 10, "assists": 5, "adr": 80, "kast": 0.7, "kddiff": 10}
    df = raw(
        spark,
        [
            game | {"match_id": "1", "game_id": "11"} | players(1, 2, 2, **full) | players(3, side=2, kills=4),
            game | {"match_id": "1", "game_id": "12"} | players(1, **full) | players(1, side=2, **full),
            game | {"match_id": "1", "game_id": "13", "map_name": ""},
            game | {"match_id": "1", "game_id": "14", "score1_game": "7"},
            game | {"match_id": "1", "game_id": "15", "score1_game": ""},
            game | {"match_id": "1", "game_id": "16", "score1_game": "", "map_id": ""},
        ],
    )
    good, bad = R.map_base(df, aliases(spark))
    assert {r["game_id"]: r["reject_reason"] for r in bad.collect()} == {"13": "missing_map_name", "14": "tie", "15": "other", "16": "blank_map_row"}
    rows = {(r["game_id"], r["player"]): r for r in R.observations(good).collect()}
    assert set(rows) == {(11, 1), (11, 2), (11, 3)}
    one = rows[11, 1]
    assert abs(one["kd_balance"] - 1 / 3) < 1e-12 and one["assists_per_round"] == 0.25 and one["has_usable_stats"]
    assert not rows[11, 3]["has_usable_stats"] and rows[11, 3]["team"] == "Beta"


def test_audits(spark):
    df = raw(
        spark,
        [
            {"is_total": "True", "match_id": "1", "game_id": "-11", "games_played": "2", "team1_win": "1", "score1_match": "2", "score2_match": "0", "team1_id": "5"},
            {"is_total": "False", "match_id": "1", "game_id": "11", "map_id": "3"},
            {"is_total": "False", "match_id": "1", "game_id": "11", "map_id": ""},
            {"is_total": "True", "match_id": "2", "game_id": "", "games_played": "3", "tier": "tier2", "team1_win": "1", "score1_match": "0", "score2_match": "1", "team1_id": "6"},
        ],
    )
    totals = {r["tier"]: r for r in R.audit_totals(df).collect()}
    assert totals[None]["matches"] == 2 and totals["tier1"]["blank_map_rows"] == 1 and totals["tier2"]["one"] == 1
    ids = R.audit_game_ids(df).first()
    assert (ids["map_duplicates"], ids["series_blank"], ids["series_negative"], ids["negative_with_positive"]) == (1, 1, 1, 1)
    played = R.audit_games_played(df).first()
    assert (played["series"], played["checked"], played["mismatch"]) == (2, 2, 1)
    assert {(r["winner"], r["flag"]): r["n"] for r in R.audit_win_flag(df).collect()} == {("team1", 1.0): 1, ("team2", 1.0): 1}
    assert {r["is_total"]: r["map_id"] for r in R.audit_blanks(df, ["map_id"]).collect()} == {"True": 100.0, "False": 50.0}
    tiers = {(r["tiers"], r["in_all"]): r["matches"] for r in R.audit_tiers(df, df.where("match_id = '1'")).collect()}
    assert tiers == {("tier1", True): 1, ("tier2", False): 1}
    look = R.audit_lookup(df, ["team1_id"], spark.createDataFrame([(5,)], "team_id long"), "team_id").first()
    assert (look["ids"], look["known"], look["missing"]) == (2, 1, 1)
