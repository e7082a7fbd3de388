"""Point-in-time form against a direct reading of its definition."""

import random
from datetime import datetime, timedelta
from itertools import pairwise
from statistics import fmean, median, pstdev

import pytest

from oddsloom.operators import asof, baselines, sessions
from oddsloom.plans import learned

CUTOFF = datetime(2026, 1, 10, 12, 0)
HISTORY = (
    "event_id long, started_at timestamp, available_at timestamp, sport string, source string, game string, "
    "tournament_key string, format string, player1 string, player2 string, team1 string, team2 string, "
    "score1 int, score2 int"
)
TARGETS = (
    "event_id long, cutoff_at timestamp, sport string, source string, game string, tournament_key string, "
    "format string, player1 string, player2 string, team1 string, team2 string"
)


def matches(history, target, scope, side):
    """(started_at, goals for, goals against) newest first, by definition."""
    (eid, cutoff, sport, source, game, tour, fmt, p1, p2, t1, t2) = target
    player, team = (p1, t1) if side == 1 else (p2, t2)
    seen = [
        h for h in history
        if h[0] != eid and h[1] < cutoff and h[2] < cutoff and h[3] == sport
    ]
    seen.sort(key=lambda h: (h[1], h[0]), reverse=True)
    out = []
    for h in seen:
        (_, at, _, _, hs, hg, ht, hf, a, b, ta, tb, x, y) = h
        if scope in asof.PAIR_SCOPES:
            if (a, b) == (p1, p2):
                direct = True
            elif (a, b) == (p2, p1):
                direct = False
            else:
                continue
            if scope == "h2h_same_direction" and not direct:
                continue
            if scope == "player_team_h2h" and not (
                (a, ta, b, tb) == (p1, t1, p2, t2) or (a, ta, b, tb) == (p2, t2, p1, t1)
            ):
                continue
            out.append((at, x, y) if direct else (at, y, x))
            continue
        if player not in (a, b):
            continue
        keep = {
            "global": True, "source": hs == source, "game": hg == game, "tournament": ht == tour,
            "format": hf == fmt,
            "player_team": (a, ta) == (player, team) or (b, tb) == (player, team),
        }[scope]
        if keep:
            out.append((at, x, y) if a == player else (at, y, x))
    return out


def expected(rows):
    n = len(rows)
    totals = [x + y for _, x, y in rows]
    return (
        n, sum(x > y for _, x, y in rows), sum(x == y for _, x, y in rows),
        round(fmean(x for _, x, _ in rows), 9) if n else 0.0,
        round(fmean(totals), 9) if n else 0.0, float(median(totals)) if n else 0.0,
        round(pstdev(totals), 7) if n > 1 else 0.0,
        round(sum(t > 2.5 for t in totals) / (n or 1), 9),
        round(sum(t < 4.5 for t in totals) / (n or 1), 9),
    )


def compute(spark, history, targets, **options):
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    rows = asof.last_n_form(h, t, **options).collect()
    return {
        (r.event_id, r.cutoff_at, r.scope, r.side, r.last_n): (
            r.matches, r.wins, r.draws, round(r.goals_for_avg, 9), round(r.total_avg, 9),
            r.median_total, round(r.std_total, 7), round(r.over_2_5, 9), round(r.under_4_5, 9),
        )
        for r in rows
    }


def world(seed, count, players=4, late=None):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    history = []
    for eid in range(count):
        at = start + timedelta(minutes=rng.randrange(count * 3))
        delay = rng.randrange(5, 60) if rng.random() < 0.8 else rng.randrange(0, 6000)
        known = late if late and rng.random() < 0.7 else at + timedelta(minutes=delay)
        history.append((
            eid, at, known, rng.choice(["football", "football", "hockey"]), rng.choice("ab"), rng.choice(["g", None]),
            rng.choice(["t", None]), "f", rng.choice("ABCDEFG"[:players]), rng.choice("ABCDEFG"[:players]),
            rng.choice(["x", "y", None]), rng.choice(["x", "y", None]), rng.randrange(5), rng.randrange(5),
        ))
    targets = []
    for h in rng.sample(history, min(60, count)):
        moved = h[1] + timedelta(minutes=rng.choice([0, 0, 30, 500, 3000]))
        targets.append((h[0], moved, h[3], h[4], h[5], h[6], h[7], h[8], h[9], h[10], h[11]))
    return history, targets


def check(spark, history, targets, scopes, windows, **options):
    got = compute(spark, history, targets, scopes=scopes, windows=windows, **options)
    wanted = {}
    for target in {(t[0], t[1]): t for t in targets}.values():
        for scope in scopes:
            for side in (0,) if scope in asof.PAIR_SCOPES else (1, 2):
                if scope == "player_team" and target[9 if side == 1 else 10] is None:
                    continue
                if scope == "player_team_h2h" and (target[9] is None or target[10] is None):
                    continue
                rows = matches(history, target, scope, side or 1)
                for size in (*windows, 0):
                    key = (target[0], target[1], scope, side, size)
                    wanted[key] = expected(rows[:size] if size else rows)
    assert got == wanted


def test_all_scopes_follow_the_definition(spark):
    history, targets = world(1, 220)
    check(spark, history, targets, asof.SCOPES, (1, 5, 20))


def test_bulk_loaded_history(spark):
    """Most results become known at one late moment, so tails are long."""
    history, targets = world(2, 900, players=2, late=datetime(2026, 1, 2, 12))
    check(spark, history, targets, ("global", "h2h"), (3, 10, 50))


@pytest.mark.parametrize("seed,late,rows,bucket", [
    (3, None, 20, 600), (4, datetime(2026, 1, 1, 20), 20, 600), (3, None, 1, 60), (4, datetime(2026, 1, 1, 20), 3, 100_000),
])
def test_chunks_of_any_size_give_the_same_rows(spark, seed, late, rows, bucket):
    history, targets = world(seed, 400, players=2, late=late)
    check(
        spark, history, targets, ("global", "tournament", "h2h"), (2, 7, 30),
        chunk_rows=rows, bucket_seconds=bucket,
    )


def test_results_at_or_after_the_cutoff_are_invisible(spark):
    def row(eid, started, known, **other):
        values = dict(sport="football", p1="A", p2="C", s1=2, s2=1) | other
        return (
            eid, CUTOFF + timedelta(minutes=started), CUTOFF + timedelta(minutes=known), values["sport"],
            "esb", "FC", "l", "2x4", values["p1"], values["p2"], "S", "I", values["s1"], values["s2"],
        )

    history = [
        row(1, -20, -10), row(2, 0, -1), row(3, -10, 0), row(4, -10, 5), row(5, -30, -5, sport="hockey"),
        row(6, -40, -30, p1="B", p2="A", s1=0, s2=3), row(100, -15, -12),
    ]
    target = [(100, CUTOFF, "football", "esb", "FC", "l", "2x4", "A", "B", "S", "F")]
    got = compute(spark, history, target, scopes=("global", "h2h", "h2h_same_direction"), windows=(5,))
    assert got[100, CUTOFF, "global", 1, 0][:2] == (2, 2)
    assert got[100, CUTOFF, "h2h", 0, 0][:4] == (1, 1, 0, 3.0)
    assert got[100, CUTOFF, "h2h_same_direction", 0, 5][0] == 0


def test_a_later_result_never_changes_an_earlier_row(spark):
    history, targets = world(5, 150)
    before = compute(spark, history, targets, scopes=("global",), windows=(5,))
    last = max(t[1] for t in targets)
    extra = [(9000 + i, last + timedelta(minutes=i), last + timedelta(minutes=i + 9), "football", "a", "g", "t", "f",
              "A", "B", None, None, 1, 0) for i in range(20)]
    assert compute(spark, history + extra, targets, scopes=("global",), windows=(5,)) == before


def session_of(rows, cutoff, gap=timedelta(minutes=45)):
    chain = rows[:1]
    for previous, current in pairwise(rows):
        if previous[0] - current[0] > gap:
            break
        chain.append(current)

    def streak(test):
        count = 0
        for row in rows:
            if not test(row):
                break
            count += 1
        return count

    return (
        *[sum(cutoff - at <= timedelta(minutes=m) for at, _, _ in rows) for m in (30, 60, 180)],
        round((cutoff - rows[0][0]).total_seconds() / 60, 6) if rows else -1.0,
        sum(x > y for _, x, y in chain), sum(x == y for _, x, y in chain), sum(x < y for _, x, y in chain),
        sum(x for _, x, _ in chain),
        streak(lambda r: r[1] > r[2]), streak(lambda r: r[1] == r[2]), streak(lambda r: r[1] < r[2]),
    )


@pytest.mark.parametrize("seed,late,cut", [
    (6, None, False), (7, datetime(2026, 1, 1, 18), False), (6, None, True), (7, datetime(2026, 1, 1, 18), True),
])
def test_sessions_and_streaks(spark, seed, late, cut):
    history, targets = world(seed, 350, players=3, late=late)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    rows = sessions.session_form(h, t, cut=cut, chunk_rows=20).collect()
    assert len(rows) == 2 * len({(x[0], x[1]) for x in targets})
    by_key = {(x[0], x[1]): x for x in targets}
    for r in rows:
        target = by_key[r.event_id, r.cutoff_at]
        wanted = session_of(matches(history, target, "global", r.side), r.cutoff_at)
        got = (
            r.matches_last_30m, r.matches_last_1h, r.matches_last_3h,
            round(r.minutes_since_previous_game, 6), r.wins, r.draws, r.losses, r.goals,
            r.consecutive_wins, r.consecutive_draws, r.consecutive_losses,
        )
        assert got == wanted


def test_cut_sessions_of_prompt_results(spark):
    """Long runs over many chunks, every result known within minutes."""
    rng = random.Random(11)
    start, at, history = datetime(2026, 1, 1), 0, []
    for eid in range(500):
        at += rng.choice([5, 10, 20, 44, 45, 46, 200]) if rng.random() < 0.3 else 12
        mine, theirs = (3, 1) if eid % 97 else (0, 2)
        history.append((eid, start + timedelta(minutes=at), start + timedelta(minutes=at + rng.randrange(4, 90)), "football",
                        "a", None, None, "f", "A", rng.choice("BC"), None, None, mine, theirs))
    targets = [(9000 + i, start + timedelta(minutes=rng.randrange(at + 400)), "football", "a", None, None, "f", "A", "B", None, None) for i in range(120)]
    targets += [(h[0], h[1], "football", "a", None, None, "f", "A", "B", None, None) for h in history[::5]]
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    by_key = {(x[0], x[1]): x for x in targets}
    for r in sessions.session_form(h, t, cut=True, chunk_rows=30).collect():
        wanted = session_of(matches(history, by_key[r.event_id, r.cutoff_at], "global", r.side), r.cutoff_at)
        got = (
            r.matches_last_30m, r.matches_last_1h, r.matches_last_3h,
            round(r.minutes_since_previous_game, 6), r.wins, r.draws, r.losses, r.goals,
            r.consecutive_wins, r.consecutive_draws, r.consecutive_losses,
        )
        assert got == wanted


def test_windows_must_be_positive(spark):
    history, targets = world(8, 10)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    with pytest.raises(ValueError):
        asof.last_n_form(h, t, windows=(0,))


def test_plan_has_no_pair_join(spark):
    history, targets = world(9, 50)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    plan = asof.last_n_form(h, t)._jdf.queryExecution().executedPlan().toString()
    assert "Nested" not in plan and "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_windows_are_summed_where_their_matches_are(spark):
    """Rows of matches a target and window would be hundreds of times the input on disk."""
    history, targets = world(8, 40)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    plan = asof.last_n_form(h, t, scopes=("global",))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" not in plan


def test_busy_segments_are_numbered_by_bucket(spark):
    history, targets = world(9, 200, players=2)
    check(spark, history, targets, ("global",), (2, 7), chunk_rows=5, bucket_seconds=600, busy_rows=40)


def test_sums_of_the_whole_history_need_no_chunks(spark):
    """Callers without windows and medians would read every target's chunk for nothing."""
    history, targets = world(11, 120)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    short = asof.last_n_form(h, t, scopes=("global", "h2h"), windows=(), medians=False)
    assert "collect_list" not in short._jdf.queryExecution().executedPlan().toString()
    full = asof.last_n_form(h, t, scopes=("global", "h2h"), windows=())
    key = ["event_id", "cutoff_at", "scope", "side"]
    assert short.orderBy(key).collect() == full.drop("median_total").orderBy(key).collect()


def odd_world(seed, count, players=3):
    """Missing scores and events that come twice."""
    history, _ = world(seed, count, players=players)
    rng = random.Random(seed)
    targets = [(h[0], h[1], *h[3:12]) for h in rng.sample(history, 60)]
    history = [(*h[:12], *((None, None) if rng.random() < 0.2 else h[12:])) for h in history]
    return history + rng.sample(history, 20), targets


@pytest.mark.parametrize("medians", [True, False])
def test_blocks_and_the_tree_give_the_same_rows(spark, medians):
    history, targets = odd_world(21, 260)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)

    def rows(**options):
        form = asof.last_n_form(h, t, scopes=("global", "h2h", "player_team"), windows=(2, 7, 30), medians=medians, **options)
        return sorted(repr([f"{v:.9g}" if isinstance(v, float) else v for v in row]) for row in form.collect())

    blocks = rows(chunk_rows=300)
    assert blocks == rows(busy_rows=0) and blocks == rows(chunk_rows=2)


def test_prompt_results_need_no_tree(spark, monkeypatch):
    """A window that ends at a target's place is the difference of two running sums; few matches under way are taken out."""
    def refuse(*_):
        raise AssertionError("read the tree")

    monkeypatch.setattr(asof, "_tree_sums", refuse)
    start, rng = datetime(2026, 1, 1), random.Random(31)
    history = [
        (eid, start + timedelta(minutes=12 * eid), start + timedelta(minutes=12 * eid + rng.randrange(4, 60)), "football", "a", "g", "t",
         "f", "A", rng.choice("BC"), None, None, rng.randrange(5), rng.randrange(5))
        for eid in range(150)
    ]
    targets = [(h[0], h[1], *h[3:12]) for h in history[::3]]
    check(spark, history, targets, ("global", "h2h"), (2, 9), chunk_rows=12)


def test_rows_of_many_columns_run_compiled_code(spark):
    """The JVM interprets methods of more than 8000 bytes for good."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_baseline_cells_from_sums_are_those_of_the_form(spark):
    """An event gathers three rows of sums, not a row a window."""
    history, targets = odd_world(23, 120)
    h, t = spark.createDataFrame(history, HISTORY), spark.createDataFrame(targets, TARGETS)
    options = {"scopes": baselines.FORM_SCOPES, "windows": (2, 10), "medians": False}
    gathered = baselines.cells_by_event(asof.last_n_sums(h, t, **options), (2, 10))
    listed = baselines.form_by_event(asof.last_n_form(h, t, **options), (2, 10))
    assert gathered.schema["cells"].dataType.simpleString() == listed.schema["cells"].dataType.simpleString()
    assert sorted(map(repr, gathered.collect())) == sorted(map(repr, listed.collect()))


def test_features_need_no_medians(spark, monkeypatch):
    """No feature is a median, and medians of the whole history read the tree."""
    asked = []
    form = asof.last_n_form
    monkeypatch.setattr(asof, "last_n_form", lambda *args, **options: asked.append(options) or form(*args, **options))
    monkeypatch.setattr(learned.bindings, "matches", lambda spark, sf_dir: spark.createDataFrame(history, HISTORY).selectExpr(
        "event_id", "started_at", "available_at", "sport", "source", "game", "tournament_key", "event_id % 3 AS player1", "event_id % 3 + 1 AS player2", "score1", "score2"))
    history, _ = world(24, 40)
    learned.dataset(spark, "")
    assert asked and not any(options.get("medians", True) for options in asked)
