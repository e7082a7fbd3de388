"""Names and event matching against sequential and all-pairs passes."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from oddsloom.functions import text
from oddsloom.operators import identity, matching
from oddsloom.operators.nearest import nearest

T0 = datetime(2026, 1, 1, 12)


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def random_names(seed, count):
    rng = random.Random(seed)
    names = set()
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(count // 3)]
    while len(names) < count:
        letters = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            spot = rng.randrange(len(letters) + 1)
            if letters and rng.random() < 0.5:
                letters[spot - 1] = rng.choice("abcdef")
            else:
                letters.insert(spot, rng.choice("abcde"))
        names.add("".join(letters))
    out = sorted(names)
    rng.shuffle(out)
    return out


def test_folding_variants(spark):
    spellings = ["Pritistret", " PRITISTRET ", "pri​tistret", "Ｐritistret", "Team (Pritistret)"]
    others = ["STRAßE", "a  \t b", "Team ()", "ﬁn"]
    df = spark.createDataFrame([(x,) for x in spellings + others + [None]], "n string")
    got = {r.n: r.normalized for r in text.normalize_names(df, "n", "player").collect()}
    assert {got[x] for x in spellings} == {"pritistret"}
    assert [got[x] for x in others] == ["strasse", "a b", "team ()", "fin"] and got[None] is None
    kept = text.normalize_names(df.where(F.col("n").contains("​")), "n", "source").first()
    assert kept.normalized == "pri​tistret"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_similar_names_meet_over_whole_pieces(spark):
    draw = random.Random(5)
    names = set()
    for _ in range(40):
        name = "".join(draw.choice("ab\u00e9c d") for _ in range(draw.randint(1, 30)))
        names.add(name)
        for _ in range(4):
            near = list(name)
            for _ in range(draw.randint(1, len(name) // 5 + 1)):
                at = draw.randrange(len(near) + 1)
                near[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "b"])
            names.add("".join(near))
    probes, pool = [n for n in names if draw.random() < 0.7], [n for n in names if draw.random() < 0.7]
    want = {(a, b) for a in probes for b in pool if a != b and 1.0 - _edits(a, b) / max(len(a), len(b), 1) >= 0.8}
    frames = [spark.createDataFrame([(n,) for n in side], "name string") for side in (probes, pool)]
    got = [(r.probe, r.candidate) for r in identity.similar_names(*frames, similarity="levenshtein").collect()]
    assert want and sorted(got) == sorted(want)


def test_edit_similar_names_compare_few_of_random_names(spark, monkeypatch):
    """Random hexadecimal names share character pairs with each other, but hardly a piece of four letters."""
    names = spark.range(400).select(F.md5(F.col("id").cast("string").cast("binary")).alias("name"))
    assert identity.similar_names(names, names, similarity="levenshtein").isEmpty()
    # With every pair that meets taken as similar, the pairs compared are counted.
    monkeypatch.setattr(identity.text_fn, "levenshtein_ratio", lambda left, right: F.lit(1.0))
    met = identity.similar_names(names, names, similarity="levenshtein").count()
    assert met < 400 * 399 / 100


def test_similar_names_are_complete(spark):
    names = random_names(1, 240) + ["ab", "axb", "abx", "xab", "ba"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.probe, r.candidate): r.score for r in identity.similar_names(df, df).collect()}
    wanted = {(a, b): ratio(a, b) for a in set(names) for b in set(names) if a != b and ratio(a, b) >= 0.8}
    assert got == wanted
    with pytest.raises(ValueError):
        identity.similar_names(df, df, threshold=0.5)


def sequential(names, entities, auto, review, margin):
    """One name after the other; a new name is a candidate for the next."""
    pool = [(0, eid, name) for eid, name in entities]
    out = {}
    for order, name in enumerate(names):
        exact = [p for p in pool if p[2] == name]
        if exact:
            out[name] = ("exact" if len(exact) == 1 else "review", 1.0)
            continue
        scores = sorted(((ratio(name, p[2]), p) for p in pool), key=lambda s: (-s[0], s[1][0], s[1][1]))
        best = scores[0] if scores else (0.0, None)
        second = scores[1][0] if len(scores) > 1 else 0.0
        second = second if second >= review else 0.0
        if best[0] >= auto and best[0] - second >= margin and len(name) >= 5 and len(best[1][2]) >= 5:
            out[name] = ("fuzzy", best[0])
        elif best[0] >= review:
            out[name] = ("review", best[0])
        else:
            out[name] = ("new", 0.0)
            pool.append((1, order, name))
    return out


def test_decisions_follow_the_sequential_order(spark):
    names = random_names(2, 150)
    entities = [(i, name) for i, name in enumerate(names[:20])] + [(50, names[0])]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, first_seen long")
    known = spark.createDataFrame(entities, "entity_id long, name string")
    got = {
        r.name: (r.action, r.confidence)
        for r in identity.decide(df, known, auto_threshold=0.9, minimum_margin=0.01).collect()
    }
    assert got == sequential(names, entities, 0.9, 0.8, 0.01)


def test_participants_aliases_and_reviews(spark):
    people = spark.createDataFrame(
        [(1, 10, 1, "Team (Alpha One)"), (2, 10, 2, "beta two"), (3, 11, 1, "ALPHA ONE"), (4, 11, 2, "gamma"), (5, 12, 1, "gamna"), (6, 12, 2, "known nick")],
        "participant_id long, event_id long, side int, label string",
    )
    entities = spark.createDataFrame([(7, "beta two")], "entity_id long, name string")
    aliases = spark.createDataFrame([("other", "known nick", 99)], "source string, name string, entity_id long")
    out = identity.resolve_participants(people, entities, column="label", kind="player", source="s", aliases=aliases)
    attached = {r.participant_id: r for r in out["attached"].collect()}
    assert attached[1].action == "new" and attached[1].entity_id == attached[3].entity_id
    assert attached[2].entity_id == 7 and attached[6].entity_id == 99
    assert attached[5].action == "review" and attached[5].entity_id is None
    assert out["reviews"].first().reason == "fuzzy candidate requires review; best=0.8000, second=0.0000"
    assert {r.match_method for r in out["new_aliases"].collect()} == {"new", "exact"}
    events = spark.createDataFrame([(10,), (11,), (12,)], "event_id long")
    sides = {r.event_id: (r.player1, r.player2) for r in identity.events_by_side(events, out["attached"]).collect()}
    assert sides[10] == (attached[1].entity_id, 7) and sides[12] == (None, 99)
    stats = identity.statistics(out["attached"]).first()
    assert (stats.participants_seen, stats.attached, stats.created, stats.reviews) == (6, 5, 2, 1)


def test_alternate_team_names(spark):
    attached = spark.createDataFrame([(1, 5, "Alt One"), (2, 5, "Taken"), (3, 6, "Mine"), (4, None, "No")],
                                     "participant_id long, entity_id long, alt string")
    aliases = spark.createDataFrame([("s", "taken", 8), ("x", "mine", 6)], "source string, name string, entity_id long")
    out = identity.alternate_names(attached, column="alt", aliases=aliases, source="s")
    assert {(r.name, r.entity_id) for r in out["new_aliases"].collect()} == {("alt one", 5), ("mine", 6)}
    assert [(r.name, r.candidate_id) for r in out["reviews"].collect()] == [("taken", 8)]


def clock_distance(a, b):
    return max(60.0, abs((a - b).total_seconds()))


def test_nearest_are_the_two_best(spark):
    rng = random.Random(3)

    def rows(n, first):
        """Dense minutes, equal moments and places on the edges of slots."""
        return [
            (first + i, T0 + timedelta(seconds=rng.choice([rng.randrange(9000), 60 * rng.randrange(150), 1800, 3600, 3605])), rng.choice("aab"))
            for i in range(n)
        ]

    left, right = rows(150, 0), rows(250, 1000)
    s = spark.createDataFrame(left, "source_id long, at timestamp, k string")
    c = spark.createDataFrame(right, "candidate_id long, at timestamp, k string")
    salted = c.withColumn("salt", F.col("candidate_id") % 3), s.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    for found in (nearest(s, c, keys=("k",)), nearest(salted[1], salted[0], keys=("k",), salt="salt")):
        got = {(r.source_id, r.rank): (r.candidate_id, r.gap) for r in found.collect()}
        want = {}
        for sid, at, key in left:
            near = sorted((clock_distance(at, t), cid) for cid, t, k in right if k == key and abs((at - t).total_seconds()) <= 1800)
            want |= {(sid, rank): (cid, gap * 1e6) for rank, (gap, cid) in enumerate(near[:2], 1)}
        assert got == want


def brute(sources, books):
    """Best and second of all events within half an hour."""
    out = {}
    for sid, at, p1, p2, fam, name in sources:
        scored = []
        for bid, bt, q1, q2, bfam, bname in books:
            dt = abs((at - bt).total_seconds())
            if dt > 1800 or None in (p1, p2, q1, q2):
                continue
            t = 1.0 if dt <= 60 else 1 - (dt - 60) / 1200 if dt <= 300 else 0.8 - 0.3 * (dt - 300) / 600 if dt <= 900 else 0.5 * (1800 - dt) / 900
            if fam and bfam:
                tour = float(fam == bfam)
            else:
                tour = ratio(name.lower(), bname.lower()) if name and bname else 0.0
            sides = max((p1 == q1) + (p2 == q2), (p1 == q2) + (p2 == q1))
            scored.append((-(0.25 * sides + 0.2 * tour + 0.2 * t) / 0.9, bid))
        scored.sort(key=lambda pair: (round(pair[0], 12), pair[1]))
        if scored:
            out[sid] = (scored[0][1], round(-scored[0][0], 9), round(-scored[1][0], 9) if len(scored) > 1 else 0.0)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_matching_equals_all_pairs(spark, seed):
    """Busy and rare players, families known and not, names that resemble each other, dense minutes."""
    rng = random.Random(seed)

    def rows(n, first):
        out = []
        for i in range(n):
            pair = rng.choice([("A", "B"), ("B", "A"), ("A", "B"), ("C", "D"), ("A", "E"), (f"X{rng.randrange(60)}", f"Y{rng.randrange(60)}"), ("Q", None)])
            at = T0 + timedelta(seconds=rng.choice([rng.randrange(15000), 60 * rng.randrange(30)]))
            out.append((first + i, at, *pair, rng.choice(["f", "g", None, ""]), rng.choice(["Cup One", "cup two", "League", "", None])))
        return out

    sources, books = rows(150, 0), rows(170, 5000)
    schema = "event_id long, started_at timestamp, player1 string, player2 string, family string, tournament_name string"
    s, b = spark.createDataFrame(sources, schema), spark.createDataFrame(books, schema)
    chosen = matching.choose(matching.candidates(s, b)).collect()
    got = {r.source_id: (r.candidate_id, round(r.confidence, 9), round(r.second_best_confidence, 9)) for r in chosen}
    assert got == brute(sources, books)


def test_match_statuses(spark):
    schema = "event_id long, started_at timestamp, player1 string, player2 string, family string"
    at = lambda m: T0 + timedelta(minutes=m)
    s = spark.createDataFrame([
        (1, at(0), "A", "B", "f"), (2, at(0), "C", "D", "f"), (3, at(0), "E", "F", "f"), (4, at(0), "G", "H", "f"),
        (5, at(500), "A", "B", "f"), (6, at(0), None, "B", "f"), (7, at(0.5), "C", "D", "f"), (8, at(0), "K", "L", "f"),
        (9, at(60), "K", "L", "f"),
    ], schema)
    b = spark.createDataFrame([
        (101, at(0), "B", "A", "f"), (102, at(0), "C", "D", "f"), (103, at(0), "E", "F", "f"), (104, at(1), "E", "F", "f"),
        (105, at(0), "K", "L", "f"), (106, at(100), "V", "W", "f"),
    ], schema)
    old = spark.createDataFrame([(1, 999, "matched"), (88, 105, "matched")], "source_id long, candidate_id long, status string")
    rows = {(r.source_id, r.candidate_id): r for r in matching.match_events(s, b, old).collect()}
    assert rows[1, 101].status == "matched" and rows[1, 101].quality == "exact" and rows[1, 101].components.reversed_sides
    assert rows[1, 999].status == "rejected"
    assert rows[2, 102].status == "ambiguous" and rows[2, 102].collision and rows[7, 102].collision
    assert rows[3, 103].reason == "close_rival"
    # Nobody in common: the neighbour with the smallest id, by tournament and time alone.
    assert rows[4, 101].status == "ambiguous" and rows[4, 101].reason == "low_confidence"
    assert rows[4, 101].components.player1 == 0.0 and rows[4, 101].components.tournament == 1.0
    assert round(rows[4, 101].confidence, 6) == round(0.4 / 0.9, 6) == round(rows[4, 101].second_best_confidence, 6)
    assert rows[9, None].status == "rejected" and rows[9, None].reason == "no_candidate"
    assert not [key for key in rows if key[0] == 5]
    assert rows[8, 105].already_matched and rows[8, 105].status == "ambiguous"
    assert rows[6, None].status == "unresolved"
    counts = matching.statistics(matching.match_events(s, b, old)).first()
    assert counts.asDict() == {
        "source_events_seen": 8, "automatic_matches": 1, "ambiguous_matches": 5, "rejected_without_candidate": 1,
        "unresolved_source_events": 1, "preserved_matches": 0,
    }
    frozen = {(r.source_id, r.status) for r in matching.match_events(s, b, old, freeze_matched=True).collect()}
    assert (1, "preserved") in frozen and (1, "matched") not in frozen
    later = s.where("event_id = 5")
    idle = matching.match_events(later, b, old).collect()
    assert [(r.source_id, r.candidate_id, r.status, r.reason) for r in idle] == [(88, 105, "rejected", "no_source")]


def test_one_match_each(spark):
    rows = [(1, 10, 20, 0.95, "matched", T0), (2, 10, 21, 0.99, "matched", T0), (3, 11, 21, 0.97, "matched", T0), (4, 12, 20, 0.5, "rejected", T0)]
    df = spark.createDataFrame(rows, "match_id long, source_id long, candidate_id long, confidence double, status string, matched_at timestamp")
    got = {r.match_id: r.status for r in matching.one_match_each(df).collect()}
    assert got == {1: "ambiguous", 2: "matched", 3: "ambiguous", 4: "rejected"}


def test_live_and_completed_modes(spark):
    events = spark.createDataFrame([(1, T0, "scheduled"), (2, T0 + timedelta(hours=2), "scheduled"), (3, T0 + timedelta(hours=2), "live")],
                                   "event_id long, started_at timestamp, status string")
    quotes = spark.createDataFrame([(1, T0 - timedelta(minutes=1)), (2, T0)], "event_id long, received_at timestamp")
    now = F.lit(T0 + timedelta(hours=1))
    assert [r.event_id for r in matching.live_only(events, now).collect()] == [2]
    assert [r.event_id for r in matching.completed_only(events, quotes, now).collect()] == [1]


def test_joins_of_events_send_no_side_whole(spark):
    """Files of repeated values are small beside their rows; a side sent whole would be built in the driver's memory."""
    schema = "event_id long, started_at timestamp, player1 long, player2 long"
    s = spark.createDataFrame([(i, T0 + timedelta(minutes=i), i % 5, i % 3) for i in range(40)], schema)
    b = spark.createDataFrame([(100 + i, T0 + timedelta(minutes=i), i % 5, i % 3) for i in range(40)], schema)
    for frame in (matching.candidates(s, b), matching.match_events(s, b)):
        plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
        # Names of tournaments that meet are distinct pairs, and may be sent.
        assert [line for line in plan if "BroadcastHashJoin" in line and "s_name" not in line] == []


def test_nearest_sends_its_rows_once(spark):
    """Four row sets of their own were most of the disk that matching took."""
    one = spark.createDataFrame([(1, datetime(2026, 1, 1), "x")], "source_id long, at timestamp, k string")
    found = nearest(one, one.withColumnRenamed("source_id", "candidate_id"), keys=("k",))
    assert [tuple(r) for r in found.collect()] == [(1, "x", 1, 60_000_000, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 3
