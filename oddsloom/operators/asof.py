"""Point-in-time features: last-N form, head-to-head, sessions and streaks.

A target is (event, cutoff). It sees matches of the same sport with
``started_at < cutoff`` and ``available_at < cutoff``, never itself, newest
first by (started_at, event_id).

Every scope is the same problem under another key: history and targets are
keyed by a *segment* (scope, sport and the columns the scope compares). Most
segments are sorted twice by one task. In order of knowledge running sums and a
running median give the whole history. In order of starts a window ends at the
target's place: its sums are differences of two running sums, its median comes
from a slice of the totals. For that a segment is cut into blocks of matches; a
target reads its block and the one before. Of matches that have started but are
not known yet, up to ``chunk_rows`` are taken out of the blocks one by one.

Targets of busy segments, with more matches under way or with a match of their
own event to be left out, read a tree: a result is known no earlier than its
match starts, so what a target sees is a prefix of its segment in order of
knowledge, whatever came late. Rows are numbered in that order (numbers within
a time bucket plus those of the buckets before it), and each ``chunk_rows`` of
them make a chunk. Chunks are leaves of a tree of fanout ``FANOUT``; a node
keeps its newest matches by start, as many as the largest window asks for, and
counts per score total. A target reads the chunk it ends in, cut at its number,
and the few nodes that cover the chunks before. Windows follow from the newest
matches of all, sums and median of the whole history from the counts per total.
A player with a third of all matches has more chunks, and no task holds more
than a segment of ``busy_rows``, a chunk, a bucket or the newest rows of a node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.session import materialize

WINDOWS = (5, 10, 20, 25, 30, 50, 75, 100, 200)
PLAYER_SCOPES = ("global", "source", "game", "tournament", "format", "player_team")
PAIR_SCOPES = ("h2h", "h2h_same_direction", "player_team_h2h")
SCOPES = PLAYER_SCOPES + PAIR_SCOPES
LINES = (1.5, 2.5, 3.5, 4.5, 5.5, 6.5)
CHUNK_ROWS = 64
BUCKET_SECONDS = 86_400
#: Segments of more rows are numbered bucket by bucket.
BUSY_ROWS = 50_000
FANOUT = 4
HISTORY, TARGET = 0, 1
_SCOPE_COLUMN = {
    "source": "source", "game": "game", "tournament": "tournament_key", "format": "format",
}
_KEY = ("event_id", "at_us", "tag")
_LINE_NAMES = [str(line).replace(".", "_") for line in LINES]


def _part(column: Column) -> Column:
    """Unambiguous text of one key part; null has its own spelling."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("~")).otherwise(
        F.concat(F.length(text).cast("string"), F.lit(":"), text)
    )


def _segment(scope: str, *parts: Column) -> Column:
    return F.concat(F.lit(scope + "|"), *[_part(part) for part in parts])


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _struct(seg: Column, gf: Column, ga: Column, tag: int = 0) -> Column:
    return F.struct(
        seg.alias("seg"), gf.cast("int").alias("gf"), ga.cast("int").alias("ga"),
        F.lit(tag).alias("tag"),
    )


def _with_optional(df: DataFrame) -> DataFrame:
    wanted = ("source", "game", "tournament_key", "format", "team1", "team2")
    missing = {name: F.lit(None).cast("string") for name in wanted if name not in df.columns}
    return df.withColumns(missing) if missing else df


def history_segments(history: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """One row per (match, segment it counts in), scores seen from that segment."""
    h = _with_optional(history)
    sport, p1, p2 = F.col("sport"), F.col("player1"), F.col("player2")
    s1, s2 = F.col("score1"), F.col("score2")
    mirror = p1 == p2
    entries: list[Column] = []

    def add(seg: Column, gf: Column, ga: Column, when: Column | None = None) -> None:
        entry = _struct(seg, gf, ga)
        entries.append(entry if when is None else F.when(when, entry))

    for scope in scopes:
        if scope == "global":
            add(_segment(scope, sport, p1), s1, s2)
            add(_segment(scope, sport, p2), s2, s1, ~mirror)
        elif scope in _SCOPE_COLUMN:
            extra = F.col(_SCOPE_COLUMN[scope])
            add(_segment(scope, sport, p1, extra), s1, s2)
            add(_segment(scope, sport, p2, extra), s2, s1, ~mirror)
        elif scope == "player_team":
            t1, t2 = F.col("team1"), F.col("team2")
            add(_segment(scope, sport, p1, t1), s1, s2, t1.isNotNull())
            add(_segment(scope, sport, p2, t2), s2, s1, ~mirror & t2.isNotNull())
            add(
                _segment(scope, sport, p1, t2), s1, s2,
                mirror & t2.isNotNull() & ~t1.eqNullSafe(t2),
            )
        elif scope == "h2h":
            add(_segment(scope, sport, p1, p2), s1, s2)
            add(_segment(scope, sport, p2, p1), s2, s1, ~mirror)
        elif scope == "h2h_same_direction":
            add(_segment(scope, sport, p1, p2), s1, s2)
        elif scope == "player_team_h2h":
            t1, t2 = F.col("team1"), F.col("team2")
            both = t1.isNotNull() & t2.isNotNull()
            add(_segment(scope, sport, p1, t1, p2, t2), s1, s2, both)
            add(
                _segment(scope, sport, p2, t2, p1, t1), *_mirrored(mirror, s1, s2),
                both & ~(mirror & (t1 == t2)),
            )
        else:
            raise ValueError(f"unknown scope {scope}")
    started = _micros("started_at")
    ready = F.greatest(started, _micros("available_at"))
    keyed = h.where(
        p1.isNotNull() & p2.isNotNull() & F.col("started_at").isNotNull()
        & F.col("available_at").isNotNull()
    ).select(
        F.col("event_id").cast("long").alias("event_id"),
        started.alias("at_us"),
        ready.alias("ready_us"),
        F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"),
    )
    return keyed.select(
        "e.seg", F.lit(HISTORY).alias("kind"), "at_us", "ready_us", "event_id",
        "e.gf", "e.ga", F.lit(0).alias("tag"),
    )


def _mirrored(mirror: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Scores of the reversed pair; a self-pairing keeps the first side's view."""
    return F.when(mirror, s1).otherwise(s2), F.when(mirror, s2).otherwise(s1)


def target_segments(targets: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """One row per (target, scope, side); pair scopes have side 0."""
    t = _with_optional(targets)
    sport = F.col("sport")
    sides = {1: (F.col("player1"), F.col("team1")), 2: (F.col("player2"), F.col("team2"))}
    p1, p2 = F.col("player1"), F.col("player2")
    t1, t2 = F.col("team1"), F.col("team2")
    zero = F.lit(0)
    entries = []
    for scope in scopes:
        code = SCOPES.index(scope) * 4
        if scope in PLAYER_SCOPES:
            for side, (player, team) in sides.items():
                if scope == "global":
                    seg = _segment(scope, sport, player)
                elif scope == "player_team":
                    seg = F.when(team.isNotNull(), _segment(scope, sport, player, team))
                else:
                    seg = _segment(scope, sport, player, F.col(_SCOPE_COLUMN[scope]))
                entries.append(F.when(seg.isNotNull(), _struct(seg, zero, zero, code + side)))
        else:
            seg = _segment(scope, sport, p1, p2)
            if scope == "player_team_h2h":
                both = t1.isNotNull() & t2.isNotNull()
                seg = F.when(both, _segment(scope, sport, p1, t1, p2, t2))
            entries.append(F.when(seg.isNotNull(), _struct(seg, zero, zero, code)))
    keyed = t.where(p1.isNotNull() & p2.isNotNull() & F.col("cutoff_at").isNotNull()).select(
        F.col("event_id").cast("long").alias("event_id"),
        _micros("cutoff_at").alias("at_us"),
        F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"),
    )
    return keyed.select(
        "e.seg", F.lit(TARGET).alias("kind"), "at_us", F.lit(None).cast("long").alias("ready_us"),
        "event_id", "e.gf", "e.ga", "e.tag",
    )


def _segment_rows(history: DataFrame, targets: DataFrame, scopes: Sequence[str], several: DataFrame) -> DataFrame:
    """Rows of all segments; matches are spread before each becomes a row a scope and side, however few files hold them.

    ``own`` tells targets whose event is one of ``several``.
    """
    looking = target_segments(targets.dropDuplicates(["event_id", "cutoff_at"]), scopes)
    marked = looking.join(several.withColumn("own", F.lit(True)), "event_id", "left").select(
        *looking.columns, F.coalesce("own", F.lit(False)).alias("own")
    )
    return history_segments(history.repartition("event_id"), scopes).withColumn("own", F.lit(False)).unionByName(marked)


def _numbered(rows: DataFrame, bucket_seconds: int, busy_rows: int) -> DataFrame:
    """``n``: how many matches of the segment were known before this row's moment, and their other sums.

    ``n`` is a match's number in order of knowledge, from 0, and for a target
    the length of the prefix that it sees. Only segments of more than
    ``busy_rows`` rows are cut into time buckets.
    """
    width = bucket_seconds * 1_000_000
    busy = rows.groupBy("seg").agg(F.count("*").alias("rows")).where(F.col("rows") > busy_rows).select("seg", F.lit(True).alias("busy"))
    timed = rows.join(busy, "seg", "left").withColumn(
        "moment", F.when(F.col("kind") == HISTORY, F.col("ready_us")).otherwise(F.col("at_us"))
    )
    timed = timed.withColumn("bucket", F.when(F.col("busy"), F.expr(f"(moment - pmod(moment, {width})) div {width}")).otherwise(0))
    zero = F.lit(0).cast("long")
    values = [F.when(F.col("kind") == HISTORY, value).otherwise(zero) for value in _values(F.col("gf"), F.col("ga"))]
    timed = timed.withColumns({f"v_{name}": value for name, value in zip(_SUMS, values)})
    earlier = Window.partitionBy("seg").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = timed.where("busy").groupBy("seg", "bucket").agg(*[F.sum(f"v_{name}").alias(f"b_{name}") for name in _SUMS])
    offsets = sums.select("seg", "bucket", *[F.coalesce(F.sum(f"b_{name}").over(earlier), zero).alias(f"b_{name}") for name in _SUMS])
    inside = (
        Window.partitionBy("seg", "bucket")
        .orderBy("moment", F.desc("kind"), "at_us", "event_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = timed.withColumns({f"w_{name}": F.coalesce(F.sum(f"v_{name}").over(inside), zero) for name in _SUMS})
    return within.join(offsets, ["seg", "bucket"], "left").select(
        *rows.columns, *[(F.coalesce(F.col(f"b_{name}"), zero) + F.col(f"w_{name}")).alias(name) for name in _SUMS]
    )


def _newest(rows: DataFrame, keys: Sequence[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("at_us"), F.desc("event_id"))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= keep).drop("_rank")


def _at_level(number: str, level: str) -> Column:
    """The node of a chunk at a level, which is a column too."""
    return F.floor(F.col(number) / F.pow(F.lit(float(FANOUT)), F.col(level))).cast("long")


_MATCH = "struct<at_us:long,event_id:long,known:long,total:int,f:long,p1:long,p2:long,p3:long>"
_CELL = "struct<total:int,n:long>"
_SUMS = ("n", "w", "d", "f", "t", "tt", *[f"o{i}" for i in range(len(LINES))])


def _values(gf: Column, ga: Column) -> list[Column]:
    """What a match adds to each sum."""
    total = (gf + ga).cast("long")
    values = [F.lit(1), F.when(gf > ga, 1).otherwise(0), F.when(gf == ga, 1).otherwise(0), gf, total, total * total]
    values += [F.when(total > line, 1).otherwise(0) for line in LINES]
    return [value.cast("long").alias(name) for name, value in zip(_SUMS, values, strict=True)]


#: Sums of a window; counts are added twenty bits apart, three to a number.
_WORDS = ("p1", "p2", "p3")
_PARTS = (*_WORDS, "f", "t", "tt")
_BITS = 20


def _packed(gf: Column, ga: Column) -> list[Column]:
    """Win, draw and the lines that a match is over, as numbers that can be added."""
    total = gf + ga
    marks, words = [gf > ga, gf == ga, *[total > line for line in LINES]], []
    for name, begin in zip(_WORDS, range(0, len(marks), 3), strict=True):
        word = F.lit(0).cast("long")
        for place, mark in enumerate(marks[begin : begin + 3]):
            word = word + F.when(mark, 1 << (_BITS * place)).otherwise(0).cast("long")
        words.append(word.alias(name))
    return words


def _unpacked(words: Sequence[Column]) -> dict[str, Column]:
    names, mask = ["w", "d", *[f"o{i}" for i in range(len(LINES))]], F.lit((1 << _BITS) - 1).cast("long")
    return {name: F.shiftrightunsigned(words[i // 3], _BITS * (i % 3)).bitwiseAND(mask) for i, name in enumerate(names)}


def _contexts(past: DataFrame, wanted: DataFrame, keep: int, medians: bool) -> DataFrame:
    """Per wanted (seg, chunk): its matches, the newest ``keep`` before it and, for medians, counts per total before it."""
    fields = ["at_us", "event_id", "known", "total", "f", *_WORDS]
    last = wanted.groupBy("seg").agg(F.max("chunk").alias("last"))
    # A node is read by chunks after it only, so levels end where one node holds all.
    levels = F.ceil(F.log(float(FANOUT), F.col("last") + 1)).cast("int")
    spread = past.join(last.where("last > 0").withColumn("levels", levels), "seg").where("chunk < last")
    nodes = spread.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1))).withColumn(
        "node", _at_level("chunk", "level")
    )
    tops = _newest(nodes, ["seg", "level", "node"], keep).select("seg", "level", "node", *fields)
    cells = nodes.groupBy("seg", "level", "node", "total").agg(F.count("*").alias("n"))

    # Chunks 0 to b - 1 are, at each level, the elder siblings of b's own node there.
    reading = wanted.where("chunk > 0").join(last.withColumn("levels", levels), "seg").withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1))
    ).withColumn("own", _at_level("chunk", "level"))
    reading = reading.where(F.col("own") % FANOUT > 0).select(
        "seg", "chunk", "level",
        F.explode(F.sequence(F.col("own") - F.col("own") % FANOUT, F.col("own") - 1)).alias("node"),
    )
    carried = _newest(reading.join(tops, ["seg", "level", "node"]), ["seg", "chunk"], keep)
    counted = reading.join(cells, ["seg", "level", "node"]).groupBy("seg", "chunk", "total").agg(F.sum("n").alias("n"))
    match = F.struct(*fields)
    here = past.join(wanted, ["seg", "chunk"], "left_semi").unionByName(
        carried.select("seg", "chunk", *fields), allowMissingColumns=True
    )
    parts = here.select("seg", "chunk", match.alias("match"), F.lit(None).cast(_CELL).alias("cell"))
    if medians:
        parts = parts.unionByName(
            counted.select("seg", "chunk", F.lit(None).cast(_MATCH).alias("match"), F.struct("total", "n").alias("cell"))
        )
    return parts.groupBy("seg", "chunk").agg(
        F.sort_array(F.collect_list("match"), asc=False).alias("matches"), F.collect_list("cell").alias("cells")
    )


def _middle(values: Column, n: Column) -> Column:
    """Median of sorted values, 0 without any."""
    low, high = (F.get(values, F.floor(place / 2).cast("int")) for place in (n - 1, n))
    return F.coalesce((low + high) / 2.0, F.lit(0.0))


def _median_of_counts(cells: Column, n: Column) -> Column:
    """Median of ``n`` values given as (total, n), sorted; a count below zero takes one back."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))

    def step(state, c):
        seen = state.seen + c.n
        return F.struct(
            seen.alias("seen"),
            F.when(state.low.isNull() & (2 * seen > n - 1), c.total).otherwise(state.low).alias("low"),
            F.when(state.high.isNull() & (2 * seen > n), c.total).otherwise(state.high).alias("high"),
        )

    return F.coalesce(F.aggregate(cells, start, step, lambda state: (state.low + state.high) / 2.0), F.lit(0.0))


def _scope_columns() -> list[Column]:
    names = F.array(*[F.lit(name) for name in SCOPES])
    scope = F.element_at(names, (F.floor(F.col("tag") / 4) + 1).cast("int"))
    return [scope.alias("scope"), (F.col("tag") % 4).alias("side")]


def _several(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Events that are several in the history or known before a target of theirs; most inputs have none."""
    mine = F.col("event_id").cast("long").alias("event_id")
    none = F.lit(None).cast("long")
    ready = F.greatest(_micros("started_at"), _micros("available_at"))
    rows = history.select(mine, F.lit(1).alias("copies"), ready.alias("ready_us"), none.alias("at_us")).unionByName(
        targets.select(mine, F.lit(0).alias("copies"), none.alias("ready_us"), _micros("cutoff_at").alias("at_us"))
    )
    counted = rows.groupBy("event_id").agg(F.sum("copies").alias("copies"), F.min("ready_us").alias("known"), F.max("at_us").alias("last"))
    found = counted.where("event_id IS NOT NULL AND (copies > 1 OR known < last)").select("event_id")
    return materialize(found, "form-own")


def _own_matches(past: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of ``past`` that a target of the same event may see."""
    copies = Window.partitionBy("seg", "event_id")
    rows = past.join(several, "event_id", "left_semi").select("seg", "event_id", F.struct("known", "gf", "ga").alias("own"))
    counted = rows.withColumns(
        {"copy": F.row_number().over(copies.orderBy("own.known")), "copies": F.count("*").over(copies)}
    )
    return materialize(counted, "form-own-rows")


def _whole(medians: bool) -> list[Column]:
    return [F.lit(0).alias("last_n"), *[F.col(name) for name in _SUMS], *([F.col("median")] if medians else [])]


def _window(size: int, within: Column, sums: Column, copies: Column, median: Column | None) -> Column:
    """The entry of one window from its packed sums."""
    marks = {**_unpacked([sums[name] for name in _WORDS]), **{name: sums[name] for name in ("f", "t", "tt")}}
    return F.struct(
        F.lit(size).alias("last_n"), within.cast("long").alias("n"),
        *[(marks[name] * copies).alias(name) for name in _SUMS[1:]], *([median.alias("median")] if median is not None else []),
    )


def _added(sums, gf: Column, ga: Column):
    """Packed sums with one match more."""
    zero = F.lit(0).cast("long")
    f, t = F.coalesce(gf.cast("long"), zero), F.coalesce(gf + ga, F.lit(0)).cast("long")
    values = dict(zip(_WORDS, _packed(gf, ga))) | {"f": f, "t": t, "tt": t * t}
    return F.struct(*[(sums[name] + values[name]).alias(name) for name in _PARTS])


def _tree_sums(numbered: DataFrame, several: DataFrame, sizes: Sequence[int], chunk_rows: int, medians: bool) -> DataFrame:
    """Entries of each target of ``numbered``: of the whole history and of each window."""
    largest = max(sizes, default=0)
    zero, total = F.lit(0).cast("long"), F.col("gf") + F.col("ga")
    past = numbered.where(F.col("kind") == HISTORY).withColumnRenamed("n", "known").withColumns(
        {"chunk": F.expr(f"known div {chunk_rows}"), "total": total, "f": F.coalesce(F.col("gf").cast("long"), zero)}
        | dict(zip(_WORDS, _packed(F.col("gf"), F.col("ga"))))
    )
    looking = numbered.where(F.col("kind") == TARGET).withColumn("chunk", F.expr(f"n div {chunk_rows}"))
    own = _own_matches(past, several)
    seen = looking.join(own, ["seg", "event_id"], "left")
    inside = F.coalesce(F.col("own.known") < F.col("n"), F.lit(False))
    taken = _values(F.col("own.gf"), F.col("own.ga"))
    eligible = F.filter("matches", lambda r: (r.known < F.col("until")) & (r.event_id != F.col("event_id")))
    first = F.col("chunk") * chunk_rows
    no_cells = F.array().cast(f"array<{_CELL}>")
    undone = F.struct((F.col("own.gf") + F.col("own.ga")).alias("total"), F.lit(-1).cast("long").alias("n"))
    seen = seen.withColumns(
        {name: F.col(name) - F.when(inside, value).otherwise(0) for name, value in zip(_SUMS, taken)} | {"until": F.col("n")}
    )
    if not sizes and not medians:
        return seen.select(*_KEY, F.array(F.struct(*_whole(medians))).alias("entries"))
    # One row more than the largest window, since the target's own match may be among them.
    contexts = _contexts(past, looking.select("seg", "chunk").distinct(), largest + 1, medians)
    base = seen.join(contexts, ["seg", "chunk"], "left").select(
        *_KEY, *_SUMS,
        F.coalesce(eligible, F.array().cast(f"array<{_MATCH}>")).alias("seen"), first.alias("first"),
        F.concat(F.coalesce("cells", no_cells), F.when(F.col("own.known") < first, F.array(undone)).otherwise(no_cells)).alias("cells"),
        F.coalesce("copy", F.lit(1)).alias("copy"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )
    counted = F.concat(
        "cells", F.transform(F.filter("seen", lambda r: r.known >= F.col("first")), lambda r: F.struct(r.total.alias("total"), F.lit(1).cast("long").alias("n")))
    )
    row = base.select(*_KEY, *_SUMS, "copy", "copies", "seen", *([F.sort_array(counted).alias("counted")] if medians else []))
    if medians:
        row = row.withColumn("median", _median_of_counts(F.col("counted"), F.col("n")))
    entries = F.array(F.struct(*_whole(medians)))
    if sizes:
        totals = {"totals": F.transform(F.slice("seen", 1, largest), lambda r: F.coalesce(r.total, F.lit(0)))} if medians else {}
        row = row.withColumns(totals | {"sums0": F.struct(*[zero.alias(name) for name in _PARTS])})

        def added(sums, m):
            t = F.coalesce(m.total, F.lit(0)).cast("long")
            values = {name: m[name] for name in (*_WORDS, "f")} | {"t": t, "tt": t * t}
            return F.struct(*[(sums[name] + values[name]).alias(name) for name in _PARTS])

        windowed = []
        for before, size in zip((0, *sizes), sizes):
            # A window goes on where the next smaller one ends; without nulls a sort is one of plain numbers.
            grown = {f"sums{size}": F.aggregate(F.slice("seen", before + 1, size - before), F.col(f"sums{before}"), added)}
            row = row.withColumns(grown | ({f"sorted{size}": F.sort_array(F.slice("totals", 1, size))} if medians else {}))
            within = F.least(F.size("seen"), F.lit(size))
            median = _middle(F.col(f"sorted{size}"), within) if medians else None
            windowed.append(_window(size, within, F.col(f"sums{size}"), F.col("copies"), median))
        entries = F.when(F.col("copy") == 1, F.concat(entries, F.array(*windowed))).otherwise(entries)
    return row.select(*_KEY, entries.alias("entries"))


_NULL_TOTAL = -1e18


def _blocks(rows: DataFrame, sizes: Sequence[int], chunk_rows: int, medians: bool) -> DataFrame:
    """(seg, block): its matches and those of the block before by start, the targets that they answer and ``hard`` ones.

    Blocks hold as many matches as the largest window and ``chunk_rows`` more,
    so a target finds its windows there unless more than that many matches
    before its cutoff are not known yet.
    """
    block_rows = max(sizes) + chunk_rows
    history, zero, total = F.col("kind") == HISTORY, F.lit(0).cast("long"), F.col("gf") + F.col("ga")

    def running(window, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(history, value)).over(window), zero)

    moment = F.when(history, F.col("ready_us")).otherwise(F.col("at_us"))
    known = Window.partitionBy("seg").orderBy("moment", F.desc("kind"), "at_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.repartition("seg").withColumn("moment", moment)
    numbers = {name: running(known, value) for name, value in zip(_SUMS, _values(F.col("gf"), F.col("ga")))}
    if medians:
        # Matches without a score sort before all others; where the middle is one of them, the lowest total stands for it.
        value = F.when(history, F.coalesce(total.cast("double"), F.lit(_NULL_TOTAL)))
        numbers |= {"_middle": F.percentile(value, 0.5).over(known), "_least": F.min(F.when(history, total)).over(known)}
    ranked = ranked.withColumns(numbers)
    if medians:
        lowest = F.col("_least").cast("double")
        middle = F.when(F.col("_middle") > _NULL_TOTAL / 4, F.col("_middle")).otherwise(lowest)
        ranked = ranked.withColumn("median", F.coalesce(middle, F.lit(0.0))).drop("_middle", "_least")
    started = Window.partitionBy("seg").orderBy("at_us", F.desc("kind"), "event_id", "n")
    before = started.rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(total, F.lit(0)).cast("long")
    adds = dict(zip(_WORDS, _packed(F.col("gf"), F.col("ga")))) | {"f": F.coalesce(F.col("gf").cast("long"), zero), "t": t, "tt": t * t}
    placed = ranked.withColumns(
        {"place": F.coalesce(F.count(F.when(history, 1)).over(before), zero)}
        | {f"z_{name}": running(before, value) for name, value in adds.items()}
        | {"all": F.count(F.when(history, 1)).over(started.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    )
    placed = placed.withColumn("block", F.expr(f"CASE WHEN kind = {HISTORY} THEN place ELSE greatest(place - 1, 0) END div {block_rows}"))
    far = (F.col("place") - F.col("n") > chunk_rows) & (F.col("block") > 0)
    sums = F.struct(*[F.col(f"z_{name}").alias(name) for name in _PARTS])
    match = F.struct(
        F.col("place").cast("long").alias("place"), "at_us", "event_id", F.col("n").alias("known"), "ready_us", "gf", "ga",
        F.coalesce(total, F.lit(0)).alias("total"), sums.alias("z"),
    )
    answer = ["event_id", "at_us", "tag", *_SUMS, *(["median"] if medians else [])]
    asked = F.struct("place", *answer, sums.alias("z"))
    # A match is read from its own block and from the next one.
    both = F.array(F.col("block"), F.col("block") + 1)
    blocks = F.when(history & (F.col("all") > (F.col("block") + 1) * block_rows), both).otherwise(F.array("block"))
    spread = placed.select(
        "seg", F.explode(blocks).alias("block"), F.when(history, match).alias("match"),
        F.when(~history & ~(F.col("own") | far), asked).alias("asked"),
        F.when(~history & (F.col("own") | far), F.struct(*answer)).alias("hard"),
    )
    return spread.groupBy("seg", "block").agg(
        F.sort_array(F.collect_list("match")).alias("matches"), F.collect_list("asked").alias("asked"), F.collect_list("hard").alias("hard"),
    )


def _block_sums(blocks: DataFrame, sizes: Sequence[int], medians: bool) -> DataFrame:
    """Entries of each target that its block answers."""
    largest, zero = max(sizes), F.lit(0).cast("long")

    def score(match) -> Column:
        """What files hold may be null to Spark, and it sorts such numbers as objects."""
        return F.coalesce(match.total, F.lit(0))

    asked = blocks.where(F.size("asked") > 0).select(
        "matches", F.transform("matches", score).alias("totals"), F.coalesce(F.get("matches", F.lit(0))["place"], zero).alias("first"),
        F.explode("asked").alias("t"),
    )
    length = (F.col("t.place") - F.col("first")).cast("int")
    waiting = F.col("t.place") > F.col("t.n")

    def ending(values: Column | str, size: Column, count: int) -> Column:
        """The last ``count`` of the first ``size`` values."""
        skipped = F.greatest(size - count, F.lit(0))
        return F.slice(values, skipped + 1, size - skipped)

    known = F.filter(F.slice("matches", F.lit(1), length), lambda r: r.known < F.col("t.n"))
    row = asked.withColumn("known", F.when(waiting, known))
    place, quick = F.col("t.place"), {}
    for size in sizes:
        start = F.get("matches", length - size)["z"]
        quick[f"quick{size}"] = F.when(~waiting, F.struct(
            *[(F.col(f"t.z.{name}") - F.when(place > size, start[name]).otherwise(zero)).alias(name) for name in _PARTS]
        ))
    late = ending("known", F.size("known"), largest)
    row = row.select(
        *[F.col(f"t.{name}").alias(name) for name in (*_KEY, *_SUMS, *(["median"] if medians else []))],
        *[value.alias(name) for name, value in quick.items()],
        F.when(waiting, F.reverse(late)).alias("late"),
        *([F.when(waiting, F.transform(late, score)).otherwise(ending("totals", length, largest)).alias("totals")] if medians else []),
        F.struct(*[zero.alias(name) for name in _PARTS]).alias("sums0"),
    )
    entries = [F.struct(*_whole(medians))]
    for before, size in zip((0, *sizes), sizes):
        grown = F.aggregate(F.slice("late", before + 1, size - before), F.col(f"sums{before}"), lambda sums, m: _added(sums, m.gf, m.ga))
        columns = {f"sums{size}": F.when(F.col("late").isNull(), F.col(f"quick{size}")).otherwise(grown)}
        if medians:
            columns[f"sorted{size}"] = F.sort_array(ending("totals", F.size("totals"), size))
        row = row.withColumns(columns)
        within = F.least(F.col("n"), F.lit(size))
        median = _middle(F.col(f"sorted{size}"), within) if medians else None
        entries.append(_window(size, within, F.col(f"sums{size}"), F.lit(1).cast("long"), median))
    return row.select(*_KEY, F.array(*entries).alias("entries"))


def last_n_sums(
    history: DataFrame,
    targets: DataFrame,
    *,
    scopes: Sequence[str] = SCOPES,
    windows: Sequence[int] = WINDOWS,
    chunk_rows: int = CHUNK_ROWS,
    bucket_seconds: int = BUCKET_SECONDS,
    busy_rows: int = BUSY_ROWS,
    medians: bool = True,
) -> DataFrame:
    """What :func:`last_n_form` is computed from: a row per target and segment with an entry for each window."""
    if any(size <= 0 for size in windows):
        raise ValueError("a window holds one match or more")
    sizes = sorted(set(windows))
    if max(sizes, default=0) >= 1 << _BITS or busy_rows >= 1 << _BITS:
        raise ValueError(f"windows and busy_rows must be below {1 << _BITS}")
    several = _several(history, targets)
    rows = _segment_rows(history, targets, scopes, several)
    plain = [name for name in rows.columns if name != "own"]
    if not sizes:
        numbered = materialize(_numbered(rows.select(*plain), bucket_seconds, busy_rows), "form-rows")
        return _tree_sums(numbered, several, sizes, chunk_rows, medians)
    crowd = rows.groupBy("seg").agg(F.count("*").alias("rows")).where(F.col("rows") > busy_rows).select("seg")
    busy = F.broadcast(materialize(crowd, "form-busy"))
    blocks = materialize(_blocks(rows.join(busy, "seg", "left_anti"), sizes, chunk_rows, medians), "form-blocks")
    found = _block_sums(blocks, sizes, medians)
    parts = []
    if not busy.isEmpty():
        parts.append(_numbered(rows.join(busy, "seg", "left_semi").select(*plain), bucket_seconds, busy_rows))
    hard = blocks.where(F.size("hard") > 0)
    if not hard.isEmpty():
        parts.append(_hard_rows(blocks, hard.select("seg", "hard"), max(sizes) + chunk_rows))
    if parts:
        numbered = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        found = found.unionByName(_tree_sums(materialize(numbered, "form-rows"), several, sizes, chunk_rows, medians))
    return found


def scoped_sums(sums: DataFrame) -> DataFrame:
    """Rows of :func:`last_n_sums` with the columns that a form has."""
    return sums.select("event_id", F.timestamp_micros("at_us").alias("cutoff_at"), *_scope_columns(), "entries")


def _hard_rows(blocks: DataFrame, hard: DataFrame, block_rows: int) -> DataFrame:
    """Numbered rows, as of ``_numbered``, of the targets that blocks do not answer and of their segments' matches."""
    none = F.lit(None).cast("long")
    asked = hard.select("seg", F.explode("hard").alias("t")).select(
        "seg", F.lit(TARGET).alias("kind"), "t.at_us", none.alias("ready_us"), "t.event_id", F.lit(0).alias("gf"), F.lit(0).alias("ga"),
        "t.tag", *[F.col(f"t.{name}") for name in _SUMS],
    )
    past = blocks.join(hard.select("seg").distinct(), "seg", "left_semi").select("seg", "block", F.explode("matches").alias("m"))
    past = past.where(F.expr(f"m.place div {block_rows}") == F.col("block")).select(
        "seg", F.lit(HISTORY).alias("kind"), "m.at_us", "m.ready_us", "m.event_id", "m.gf", "m.ga", F.lit(0).alias("tag"),
        F.col("m.known").alias("n"), *[none.alias(name) for name in _SUMS[1:]],
    )
    return past.unionByName(asked)


def last_n_form(
    history: DataFrame,
    targets: DataFrame,
    *,
    scopes: Sequence[str] = SCOPES,
    windows: Sequence[int] = WINDOWS,
    chunk_rows: int = CHUNK_ROWS,
    bucket_seconds: int = BUCKET_SECONDS,
    busy_rows: int = BUSY_ROWS,
    medians: bool = True,
) -> DataFrame:
    """Form aggregates per (event, cutoff, scope, side, window).

    ``history``: event_id, started_at, available_at, sport, player1, player2,
    score1, score2 and, for the scopes that use them, source, game,
    tournament_key, format, team1, team2. ``targets``: the same identity
    columns and cutoff_at. ``last_n`` is 0 for the whole history. Without
    ``medians`` the column median_total is left out; without windows too no
    chunk is read, since the rest follows from the sums of the numbering.
    """
    found = last_n_sums(
        history, targets, scopes=scopes, windows=windows, chunk_rows=chunk_rows, bucket_seconds=bucket_seconds,
        busy_rows=busy_rows, medians=medians,
    )
    return _measures(found.select(*_KEY, F.explode_outer("entries").alias("r")).select(*_KEY, "r.*"))


def _measures(found: DataFrame) -> DataFrame:
    """The columns of a form from the sums of its windows."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    variance = F.col("n") * F.col("tt") - F.col("t") * F.col("t")
    over = [F.col(f"o{i}") for i in range(len(LINES))]
    return found.select(
        "event_id",
        F.timestamp_micros("at_us").alias("cutoff_at"),
        *_scope_columns(),
        "last_n",
        F.col("n").alias("matches"),
        F.col("w").alias("wins"),
        F.col("d").alias("draws"),
        (F.col("n") - F.col("w") - F.col("d")).alias("losses"),
        (F.col("w") / n).alias("win_rate"),
        (F.col("d") / n).alias("draw_rate"),
        ((F.col("n") - F.col("w") - F.col("d")) / n).alias("loss_rate"),
        (F.col("f") / n).alias("goals_for_avg"),
        ((F.col("t") - F.col("f")) / n).alias("goals_against_avg"),
        (F.col("t") / n).alias("total_avg"),
        *([F.col("median").alias("median_total")] if "median" in found.columns else []),
        (F.sqrt(variance.cast("double")) / n).alias("std_total"),
        *[(column / n).alias(f"over_{name}") for column, name in zip(over, _LINE_NAMES)],
        *[((F.col("n") - column) / n).alias(f"under_{name}") for column, name in zip(over, _LINE_NAMES)],
    )
