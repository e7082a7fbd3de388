"""Entity resolution of names: exact, alias, fuzzy, review or new.

All work is on distinct folded names. Candidate pairs by edit similarity come
from pieces that few edits must leave whole; by matching blocks from shared
character pairs restricted to the rarest ones a match must contain, so a
frequent character pair does not bring all names together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oddsloom.functions import text as text_fn
from oddsloom.session import materialize

AUTO_THRESHOLD = 0.985
REVIEW_THRESHOLD = 0.80
MINIMUM_MARGIN = 0.05
_LEAST_THRESHOLD = 0.80


def _grams(name: Column) -> Column:
    """Character pairs numbered by occurrence, so a set keeps repetitions."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.char_length(name) - 1), lambda i: F.substr(name, i, F.lit(2))
    )
    size = F.char_length(name)
    return F.when(size >= 2, pairs).otherwise(F.array().cast("array<string>"))


def _numbered(names: DataFrame) -> DataFrame:
    """(name, size, gram) rows; three-letter names also list their subsequences.

    A two-letter name inside a three-letter one is the only match above the
    threshold that need not share a character pair.
    """
    sized = names.withColumn("size", F.char_length("name"))
    pairs = sized.select("name", "size", F.posexplode(_grams(F.col("name"))).alias("at", "pair"))
    counted = pairs.withColumn(
        "turn", F.row_number().over(Window.partitionBy("name", "pair").orderBy("at"))
    ).select("name", "size", F.concat_ws("#", "pair", "turn").alias("gram"))
    letter = [F.substring("name", i, 1) for i in (1, 2, 3)]
    parts = F.when(
        F.col("size") == 3,
        F.array_distinct(F.array(F.concat(letter[0], letter[1]), F.concat(letter[0], letter[2]),
                                 F.concat(letter[1], letter[2]))),
    ).when(F.col("size") == 2, F.array("name")).otherwise(F.array().cast("array<string>"))
    short = sized.select("name", "size", F.explode(parts).alias("part"))
    return counted.unionByName(
        short.select("name", "size", F.concat(F.lit("sub#"), "part").alias("gram"))
    )


def _signature(names: DataFrame, threshold: float) -> DataFrame:
    """The rarest grams of each name that any sufficiently similar name shares.

    Names of sizes a and b with similarity >= t share at least
    (1.5 t - 1)(a + b) - 1 pairs, and b >= a t / (2 - t). Two sets sharing at
    least k elements share one among the first |A| - k + 1 of any common order.
    """
    grams = _numbered(names)
    common = grams.where(~F.col("gram").startswith("sub#"))
    frequency = common.groupBy("gram").agg(F.count("*").alias("names"))
    ordered = common.join(frequency, "gram").withColumn(
        "place", F.row_number().over(Window.partitionBy("name").orderBy("names", "gram"))
    )
    shortest = F.ceil(F.col("size") * threshold / (2 - threshold))
    shared = F.ceil((1.5 * threshold - 1) * (F.col("size") + shortest) - 1 - 1e-9)
    needed = F.greatest(F.lit(1), shared)
    kept = ordered.where(F.col("place") <= F.col("size") - 1 - needed + 1)
    short = grams.where(F.col("gram").startswith("sub#"))
    return kept.select("name", "size", "gram").unionByName(short)


def similar_names(
    probes: DataFrame, pool: DataFrame, *, threshold: float = REVIEW_THRESHOLD,
    similarity: str = "sequence",
) -> DataFrame:
    """Distinct (probe, candidate, score) with score >= threshold.

    Both inputs have a column ``name``. Complete for thresholds from 0.80.
    """
    if threshold < _LEAST_THRESHOLD:
        raise ValueError(f"threshold below {_LEAST_THRESHOLD} is not covered")
    if similarity == "levenshtein":
        return _edit_similar(probes, pool, threshold)
    if similarity != "sequence":
        raise ValueError("similarity must be 'sequence' or 'levenshtein'")
    everyone = probes.select("name").union(pool.select("name")).distinct()
    signature = _signature(everyone, threshold)
    left = signature.join(probes.select("name").distinct(), "name", "left_semi").select(
        F.col("name").alias("probe"), F.col("size").alias("a"), "gram"
    )
    right = signature.join(pool.select("name").distinct(), "name", "left_semi").select(
        F.col("name").alias("candidate"), F.col("size").alias("b"), "gram"
    )
    short, long = F.least("a", "b"), F.greatest("a", "b")
    pairs = (
        left.join(right, "gram")
        .where((F.col("probe") != F.col("candidate")) & (short * (2 - threshold) >= long * threshold - 1e-9))
        .select("probe", "candidate")
        .distinct()
    )
    score = text_fn.sequence_ratio(F.col("probe"), F.col("candidate"))
    return pairs.withColumn("score", score).where(F.col("score") >= threshold)


def _edit_similar(probes: DataFrame, pool: DataFrame, threshold: float) -> DataFrame:
    """:func:`similar_names` by edit similarity, over pieces that the edits must leave whole.

    A pair whose longer name has size b differs by at most k = (1 - threshold) b
    edits. Cut that name into k + 1 pieces: some piece i is whole in the other
    name, with at most i edits before it and k - i after it, which bounds its
    place there. So names meet over whole pieces of their longer one, several
    letters each, and not over single character pairs.
    """
    tagged = probes.select("name", F.lit(True).alias("probe"), F.lit(False).alias("pool")).unionByName(
        pool.select("name", F.lit(False).alias("probe"), F.lit(True).alias("pool"))
    )
    everyone = tagged.groupBy("name").agg(F.bool_or("probe").alias("probe"), F.bool_or("pool").alias("pool")).withColumn(
        "size", F.char_length("name")
    )
    edits = F.floor(F.col("b") * (1 - threshold) + 1e-9).cast("int")
    pieces = F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")
    width, longer_from = F.expr("b div (k + 1)").cast("int"), F.expr("k + 1 - b % (k + 1)")

    def cut(df: DataFrame, *kept: str) -> DataFrame:
        return df.where("k > 0").select(*kept, "b", "k", pieces).select(
            *kept, "b", "k", "i", (F.col("i") * width + F.greatest(F.lit(0), F.col("i") - longer_from)).alias("at"),
            (width + F.when(F.col("i") >= longer_from, 1).otherwise(0)).alias("letters"),
        )

    sizes = everyone.select(F.col("size").alias("b")).distinct().withColumn("k", edits)
    long = cut(everyone.select("*", F.col("size").alias("b")).withColumn("k", edits), "name", "probe", "pool").select(
        F.col("name").alias("long"), F.col("probe").alias("long_probe"), F.col("pool").alias("long_pool"), "b", "i",
        F.substr("name", F.col("at") + 1, F.col("letters")).alias("piece"),
    )
    fitting = everyone.join(sizes, (F.col("b") >= F.col("size")) & (F.col("b") - F.col("size") <= F.col("k")))
    before, after, shift = F.col("i"), F.col("k") - F.col("i"), F.col("size") - F.col("b")
    first = F.greatest(F.lit(0), F.col("at") - before, F.col("at") + shift - after)
    last = F.least(F.col("size") - F.col("letters"), F.col("at") + before, F.col("at") + shift + after)
    short = (
        cut(fitting, "name", "probe", "pool", "size")
        .withColumns({"first": first, "last": last})
        .where("first <= last")
        .withColumn("place", F.explode(F.sequence("first", "last")))
        .select(
            F.col("name").alias("short"), F.col("probe").alias("short_probe"), F.col("pool").alias("short_pool"),
            "size", "b", "i", F.substr("name", F.col("place") + 1, F.col("letters")).alias("piece"),
        )
    )
    forth, back = F.col("long_probe") & F.col("short_pool"), F.col("short_probe") & F.col("long_pool")
    # Of two names of one size each is the longer one; the pair is needed once.
    once = (F.col("size") < F.col("b")) | (F.col("short") < F.col("long"))
    pairs = long.join(short, ["b", "i", "piece"]).where(once & (forth | back)).select(
        "long", "short", forth.alias("forth"), back.alias("back")
    ).distinct()
    scored = pairs.withColumn("score", text_fn.levenshtein_ratio(F.col("long"), F.col("short"))).where(F.col("score") >= threshold)
    ways = F.array(
        F.when(F.col("forth"), F.struct(F.col("long").alias("probe"), F.col("short").alias("candidate"))),
        F.when(F.col("back"), F.struct(F.col("short").alias("probe"), F.col("long").alias("candidate"))),
    )
    return scored.select(F.explode(F.filter(ways, lambda way: way.isNotNull())).alias("way"), "score").select("way.*", "score")


def entity_id(kind: str, name: Column) -> Column:
    """Id of a new entity: a function of its name, equal on every run."""
    return F.xxhash64(F.lit(kind), name)


def _settle_new(names: DataFrame, pairs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Names that become new entities when taken in order of first appearance.

    A name is new unless it resembles a known entity (``blocked``) or an
    earlier new name. Each round decides every name whose earlier rivals are
    decided, so a round reads the previous one from files and never a lineage
    of rounds.
    """
    open_names = names.join(blocked, names["name"] == blocked["probe"], "left_anti")
    order = open_names.select("name", "first_seen")
    edges = (
        pairs.join(order.withColumnRenamed("name", "probe"), "probe")
        .join(
            order.select(F.col("name").alias("candidate"), F.col("first_seen").alias("seen")),
            "candidate",
        )
        .where(F.col("seen") < F.col("first_seen"))
        .select("probe", "candidate")
    )
    edges = materialize(edges, "name-rivals")
    state = materialize(
        order.select("name", F.lit(None).cast("boolean").alias("is_new")), "name-state"
    )
    while True:
        rivals = edges.join(
            state.select(F.col("name").alias("candidate"), F.col("is_new").alias("rival_new")),
            "candidate",
        ).groupBy("probe").agg(
            F.bool_or(F.coalesce("rival_new", F.lit(False))).alias("beaten"),
            F.bool_or(F.col("rival_new").isNull()).alias("waiting"),
        )
        decided = state.join(rivals, state["name"] == rivals["probe"], "left").select(
            "name",
            F.coalesce(
                "is_new",
                F.when(F.col("beaten"), False)
                .when(F.col("waiting"), F.lit(None).cast("boolean"))
                .otherwise(True),
            ).alias("is_new"),
        )
        state = materialize(decided, "name-state")
        if state.where(F.col("is_new").isNull()).isEmpty():
            return state.where("is_new").select("name")


def decide(
    names: DataFrame,
    entities: DataFrame,
    *,
    kind: str = "player",
    source_aliases: DataFrame | None = None,
    global_aliases: DataFrame | None = None,
    auto_threshold: float = AUTO_THRESHOLD,
    review_threshold: float = REVIEW_THRESHOLD,
    minimum_margin: float = MINIMUM_MARGIN,
    similarity: str = "sequence",
) -> DataFrame:
    """Decision per distinct folded name.

    ``names``: name, first_seen (order of first appearance). ``entities``:
    entity_id, name. Aliases: name, entity_id. Output: name, action in {alias,
    exact, fuzzy, review, new}, entity_id (set unless under review),
    candidate_id, confidence, second_best_confidence. Scores below the review
    threshold are reported as 0.
    """
    if not 0 <= review_threshold <= auto_threshold <= 1:
        raise ValueError("need 0 <= review <= auto <= 1")
    if not 0 <= minimum_margin <= 1:
        raise ValueError("the margin lies outside 0 to 1")

    def holders(table: DataFrame | None, label: str) -> DataFrame:
        if table is None:
            table = names.select("name", F.lit(None).cast("long").alias("entity_id")).limit(0)
        return table.groupBy("name").agg(
            F.count_distinct("entity_id").alias(f"{label}_n"), F.min("entity_id").alias(f"{label}_id")
        )

    known = (
        names.join(holders(source_aliases, "source"), "name", "left")
        .join(holders(global_aliases, "global"), "name", "left")
        .join(holders(entities, "entity"), "name", "left")
    )
    found = F.coalesce("source_id", "global_id", "entity_id")
    several = F.when(F.col("source_id").isNotNull(), False).otherwise(
        F.coalesce(F.col("global_n"), F.col("entity_n")) > 1
    )
    direct = known.where(found.isNotNull()).select(
        "name",
        F.when(F.col("source_id").isNotNull(), "alias").when(several, "review").otherwise("exact").alias("action"),
        F.when(~several, found).alias("entity_id"),
        found.alias("candidate_id"),
        F.lit(1.0).alias("confidence"),
        F.when(several, 1.0).otherwise(0.0).alias("second_best_confidence"),
    )
    rest = materialize(known.where(found.isNull()).select("name", "first_seen"), "names-open")

    pool = entities.select("name").union(rest.select("name")).distinct()
    pairs = materialize(
        similar_names(rest, pool, threshold=review_threshold, similarity=similarity), "name-pairs"
    )
    by_entity = pairs.join(
        entities.select(F.col("name").alias("candidate"), "entity_id"), "candidate"
    ).select("probe", "candidate", "score", "entity_id", F.lit(0).alias("rank"))
    created = _settle_new(rest, pairs, by_entity.select("probe").distinct())
    seen = rest.select(F.col("name").alias("candidate"), F.col("first_seen").alias("seen"))
    by_new = (
        pairs.join(created.withColumnRenamed("name", "candidate"), "candidate")
        .join(seen, "candidate")
        .join(rest.withColumnRenamed("name", "probe"), "probe")
        .where(F.col("seen") < F.col("first_seen"))
        .select("probe", "candidate", "score", entity_id(kind, F.col("candidate")).alias("entity_id"),
                (F.col("seen") + 1).alias("rank"))
    )
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "rank", "entity_id")
    ranked = by_entity.unionByName(by_new).withColumns(
        {"place": F.row_number().over(order), "second": F.lead("score").over(order)}
    ).where("place = 1")
    scored = rest.join(ranked, rest["name"] == ranked["probe"], "left")
    best, second = F.coalesce("score", F.lit(0.0)), F.coalesce("second", F.lit(0.0))
    long_enough = (F.char_length("name") >= 5) & (F.char_length("candidate") >= 5)
    fuzzy = (best >= auto_threshold) & (best - second >= minimum_margin) & long_enough
    action = F.when(F.col("probe").isNull(), "new").when(fuzzy, "fuzzy").otherwise("review")
    judged = scored.select(
        "name", action.alias("action"), F.col("entity_id").alias("candidate_id"),
        best.alias("confidence"), second.alias("second_best_confidence"),
    )
    resolved = judged.select(
        "name", "action",
        F.when(F.col("action") == "new", entity_id(kind, F.col("name")))
        .when(F.col("action") == "fuzzy", F.col("candidate_id")).alias("entity_id"),
        "candidate_id", "confidence", "second_best_confidence",
    )
    return direct.unionByName(resolved)


def resolve_participants(
    participants: DataFrame,
    entities: DataFrame,
    *,
    column: str,
    kind: str,
    source: str,
    aliases: DataFrame | None = None,
    similarity: str = "sequence",
) -> dict[str, DataFrame]:
    """Attach entity ids to the participants of one source.

    ``participants``: participant_id and the name column. ``aliases``:
    source, name, entity_id. Returns attached, new_entities, new_aliases and
    reviews.
    """
    # Labels are folded once, spread over tasks however few files hold them.
    spread = participants.repartition("participant_id", column)
    folded = materialize(text_fn.normalize_names(spread, column, kind, output="name"), f"{kind}-folded")
    named = folded.where(F.coalesce("name", F.lit("")) != "")
    distinct = named.groupBy("name").agg(
        F.min("participant_id").alias("first_seen"), F.min_by(column, "participant_id").alias("raw")
    )
    own = aliases.where(F.col("source") == source) if aliases is not None else None
    choices = materialize(
        decide(
            distinct.select("name", "first_seen"), entities, kind=kind, source_aliases=own,
            global_aliases=aliases, similarity=similarity,
        ),
        f"{kind}-decisions",
    )
    raw = distinct.select("name", "raw")
    reason = F.format_string(
        "fuzzy candidate requires review; best=%.4f, second=%.4f",
        "confidence", "second_best_confidence",
    )
    return {
        "attached": folded.join(choices.select("name", "action", "entity_id"), "name", "left").select(
            *participants.columns, "name", "action", "entity_id"
        ),
        "new_entities": choices.where("action = 'new'").join(raw, "name").select(
            "entity_id", F.col("raw").alias("display_name"), "name"
        ),
        "new_aliases": choices.where(F.col("action").isin("exact", "fuzzy", "new")).join(raw, "name").select(
            F.lit(source).alias("source"), "name", F.col("raw").alias("alias"), "entity_id",
            F.col("action").alias("match_method"),
            F.when(F.col("action") == "new", 1.0).otherwise(F.col("confidence")).cast("decimal(5,4)").alias("confidence"),
        ),
        "reviews": choices.where("action = 'review'").join(raw, "name").select(
            F.lit(source).alias("source"), F.lit(kind).alias("entity_type"), "raw", "name",
            "candidate_id", "confidence", F.lit("pending").alias("status"), reason.alias("reason"),
        ),
    }


def alternate_names(
    attached: DataFrame, *, column: str, aliases: DataFrame, source: str, kind: str = "team"
) -> dict[str, DataFrame]:
    """A second spelling becomes an alias, or a review when it belongs elsewhere.

    ``attached``: participant_id, entity_id and the alternate name column.
    """
    folded = text_fn.normalize_names(
        attached.where(F.col("entity_id").isNotNull() & F.col(column).isNotNull()), column, kind,
        output="alternate",
    ).where("alternate <> ''")
    first = folded.groupBy("alternate").agg(
        F.min_by(F.struct("entity_id", F.col(column).alias("raw")), "participant_id").alias("f"),
        F.collect_set("entity_id").alias("claimed"),
    ).select("alternate", "f.entity_id", "f.raw", "claimed")
    own = aliases.where(F.col("source") == source).groupBy("name").agg(F.min("entity_id").alias("own_id"))
    every = aliases.groupBy("name").agg(F.collect_set("entity_id").alias("holders"))
    seen = (
        first.join(own.withColumnRenamed("name", "alternate"), "alternate", "left")
        .join(every.withColumnRenamed("name", "alternate"), "alternate", "left")
        .withColumn("holders", F.coalesce("holders", F.array().cast("array<bigint>")))
    )
    free = F.col("own_id").isNull() & (
        (F.size("holders") == 0) | ((F.size("holders") == 1) & F.array_contains("holders", F.col("entity_id")))
    )
    owner = F.coalesce("own_id", F.when(free, F.col("entity_id")), F.array_min("holders"))
    judged = seen.withColumns({"free": free, "owner": owner})
    conflicts = judged.select("alternate", "raw", "owner", "holders", "own_id", F.explode("claimed").alias("claim")).where(
        (F.col("claim") != F.col("owner"))
        & (F.col("own_id").isNotNull() | (F.size("holders") == 0) | ~F.array_contains("holders", F.col("claim")))
    )
    return {
        "new_aliases": judged.where("free").select(
            F.lit(source).alias("source"), F.col("alternate").alias("name"), F.col("raw").alias("alias"),
            "entity_id", F.lit("exact_alt").alias("match_method"),
            F.lit(1).cast("decimal(5,4)").alias("confidence"),
        ),
        "reviews": conflicts.select(
            F.lit(source).alias("source"), F.lit(kind).alias("entity_type"), "raw",
            F.col("alternate").alias("name"), F.col("owner").alias("candidate_id"),
            F.lit(1.0).alias("confidence"), F.lit("pending").alias("status"),
        ).distinct(),
    }


def events_by_side(events: DataFrame, attached: DataFrame) -> DataFrame:
    """Write resolved ids back to events: side 1 and 2 become two columns."""
    sides = attached.groupBy("event_id").agg(
        *[
            F.max(F.when(F.col("side") == side, F.col("entity_id"))).alias(f"player{side}")
            for side in (1, 2)
        ]
    )
    kept = [name for name in events.columns if name not in ("player1", "player2")]
    return events.select(*kept).join(sides, "event_id", "left")


def statistics(attached: DataFrame) -> DataFrame:
    return attached.agg(
        F.count("*").alias("participants_seen"),
        F.count_if(F.col("entity_id").isNotNull()).alias("attached"),
        F.count_distinct(F.when(F.col("action") == "new", F.col("entity_id"))).alias("created"),
        F.count_distinct(F.when(F.col("action") == "review", F.col("name"))).alias("reviews"),
    )
