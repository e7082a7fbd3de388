"""Personal data by patterns and by bootstrapped contexts.

Matches of the base patterns are seeds. A seed's surroundings give lexical
patterns at three levels: the two words before it, a label before it (a word that
ends in a colon, an equals or a number sign) with its shape (runs of letters, runs
of digits, other signs), and the words on either side. A single ordinary word is
no pattern: "the" before a run of digits would take numbers that fail the checksum
for cards. Words are those of the text, earlier identifiers among them, with digits
alike. Other identifier-like tokens in the same surroundings are instances of
the pattern. On the graph of patterns and instances a pattern's confidence
in a kind is the smoothed mean score of its instances, and an unknown instance's
score is the chance that one of its patterns is right, in turns. Unknown tokens
behind patterns of high confidence with enough seeds are reported as "context".

Everything is DataFrame expressions; tables that are read again are written to
the shared folder. Offsets are code points, ends exclusive. Null and empty texts
have no spans, a null doc_id stays null. Repeated rows have their spans each, and
count once as an instance, being equal to each other. Overlapping base spans are
all reported; a token that overlaps one is not. Very long texts are matched
whole and take linear time: a pattern that begins with a run of characters only
starts where the run does or where the last match ended. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.session import materialize

KINDS = ("email", "ip", "card", "phone")
TOKEN, CONTEXT = len(KINDS), "context"
#: Rounds on the graph, added weight of doubt, and what an accepted pattern needs.
ROUNDS, DOUBT, CONFIDENCE, LEAST_SEEDS, LEAST_DIGITS = 3, 2.0, 0.5, 3, 4
_TAIL = 64
_LABEL = "[\\p{L}0][:=#]+$"
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
    r"(?:(?<!\S)|\G)[^\s0-9@]*+[0-9@]\S*+",
)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _matches(text: Column, kind: int) -> Column:
    """Per match: kind, number, characters since the match before, characters in it, the match, and what is around it."""
    pieces = F.struct(
        F.split(text, _PATTERNS[kind]).alias("gaps"),
        F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0)).alias("found"),
    )

    def told(match: Column, at: Column, x: Column) -> Column:
        gap = F.get(x.gaps, at)
        before = F.concat(F.right(F.coalesce(F.get(x.found, at - 1), F.lit("")), F.lit(_TAIL)), F.right(gap, F.lit(_TAIL)))
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), F.length(gap).alias("gap"), F.length(match).alias("size"),
            match.alias("value"), F.right(before, F.lit(_TAIL)).alias("tail"),
            F.left(F.coalesce(F.get(x.gaps, at + 1), F.lit("")), F.lit(_TAIL)).alias("head"),
        )

    return F.flatten(F.transform(F.array(pieces), lambda x: F.transform(x.found, lambda m, at: told(m, at, x))))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def term(place: Column) -> Column:
        digit = F.substring(turned, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(place % 2 == 0, doubled).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, place: sum_ + term(place))
    return total % 10 == 0


def _passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    count = F.length(digits)
    return (
        F.when(kind == 1, value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == 2, F.when(count.between(13, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == 3, count.between(9, 15))
        .when(kind == TOKEN, (count >= LEAST_DIGITS) | F.contains(value, F.lit("@")))
        .otherwise(F.lit(True))
    )


def _words(text: Column) -> Column:
    """Words in lower case, digits alike; none for blank text."""
    folded = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"\s+", " "))
    return F.filter(F.split(folded, " "), lambda word: word != "")


def _surroundings(value: Column, tail: Column, head: Column) -> Column:
    """Hashes of the patterns that hold where a value stands, from the narrowest level to the widest."""
    before, after = _words(tail), _words(head)
    last = F.try_element_at(before, F.lit(-1))
    shape = F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]+", "0")
    following = F.get(after, F.lit(0))
    return F.array_compact(
        F.array(
            F.when(F.size(before) >= 2, F.xxhash64(F.lit(2), F.slice(before, -2, 2))),
            F.when(last.rlike(_LABEL), F.xxhash64(F.lit(1), last, shape)),
            F.when(last.isNotNull() & following.isNotNull(), F.xxhash64(F.lit(0), last, following)),
        )
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind, start, end, instance, patterns for base matches and other tokens.

    A row of ``docs`` without any has one row with a null kind. ``patterns`` are
    hashes of the surroundings, ``instance`` is that of the value.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    gates = (F.contains(text, F.lit("@")), digit, digit, F.contains(text, F.lit("+")), digit | F.contains(text, F.lit("@")))
    kind_of = "array<struct<kind:int,at:int,gap:int,size:int,value:string,tail:string,head:string>>"
    hits = F.concat(
        *[F.when(gate, _matches(text, kind)).otherwise(F.array().cast(kind_of)) for kind, gate in enumerate(gates)]
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), hits.alias("hits")
    ).select("row", "doc_id", F.explode_outer("hits").alias("hit"))
    in_kind = Window.partitionBy("row", "hit.kind").orderBy("hit.at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(in_kind)
    value = F.regexp_replace("hit.value", "[.,;:!?)]+$", "")
    placed = rows.select(
        "row", "doc_id", F.when(_passes(F.col("hit.kind"), F.col("hit.value")), F.col("hit.kind")).alias("kind"),
        (end - F.col("hit.size")).alias("start"), end.alias("end"), F.xxhash64(value).alias("instance"),
        _surroundings(value, F.col("hit.tail"), F.col("hit.head")).alias("patterns"),
    )
    base = F.col("kind") < TOKEN
    by_start = Window.partitionBy("row").orderBy("start")
    base_end, base_start = F.when(base, F.col("end")), F.when(base, F.col("start"))
    reached = F.max(base_end).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(base_start).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    covered = (F.coalesce(reached, F.lit(-1)) > F.col("start")) | (following < F.col("end"))
    marked = placed.withColumn("covered", F.coalesce(covered, F.lit(False)))
    kind = F.when((F.col("kind") == TOKEN) & F.col("covered"), F.lit(None)).otherwise(F.col("kind"))
    return marked.withColumn("kind", kind).drop("covered")


def confident_patterns(found: DataFrame) -> DataFrame:
    """Patterns (pattern) whose confidence in one kind is high after the rounds on the graph."""
    seeds = [F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(f"s{k}") for k in range(TOKEN)]
    instances = found.where("kind is not null").groupBy("instance").agg(*seeds)
    instances = materialize(instances.withColumn("seed", F.greatest(*[f"s{k}" for k in range(TOKEN)]) > 0), "instances")
    edges = materialize(
        found.where("kind is not null").select(F.explode("patterns").alias("pattern"), "instance").distinct(), "edges"
    )
    unknown = instances.where(~F.col("seed")).select("instance")
    known = instances
    for turn in range(ROUNDS):
        sums = [
            (F.sum(f"s{k}") / (F.count("*") + DOUBT)).alias(f"c{k}") for k in range(TOKEN)
        ]
        patterns = materialize(
            edges.join(known, "instance").groupBy("pattern").agg(*sums, F.count_if("seed").alias("seeds")), "patterns"
        )
        if turn == ROUNDS - 1:
            break
        chances = [
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col(f"c{k}"), F.lit(0.999)))))).alias(f"s{k}") for k in range(TOKEN)
        ]
        scored = (
            edges.join(unknown, "instance").join(patterns.drop("seeds"), "pattern").groupBy("instance").agg(*chances)
        )
        lasting = instances.where("seed").select("instance", *[f"s{k}" for k in range(TOKEN)], "seed")
        # Unknown instances behind no pattern have no edges and so no part in any sum.
        known = materialize(lasting.unionByName(scored.withColumn("seed", F.lit(False))), "scores")
    sure = F.greatest(*[f"c{k}" for k in range(TOKEN)]) >= CONFIDENCE
    return patterns.where(sure & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind (name), start, end for base matches and context finds; a null kind for a row without any."""
    found = materialize(occurrences(docs), "occurrences")
    sure = materialize(confident_patterns(found), "confident")
    names = F.array(*[F.lit(name) for name in (*KINDS, CONTEXT)])
    spans = found.select("row", "doc_id", "kind", "start", "end", "patterns")
    tokens = spans.where(F.col("kind") == TOKEN).withColumn("pattern", F.explode("patterns"))
    added = tokens.join(sure, "pattern").select("row", "doc_id", "kind", "start", "end").distinct()
    rest = spans.withColumn("kind", F.when(F.col("kind") < TOKEN, F.col("kind"))).drop("patterns")
    every = rest.unionByName(added)
    return every.withColumns({"rank": F.col("kind"), "kind": F.get(names, F.col("kind"))})


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind and the spans as strings, one row per document."""
    span = F.struct("rank", "start", "end", "kind")
    listed = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all")
    )
    told = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    text = lambda spans: F.concat_ws(",", F.transform(spans, told))
    of_kind = lambda number: F.filter("all", lambda x: x["rank"] == number)
    counts = [F.size(of_kind(number)).cast("long").alias(f"n_{name}") for number, name in enumerate(KINDS)]
    base = F.filter("all", lambda x: x["rank"] < TOKEN)
    return listed.select(
        "doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans")
    )
