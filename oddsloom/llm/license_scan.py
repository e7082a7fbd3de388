"""License scan with ordered signature rules.

A text becomes its words with one space between them. Texts that hold none of
the rules' keywords go no further; on the others only the rules whose keyword
occurs are tried. The pieces between and in a rule's matches give each match's
place in words. Overlaps are resolved by containment: a detection inside another
of the same or a stronger priority is suppressed, found with one running maximum
per priority over a row's detections in order of their start.

Everything is DataFrame expressions. Null texts count as empty; a text without
words has no detections and score 0. Repeated rows have their detections each. A
very long text is scanned whole; its detections are one window of rows. Detections
of one place go by priority, then by the rules' order. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.license_rules import BASE_RULES, RULES, WEIGHTS, Rule

_OTHER = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" ")))


def _hits(words: Column, rules: tuple[Rule, ...]) -> Column:
    """Per match: number of the rule and of the match, words since the match before, words in it."""
    table = F.array(
        *[
            F.struct(F.lit(number).alias("rule"), F.lit(rule.keyword).alias("word"),
                     F.lit(f" (?:{rule.pattern})(?= )").alias("pattern"))
            for number, rule in enumerate(rules)
        ]
    )

    def matches(rule: Column) -> Column:
        pieces = F.struct(
            F.split(words, rule.pattern).alias("gaps"), F.regexp_extract_all(words, rule.pattern, F.lit(0)).alias("found")
        )
        return F.flatten(
            F.transform(
                F.array(pieces),
                lambda x: F.transform(
                    x.found,
                    lambda match, at: F.struct(
                        rule.rule.alias("rule"), at.alias("at"), _spaces(F.get(x.gaps, at)).alias("gap"),
                        _spaces(match).alias("size"),
                    ),
                ),
            )
        )

    return F.flatten(F.transform(F.filter(table, lambda rule: F.contains(words, rule.word)), matches))


def detect(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per detection: row, doc_id, n_words, label, priority, base, start, end (words, end exclusive), kept.

    A row without detections has one row with a null label. Base phrases are
    always kept and suppress nothing.
    """
    every = (*BASE_RULES, *rules)
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")), _OTHER, " ")
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("words")
    )
    # What a rule matches holds a keyword at the start of a word, so the gate looks there only; without regard to
    # case, since lower() of whole texts costs more than all the rest.
    keywords = sorted({rule.keyword for rule in every})
    passed = F.col("words").rlike(f"(?i) (?:{'|'.join(keywords)})")
    folded = F.translate("words", _UPPER, _LOWER)
    struct = "array<struct<rule:int,at:int,gap:int,size:int>>"
    found = F.when(passed, _hits(folded, every)).otherwise(F.array().cast(struct))
    rows = words.select("row", "doc_id", (_spaces(F.col("words")) - 1).cast("long").alias("n_words"), found.alias("hits"))
    hits = rows.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
    labels = F.array(*[F.lit(rule.label) for rule in every])
    priorities = F.array(*[F.lit(rule.priority) for rule in every])
    in_rule = Window.partitionBy("row", "hit.rule").orderBy("hit.at")
    up_to = in_rule.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(up_to)
    placed = hits.select(
        "row", "doc_id", "n_words", F.get(labels, F.col("hit.rule")).alias("label"),
        F.get(priorities, F.col("hit.rule")).alias("priority"), (F.col("hit.rule") < len(BASE_RULES)).alias("base"),
        (end - F.col("hit.size")).alias("start"), end.alias("end"), F.col("hit.rule").alias("rule"),
    )
    before = (
        Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    strongest = F.lit(None).cast("long")
    for priority in sorted({rule.priority for rule in rules}, reverse=True):
        reach = F.max(F.when(~F.col("base") & (F.col("priority") <= priority), F.col("end"))).over(before)
        strongest = F.when(F.col("priority") == priority, reach).otherwise(strongest)
    kept = F.col("base") | (F.coalesce(strongest, F.lit(-1)) < F.col("end"))
    return placed.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("rule")


def summary(detections: DataFrame) -> DataFrame:
    """One row per document: counts and places of base phrases, labels, and the weight of the surest detection."""
    weights = F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item])
    base = F.col("base") & F.col("label").isNotNull()
    listed = lambda label: F.concat_ws(",", F.array_sort(F.collect_set(label)))
    return (
        detections.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            listed(F.when(base, F.col("label"))).alias("base_labels"),
            listed(F.when(F.col("kept"), F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("kept"), weights[F.col("priority")])), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
