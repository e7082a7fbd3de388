"""Secret scans over an incremental ledger of content-addressed blobs.

A blob is a distinct text, named by its SHA-256. The ledger in a shared folder
holds, per blob, which rule versions have scanned it and what they found. A run
scans only (blob, rule version) pairs that the ledger lacks, appends them as one
batch, and joins the findings of all batches back to every path with that blob.
A rule's keyword gate runs in the JVM while the blob is hashed, so only blobs
that can match travel with their text.

Null texts count as empty. Equal texts are one blob, however often they occur; very
long ones are hashed in the JVM and travel whole only if a gate passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.session import materialize

FINDING = "struct<rule:string,kind:string,start:long,end:long>"
_LEDGER = f"blob string, versions array<string>, findings array<{FINDING}>"


@dataclass(frozen=True)
class Rule:
    """A pattern for one kind of secret.

    ``gate`` lists strings one of which every matching text holds, in lower
    case; ``gate_pattern`` is used instead where no such string exists.
    ``group`` and ``least`` give the part of a match that has a least length.
    """

    kind: str
    pattern: str
    version: int = 1
    gate: tuple[str, ...] = ()
    gate_pattern: str = ""
    any_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches in code points; those that are too short are dropped."""
        compiled = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]

    def may_match(self, text: Column, lowered: Column) -> Column:
        if self.gate_pattern:
            return text.rlike(self.gate_pattern)
        passed = F.lit(False)
        for word in self.gate:
            passed = passed | lowered.contains(word)
        return passed


BASE_RULES = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        gate=("password", "passwd", "secret", "token", "api_key", "apikey"), any_case=True, group=2, least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", gate=("akia",), least=20),
    Rule("hex", r"[0-9a-f]+", gate_pattern="[0-9a-f]{24}", least=24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", gate=("private key-----",)),
    Rule("forge", r"\b(?:gh[oprsu]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", gate=("gh", "glpat-")),
    Rule("chat", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}", gate=("xox",)),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", gate=("eyj",)),
    Rule("cloud", r"\bAIza[A-Za-z0-9_-]{35}", gate=("aiza",)),
    Rule("pay", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", gate=("k_live_", "k_test_")),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,128}:[^\s/@]{3,128}@", gate=("://",)),
)
RULES = BASE_RULES + MORE_RULES


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of a ledger; one that does not exist yet is empty."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{folder}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def address(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``blob`` and ``gated``, the versions of the rules whose gate the text passes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gated = F.filter(
        F.array(*[F.when(rule.may_match(text, F.lower(text)), F.lit(rule.name)) for rule in rules]),
        lambda name: name.isNotNull(),
    )
    return docs.withColumns({"blob": F.sha2(text, 256), "gated": gated})


def _scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    finding = pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    by_name = {rule.name: rule for rule in rules}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            texts, chosen = batch["text"].to_pylist(), batch["gated"].to_pylist()
            for text, names in zip(texts, chosen, strict=True):
                found.append(
                    [
                        {"rule": name, "kind": by_name[name].kind, "start": start, "end": end}
                        for name in names
                        for start, end in by_name[name].find(text or "")
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch["blob"], batch["versions"], pa.array(found, pa.list_(finding))],
                names=["blob", "versions", "findings"],
            )

    return blobs.select("blob", "versions", "gated", "text").mapInArrow(run, _LEDGER)


def update_ledger(addressed: DataFrame, folder: str, batch: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the unseen (blob, rule version) pairs and write them as batch ``batch``.

    Writing the same batch again replaces it; blobs in other batches are not
    scanned again. ``addressed`` comes from ``address``.
    """
    spark = addressed.sparkSession
    earlier = read_ledger(spark, folder).where(~F.input_file_name().contains(f"/{batch}/"))
    seen = earlier.groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
    text = F.when(F.size("gated") > 0, F.col("text"))
    blobs = addressed.groupBy("blob").agg(F.first(text).alias("text"), F.first("gated").alias("gated"))
    versions = F.array(*[F.lit(rule.name) for rule in rules])
    unseen = (
        blobs.join(seen, "blob", "left")
        .withColumn("versions", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))))
        .withColumn("gated", F.array_intersect("gated", "versions"))
        .where("size(versions) > 0")
    )
    quiet = F.array().cast(f"array<{FINDING}>").alias("findings")
    idle = unseen.where("size(gated) = 0").select("blob", "versions", quiet)
    scanned = _scan(unseen.where("size(gated) > 0"), rules).unionByName(idle)
    scanned.write.mode("overwrite").parquet(f"{folder}/{batch}")


def findings(spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its findings by the given rule versions, in order of start and rule; blobs without any are left out."""
    rank = {rule.name: place for place, rule in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for item in rank.items() for x in item])
    names = [F.lit(name) for name in rank]
    current = read_ledger(spark, folder).select(
        "blob", F.filter("findings", lambda x: x.rule.isin(*names)).alias("found")
    )
    merged = current.where("size(found) > 0").groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    keyed = F.transform("found", lambda x: F.struct(x.start.alias("start"), order[x.rule].alias("at"), x.alias("x")))
    return merged.select("blob", F.transform(F.array_sort(keyed), lambda x: x.x).alias("findings"))


def join_findings(addressed: DataFrame, found: DataFrame) -> DataFrame:
    """Findings of each row's blob, for every row; an empty list where there are none.

    Only rows that pass a gate can have findings, so only those are joined.
    """
    none = F.array().cast(f"array<{FINDING}>")
    possible = addressed.where("size(gated) > 0").join(found, "blob", "left")
    return (
        possible.withColumn("findings", F.coalesce("findings", none))
        .unionByName(addressed.where("size(gated) = 0").withColumn("findings", none))
    )


def scan(
    docs: DataFrame, folder: str, batch: str, rules: tuple[Rule, ...] = RULES, texts: bool = True
) -> DataFrame:
    """``docs`` with blob, gated and findings, after bringing the ledger in ``folder`` up to date.

    The addressed rows are written once, since they are read by the scan and by
    the join. Without ``texts`` the text of rows that pass no gate becomes null.
    """
    addressed = address(docs, rules)
    if not texts:
        addressed = addressed.withColumn("text", F.when(F.size("gated") > 0, F.col("text")))
    addressed = materialize(addressed, "addressed")
    update_ledger(addressed, folder, batch, rules)
    return join_findings(addressed, findings(docs.sparkSession, folder, rules))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind and the spans as strings."""
    base = [rule.kind for rule in BASE_RULES]
    told = lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, told))
    own = F.filter("findings", lambda x: x.kind.isin(*base))
    of_kind = lambda kind: F.filter("findings", lambda x: x.kind == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return scanned.select(
        F.col("doc_id").cast("long"), *counts, F.sha2(listed(own), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


def redact(scanned: DataFrame, columns: tuple[str, ...], mark: str = "[secret]") -> DataFrame:
    """``columns`` of scanned rows, with every finding in the text replaced by ``mark`` and n_chars set anew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch["text"].to_pylist(), batch["findings"].to_pylist(), strict=True):
                pieces, at = [], 0
                for span in found:
                    if span["start"] >= at:
                        pieces += [text[at : span["start"]], mark]
                    at = max(at, span["end"])
                texts.append("".join([*pieces, text[at:]]))
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "text", pa.array(texts, batch.schema.field("text").type))

    chosen = [*columns, "findings"]
    holding = scanned.where("size(findings) > 0").select(*chosen)
    masked = holding.mapInArrow(run, holding.schema)
    if "n_chars" in columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(scanned.schema["n_chars"].dataType))
    return masked.select(*columns).unionByName(scanned.where("size(findings) = 0").select(*columns))
