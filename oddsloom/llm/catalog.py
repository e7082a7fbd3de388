"""Queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from oddsloom.llm import (
    block_knn,
    bloom_lm,
    bpe_tree,
    decontaminate,
    license_scan,
    merkle_butterfly,
    pii_bootstrap,
    quality_qda,
    repair_ids,
    secret_ledger,
    simhash_gray,
    spelling_trie,
    toxicity_zstd,
)
from oddsloom.llm.common import read, tokenizer_path
from oddsloom.session import materialize, scratch_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[function.__name__] = function
    return function


@_query
def op10_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(quality_qda.with_statistics(read(spark, sf_dir, "documents")), "statistics")
    model = quality_qda.fit(rows, read(spark, sf_dir, "labels"), "quality")
    return quality_qda.score(rows, model)


@_query
def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_ledger.digest(secret_ledger.scan(docs, scratch_path(spark, "ledger"), "0", texts=False))


@_query
def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_copies(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode(read(spark, sf_dir, "documents"), tokenizer_path(), output="digest")


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query
def op9_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity_zstd.score(docs, toxicity_zstd.fit(docs, read(spark, sf_dir, "labels")))


@_query
def op7_block_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


LLM_ORACLES["op7_block_knn"] = """
WITH usable AS (
    SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@_query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.detect(read(spark, sf_dir, "documents")))


@_query
def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digest(pii_bootstrap.find(read(spark, sf_dir, "documents")))


@_query
def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(read(spark, sf_dir, "documents"))


@_query
def op11_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_ids.summary(repair_ids.write(read(spark, sf_dir, "documents"), tokenizer_path()))


@_query
def op13_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second row, by the checksum of its id, is held against a copy without line ends."""
    altered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    copy_text = F.when(altered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_butterfly.digest(merkle_butterfly.verify(read(spark, sf_dir, "documents"), copy_text))


#: The list of the 256 steps of crc32, and the checksum of a list of bytes read off it.
_CRC_STEPS = """list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _crc32(bytes_: str, steps: str = "t") -> str:
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), "
        f"lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1])))"
    )


def _merkle_sql(levels: int = 12) -> str:
    """Trees of up to 3 ** levels leaves; nodes that are alone stay, others become their run's digest."""
    doc_bytes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))"

    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"

    def hashed(text: str) -> str:
        return f"sha256({' || '.join([field(n) for n in ('doc_id', 'source', 'lang', 'n_chars')] + [text])})"

    parts = [
        f"""WITH steps AS (SELECT {_CRC_STEPS} AS t), docs AS (
            SELECT doc_id, source, {hashed(field("text"))} AS leaf,
                CASE WHEN {_crc32(doc_bytes)} % 2 = 0 THEN {hashed(field("replace(text, chr(10), '')"))}
                    ELSE {hashed(field("text"))} END AS claimed
            FROM documents, steps
        ), d0 AS (
            SELECT doc_id, source, leaf, claimed AS cur, leaf AS node, '' AS beside,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot
            FROM docs)"""
    ]

    def climb(table: str, step: int, key: str) -> str:
        """The next level: each row knows its node, its number, the folded value and all siblings so far."""
        return f"""
        , n{table}{step} AS (SELECT DISTINCT {key}, spot, node FROM {table}{step}),
        r{table}{step} AS (
            SELECT {key}, spot // 3 AS up, string_agg(node, '' ORDER BY spot) AS run, list(node ORDER BY spot) AS nodes,
                max(max(spot)) OVER (PARTITION BY {key}) AS most
            FROM n{table}{step} GROUP BY {key}, spot // 3
        ), {table}{step + 1} AS (
            SELECT d.doc_id, d.source, d.leaf,
                CASE WHEN most = 0 THEN d.cur ELSE sha256(array_to_string(nodes[:d.spot % 3], '') || d.cur
                    || array_to_string(nodes[d.spot % 3 + 2:], '')) END AS cur,
                CASE WHEN most = 0 THEN d.node ELSE sha256(run) END AS node,
                CASE WHEN most = 0 THEN beside ELSE beside || array_to_string(nodes[:d.spot % 3], '')
                    || array_to_string(nodes[d.spot % 3 + 2:], '') END AS beside,
                up AS spot{", d.subroot, d.one" if table == "s" else ""}
            FROM {table}{step} d JOIN r{table}{step} r
                ON d.{key} IS NOT DISTINCT FROM r.{key} AND d.spot // 3 = r.up)"""

    parts += [climb("d", step, "source") for step in range(levels)]
    parts.append(
        f""", s0 AS (SELECT doc_id, source, leaf, cur, node, beside, node AS subroot, 1 AS one,
            dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS spot FROM d{levels})"""
    )
    parts += [climb("s", step, "one") for step in range(levels)]
    parts.append(
        f""" SELECT doc_id, leaf, subroot, node AS root, sha256(beside) AS proof_sha256, cur AS folded_root,
            cur = node AS verified FROM s{levels}"""
    )
    return "".join(parts)


LLM_ORACLES["op13_merkle_butterfly"] = _merkle_sql()


@_query
def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(spelling_trie.count_words(read(spark, sf_dir, "documents")), "words")
    return spelling_trie.variants(words)


#: UTF-8 of id and run; runs hold letters up to U+00FF only.
_RUN_BYTES = """flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195::BIGINT, CAST(unicode(x) - 64 AS BIGINT)] END))"""

LLM_ORACLES["op12_spelling_trie"] = f"""
WITH RECURSIVE steps AS (SELECT {_CRC_STEPS} AS t), runs AS (
    SELECT doc_id, translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS piece FROM documents)
    WHERE length(piece) >= 6 GROUP BY ALL
), hashed AS (SELECT run, k, {_crc32(_RUN_BYTES)} AS h FROM runs, steps), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
        CAST(sum(k) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words), cuts AS (
    SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole,
        substr(word, 1, i - 1) || substr(word, i + 1) AS less
    FROM places
), near AS (
    SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
        CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON f.word = e.word
"""
