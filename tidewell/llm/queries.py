"""Registered queries of the operators in this subpackage, with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bagminhash, decontam, html_extract, mixing, quality, secret_scan, spans, token_files, toxicity, winnow
from tidewell.llm._shared import Scratch

PREDICTED_AT = 0.7
LEVELS = ["domain", "lang", "source"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), out)
    return token_files.read_tokens(spark, out.root)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(quality.remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED_AT).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"), min_words=spans.RUN_WORDS, run_words=spans.RUN_WORDS, window=spans.WINDOW)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_domain(docs: DataFrame) -> DataFrame:
    """The tables have no domain; sources are dealt to four by their crc32 (an extra column of that name is replaced)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(F.crc32(source), F.lit(4)).cast("string")))


def target_weight(path: tuple) -> float:
    """The target weights of domains and languages; sources share equally."""
    if len(path) == 1:
        return {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}.get(path[0], 1.0)
    if len(path) == 2:
        return {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}.get(path[1], 1.0)
    return 1.0


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(docs, LEVELS, budget=1.0, weight=target_weight, max_epochs=2)
    return mixed.select("doc_id", *LEVELS, F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"), F.col("mix_budget").alias("leaf_budget"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(quality.remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED_AT).cast("int").alias("predicted"), "neighbours", "terms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_html_extraction, op3_decontamination, op4_token_files, op5_quality_classifier, op6_substring_dedup, op7_fingerprints, op8_near_duplicates, op9_mixing, op10_toxicity)
    return {f.__name__: f for f in own}


#: Words and shingles as the operators cut them: runs of letters, digits, underscores and everything outside ASCII.
_GRAMS = """w AS (SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '(?:[^\\x00-\\x7F]|[0-9A-Za-z_])+') AS w FROM {table}),
g AS (SELECT id, len(w) AS words, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(g) AS g FROM g) GROUP BY 1, 2)"""


def _grams(table_name: str, id_column: str, prefix: str) -> str:
    out = _GRAMS.format(table=table_name, id=id_column)
    for name in "wgs":
        out = re.sub(rf"\b{name} AS \(", f"{prefix}{name} AS (", out)
    return out.replace("FROM w)", f"FROM {prefix}w)").replace("FROM g) GROUP", f"FROM {prefix}g) GROUP")


#: An item of fewer than five words is sought as one run of its own length.
_OP3 = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[^\\x00-\\x7F]|[0-9A-Za-z_])+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[^\\x00-\\x7F]|[0-9A-Za-z_])+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d JOIN sizes ON len(w) >= k),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM b JOIN sizes ON k = least(len(w), 5)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
m AS (SELECT doc_id, item_id, count(*) AS s FROM ds JOIN bs USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, s AS shared_shingles, s / n AS containment FROM m JOIN n USING (item_id) WHERE s >= 0.8::DOUBLE * n - 1e-9::DOUBLE"""

_OP8 = f"""WITH RECURSIVE {_grams("documents", "doc_id", "d")}, t AS (SELECT id, sum(n) AS n FROM ds GROUP BY 1),
p AS (SELECT a.id AS u, b.id AS v, sum(least(a.n, b.n)) AS k FROM ds a JOIN ds b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN t x ON x.id = u JOIN t y ON y.id = v WHERE k / (x.n + y.n - k) >= 0.8::DOUBLE - 1e-12::DOUBLE), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT id AS a, id AS c FROM dg UNION SELECT r.a, b.v FROM r JOIN b ON b.u = r.c), c AS (SELECT a AS doc_id, min(c) AS class_id FROM r GROUP BY 1)
SELECT c.doc_id, c.class_id, count(*) OVER (PARTITION BY c.class_id) AS class_size, dg.words FROM c JOIN dg ON dg.id = c.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Exact containment and exact similarity have an equivalent in SQL; the rest (hashes, models, files) is held against brute force in tests."""
    return {"op3_decontamination": _OP3, "op8_near_duplicates": _OP8}
