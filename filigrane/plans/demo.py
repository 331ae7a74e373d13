"""The driver's tables in the engine's roles, once as frames and once as SQL.

A vector is a sentence's logits, 371 reports hold the sentences, 37 firms hold
the reports over seven years; labels of documents are the keyword baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE
from filigrane.operators import compare, flags, labels
from filigrane.operators.labels import COUNT_THRESHOLD

LABELS = FINANCE.labels
SCALE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, url, cik, year and one probability a label."""
    v = table(spark, sf_dir, "embeddings")
    report = F.col("vec_id") % 371
    probabilities = [labels.sigmoid(F.get("embedding", F.lit(i)), SCALE).alias(k) for i, k in enumerate(LABELS)]
    return v.select("vec_id", F.concat(F.lit("r"), report.cast("string")).alias("url"), (report % 37).alias("cik"), (2015 + report % 7).cast("int").alias("year"), *probabilities)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_counts(predictions(spark, sf_dir), ["url", "cik", "year"])


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.firm_years(flags.report_flags(counts(spark, sf_dir)), F.col("url"))


def keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels")
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = d.select((F.col("doc_id") % 37).alias("cik"), (2015 + F.col("doc_id") % 7).cast("int").alias("year"), flag(bad | toxic).alias("user"), flag(bad).alias("ir_user"), flag(toxic).alias("fx_user"), flag(bad & toxic).alias("cp_user"))
    return flags.keyword_flags(rows)


def merged(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    return compare.merge(model(spark, sf_dir), keyword(spark, sf_dir), how=how)


def _probability(i: int) -> str:
    return f"round(1 / (1 + exp(-greatest(least(embedding[{i + 1}]::DOUBLE * {SCALE}, 500), -500))), 3)"


PRED = "pred AS (SELECT vec_id, 'r' || (vec_id % 371) AS url, vec_id % 371 % 37 AS cik, 2015 + vec_id % 371 % 7 AS year, " + ", ".join(f"{_probability(i)} AS {k}" for i, k in enumerate(LABELS)) + " FROM embeddings)"
COUNTS = "counts AS (SELECT url, cik, year, count(*) AS n_sentences, " + ", ".join(f"sum(CASE WHEN {k} >= {COUNT_THRESHOLD} THEN 1 ELSE 0 END)::BIGINT AS n_{k}" for k in LABELS) + " FROM pred GROUP BY url, cik, year)"
FLAGS = (
    "flags AS (SELECT url, cik, year, "
    + ", ".join(f"CASE WHEN n_{t}_use > 0 AND n_curr > 0 THEN 1 ELSE 0 END AS model_{t}_user" for t in ("ir", "fx", "cp", "eq"))
    + ", "
    + ", ".join(f"CASE WHEN n_{x} > 0 AND n_curr > 0 THEN 1 ELSE 0 END AS model_{x}_user" for x in ("warr", "emb"))
    + ", CASE WHEN (n_ir_use > 0 OR n_fx_use > 0 OR n_cp_use > 0) AND n_curr > 0 THEN 1 ELSE 0 END AS model_user"
    + ", CASE WHEN n_ir_use + n_fx_use + n_cp_use + n_eq_use + n_gen_use + n_warr + n_emb > 0 THEN 1 ELSE 0 END AS model_user_all FROM counts)"
)
MODEL_COLUMNS = ("model_ir_user", "model_fx_user", "model_cp_user", "model_eq_user", "model_warr_user", "model_emb_user", "model_user", "model_user_all")
MODEL = "model AS (SELECT cik, year, " + ", ".join(f"max({c}) AS {c}" for c in MODEL_COLUMNS) + ", min(url) AS url FROM flags GROUP BY cik, year)"
KEYWORD = "keyword AS (SELECT doc_id % 37 AS cik, 2015 + doc_id % 7 AS year, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS \"user\", max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS ir_user, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS fx_user, max(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS cp_user FROM labels GROUP BY 1, 2)"
MERGED = "merged AS (SELECT * FROM model JOIN keyword USING (cik, year))"
BASE = f"WITH {PRED}, {COUNTS}, {FLAGS}, {MODEL}, {KEYWORD}, {MERGED}"
