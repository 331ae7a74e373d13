"""Registered queries of the subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filigrane.llm import bpe, decontam, mil, pii, quality_rules, secrets, simhash, simhash_sql, suffix, toxicity, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(_table(spark, sf_dir, "documents"), stored=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_secrets returns of the fixed kinds, which SQL can state."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_pii returns of the fixed kinds, which SQL can state."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _spans_sql(kinds: tuple[tuple[str, str, str], ...]) -> str:
    """SQL for counts and digest of (kind, pattern, condition on a match m), from the matches and the texts between them. Runs of hex digits are matched from 32 on, since shorter ones never count."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{name}' AS kind, m, s, e FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(gaps[1:i], lambda x: length(x)))))::BIGINT AS s, s + length(m) AS e FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM texts) WHERE len(ms) > 0) WHERE {condition}"
        for k, (name, pattern, condition) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name, _, _ in kinds)
    return f"WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({each}), found AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS joined FROM spans GROUP BY doc_id) SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name, _, _ in kinds)}, sha256(coalesce(joined, '')) AS base_sha256 FROM documents LEFT JOIN found USING (doc_id)"


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token")))
_ASSIGN = f"""({_NAMES}|{_either_case("api")}_?{_either_case("key")})["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT WHEN substr(reverse({_DIGITS}), i, 1)::INT > 4 THEN 2 * substr(reverse({_DIGITS}), i, 1)::INT - 9 ELSE 2 * substr(reverse({_DIGITS}), i, 1)::INT END)) % 10 = 0"
SECRETS_SQL = _spans_sql((("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"), ("hex", "[0-9a-f]{32,}", "true")))
PII_SQL = _spans_sql(
    (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND ('0' || right(x, 3))::INT <= 255))"),
        ("card", "[0-9]([ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    )
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_secrets": op2_secrets,
        "op3_pii": op3_pii,
        "op4_bpe": op4_bpe,
        "op5_decontam": op5_decontam,
        "op6_toxicity": op6_toxicity,
        "op7_wrapper": op7_wrapper,
        "op8_quality_rules": op8_quality_rules,
        "op9_suffix": op9_suffix,
        "op10_quality": op10_quality,
        "pipeline": corpus_pipeline.run,
        "secrets_base": secrets_base,
        "pii_base": pii_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "secrets_base": SECRETS_SQL,
        "pii_base": PII_SQL,
        "op1_simhash": simhash_sql.oracle(),
        "op5_decontam": decontam.ORACLE,
        "op8_quality_rules": quality_rules.oracle(),
        "op9_suffix": suffix.ORACLE,
    }
