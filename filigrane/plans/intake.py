"""Queries of intake: submissions, failures, registries, keywords and the wording of categories."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from filigrane.functions import text
from filigrane.functions.taxonomy import FINANCE, WORDINGS, Wording
from filigrane.operators import report, sample
from filigrane.operators.registry import Registry, Sheet
from filigrane.plans.catalog import _FILINGS_SQL, filing_columns, query
from filigrane.plans.demo import table
from filigrane.sources import tables


@query(_FILINGS_SQL)
def submitted_filings(spark, sf_dir):
    """Filings from JSON: the even orders of a customer in its own submissions, the others in an older file that these name."""
    columns = filing_columns(spark, sf_dir)
    names = (("form", "form"), ("accessionNumber", "accession"), ("primaryDocument", "document"), ("filingDate", "filed"), ("reportDate", "reported"))
    every = F.arrays_zip(*[b for _, b in names])
    half = lambda k: F.filter(every, lambda x: F.replace(x["accession"], F.lit("-"), F.lit("")).cast("long") % 2 == k)
    arrays = lambda part: F.struct(*[part[b].alias(a) for a, b in names])
    file = F.concat(F.lit("CIK"), F.col("cik").cast("string"), F.lit("-submissions-001.json"))
    parts = columns.select("cik", "name", file.alias("file"), half(0).alias("new"), half(1).alias("old"))
    body = F.to_json(F.struct("name", F.array().cast("array<string>").alias("tickers"), F.struct(arrays(F.col("new")).alias("recent"), F.array(F.struct(F.col("file").alias("name"))).alias("files")).alias("filings")))
    firms = parts.select("cik", body.alias("body"))
    older = parts.select("file", F.to_json(arrays(F.col("old"))).alias("body"))
    broken = spark.createDataFrame([(-1, None), (-2, "<html>429</html>")], "cik long, body string")
    return tables.submitted_filings(firms.select(F.col("cik").cast("long").alias("cik"), "body").unionByName(broken), older)


_RESPONSE = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'busy' WHEN 3 THEN '[]' ELSE '[{\"ir\": 0.5}]' END"
_REASON = "CASE o_orderkey % 7 WHEN 2 THEN 'not valid JSON' WHEN 3 THEN 'no predictions' ELSE 'no response' END"


def _results(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reports = o.select(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("year"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("url"))
    results = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("url"), F.expr(_RESPONSE).alias("server_response"))
    known = reports.where("cik % 10 = 0").withColumn("reason", F.lit("earlier"))
    return tables.accepted(results, "server_response", "array<map<string,double>>", reports, known)


@query(f"SELECT o_custkey AS cik, year(o_orderdate) AS year, 'o' || o_orderkey AS url, {_REASON} AS reason FROM orders WHERE o_orderkey % 7 < 4 AND o_custkey % 10 <> 0")
def failed_results(spark, sf_dir):
    return _results(spark, sf_dir)[1]


@query("SELECT 'o' || o_orderkey AS url, '[{\"ir\": 0.5}]' AS server_response FROM orders WHERE o_orderkey % 7 >= 4")
def accepted_results(spark, sf_dir):
    return _results(spark, sf_dir)[0]


@query("SELECT o_orderpriority AS book, o_orderstatus AS sheet, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT 'customers', 'in debt', count(*) FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0")
def registered_sheets(spark, sf_dir):
    """The sheets of a registry that have rows: orders by priority and status, customers in debt, and one that has none."""
    r = Registry()
    r.add_source("orders", table(spark, sf_dir, "orders"))
    r.add_source("customer", table(spark, sf_dir, "customer"))
    for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        for s in "FOP":
            r.add_sheet(Sheet(p, s, "orders", f"o_orderpriority = '{p}' AND o_orderstatus = '{s}'", ("o_orderkey", "o_totalprice"), ("o_custkey",)))
    r.add_sheet(Sheet("customers", "in debt", "customer", "c_acctbal < 0"))
    r.add_sheet(Sheet("customers", "nobody", "customer", "c_custkey < 0"))
    return r.summary()


_KEYWORDS = {"0": {"a": ["swap", "cap"], "b": ["cap", "floor"]}, "1": ["collar", "swap"], "2": {"c": ["lock"]}}


@query("SELECT doc_id, list_aggregate(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g') || ' swap cap floor collar lock', ' '), lambda w: w IN ('swap', 'cap', 'floor', 'collar', 'lock', 'the', 'license')))), 'string_agg', ',') AS words FROM documents")
def keyword_union(spark, sf_dir):
    """The keywords of nested and flat groups, and those that a document holds, as one set."""
    found = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "), " "), lambda w: w.isin("the", "license", *text.flat_keywords(_KEYWORDS)))
    known = F.array(*map(F.lit, text.flat_keywords(_KEYWORDS)))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.union_keywords(known, found, F.lit(None).cast("array<string>"))), ",").alias("words"))


# The wording of categories, over phrases made of its terms -----------------------------------------------


def spoken(term: str) -> list[str]:
    """The shortest and the longest text that a term matches."""
    out = []
    for last in (False, True):
        t = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and not last else m[1].split("|")[-1 if last else 0], term)
        t = re.sub(r"(.)\?", lambda m: m[1] if last else "", t)
        out.append(t.replace("[- ]", "-" if last else " "))
    return out


def phrases(w: Wording) -> list[str]:
    """A sentence for each head with a follower, for each form, and for each phrase."""
    out = []
    for i, head in enumerate(w.heads):
        follower = w.followers[i % len(w.followers)]
        for h, f, gap in zip(spoken(head), spoken(follower), (" ", "-"), strict=True):
            out.append(f"We hold {h}{gap}{f} now.")
            out += [f"We hold {h}{gap}{form}{gap}{f} now." for form in w.forms]
    return out + [f"Our {t.upper() if k else t} are known." for p in w.phrases for k, t in enumerate(spoken(p))]


PLAIN = ("we sold derivatives", "the option", "swaps of land", "interest rates were low", "currency", "equity", "a contract", "gasoline", "hedges", "the asset was sold", "designated assets")


def _plain_pattern(w: Wording) -> str:
    """The category's terms one after the other, without shared beginnings."""
    heads = [h + (f"[- ]{form}" if form else "") for h in w.heads for form in ("", *w.forms)]
    return r"(?i)\b(" + "|".join([f"({'|'.join(heads)})[- ]({'|'.join(w.followers)})", *w.phrases]) + r")\b"


_PHRASES = [p for w in WORDINGS.values() for p in phrases(w)] + [f"Here {p}." for p in PLAIN]


@query(
    "WITH p AS (SELECT unnest([" + ", ".join("'" + p.replace("'", "''") + "'" for p in _PHRASES) + f"]) AS phrase, unnest(range({len(_PHRASES)})) AS i), t AS (SELECT p_partkey, phrase FROM part JOIN p ON p_partkey % {len(_PHRASES)} = i) SELECT p_partkey, CASE "
    + " ".join(f"WHEN regexp_matches(phrase, '{_plain_pattern(w)}') THEN '{name}'" for name, w in WORDINGS.items())
    + " END AS category FROM t"
)
def category_finance(spark, sf_dir):
    """The category of a phrase for each part, over all heads, forms, followers and phrases of every category, and phrases of none."""
    said = F.get(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % len(_PHRASES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.first_category(said, FINANCE.categories).alias("category"))


@query("SELECT o_orderkey, regexp_matches(lower(o_orderpriority || ' ' || o_orderstatus || CASE o_orderkey % 4 WHEN 0 THEN ' Hedged' WHEN 1 THEN ' was Unwound' WHEN 2 THEN ' LOCKS' ELSE '' END), 'hedg|unwound|locks') AS allowed FROM orders")
def allowed_stems(spark, sf_dir):
    tail = F.expr("CASE o_orderkey % 4 WHEN 0 THEN ' Hedged' WHEN 1 THEN ' was Unwound' WHEN 2 THEN ' LOCKS' ELSE '' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.allowed(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", tail)).alias("allowed"))


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND NOT contains(lower(text), 'table of contents') AND NOT contains(lower(text), 'consolidated balance sheets')")
def unmarked_documents(spark, sf_dir):
    return text.without_markers(table(spark, sf_dir, "documents"), "text").select("doc_id", "lang", "source")


@query("SELECT conv_id, turn, coalesce(nullif(split_part(text, ', ', 1), ''), 'Irrelevant') AS label FROM conversations")
def first_labels(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", report.first_label(F.col("text")).alias("label"))


@query("SELECT s_suppkey, array_to_string(list_transform(string_split(lower(s_name || '. NEXT One. and ' || s_name), '. '), lambda s: upper(substr(s, 1, 1)) || substr(s, 2)), '. ') AS said FROM supplier")
def sentence_cased(spark, sf_dir):
    said = F.concat("s_name", F.lit(". NEXT One. and "), "s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.sentence_case(said).alias("said"))


@query("SELECT doc_id FROM documents WHERE NOT contains(lower(coalesce(text, '')), 'license') ORDER BY md5('42-' || doc_id), doc_id LIMIT 40")
def non_match_sample(spark, sf_dir):
    """The feature is a sample of a fixed size."""
    return sample.non_matches(table(spark, sf_dir, "documents"), F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("license")), "doc_id", 40).select("doc_id")


@query("SELECT c_name, c_custkey, c_acctbal, c_mktsegment, c_nationkey FROM customer")
def ordered_columns(spark, sf_dir):
    """Named columns first, then the others by name."""
    return report.priority_columns(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", "c_acctbal"), ["c_name", "c_custkey", "missing"])
