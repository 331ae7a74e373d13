"""Registry of the engine's queries over the driver's tables, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.functions import documents, text
from filigrane.functions.taxonomy import DEMO_CATEGORIES, FINANCE, NAMES, Taxonomy
from filigrane.operators import compare, flags, labels, matrix, report, sample
from filigrane.operators.labels import LABEL_THRESHOLD
from filigrane.plans import analysis, demo, generate, templates
from filigrane.plans.demo import BASE, COUNTS, FLAGS, KEYWORD, LABELS, MODEL_COLUMNS, PRED, table
from filigrane.sources import tables
from filigrane.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function by its name, with the SQL of its result if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


# Sources, scans and keyed writes ------------------------------------------------------------------


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def parse_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT cik, year, url FROM (SELECT o_custkey AS cik, year(o_orderdate) AS year, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'o' || o_orderkey END AS url FROM orders) WHERE url <> ''")
def valid_reports(spark, sf_dir):
    return tables.valid_reports(_reports(spark, sf_dir))


def _reports(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))).alias("url"))


@query("SELECT o_custkey AS cik, year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'P'")
def placeholder_reports(spark, sf_dir):
    return tables.valid_reports(_reports(spark, sf_dir), False).select("cik", "year")


@query("SELECT user_id AS k, event_id AS ver, event_type AS val FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("ver"), F.col("event_type").alias("val"))
    half = F.col("ver") % 2
    return tables.upsert(e.where(half == 0), e.where(half == 1), ["k"], "ver")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def insert_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.insert_missing(c, o, ["o_custkey"])


#: A firm's orders as the columns of its submissions.
_FORM = "CASE o_orderkey % 5 WHEN 0 THEN '10-K' WHEN 1 THEN '8-K' WHEN 2 THEN '20-F' WHEN 3 THEN '10-K405' ELSE '6-K' END"
_DOCUMENT = "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'c.txt' ELSE concat('d', o_orderkey, '.htm') END"
_FILINGS_SQL = f"""SELECT c_name AS name, c_custkey::VARCHAR AS ticker, {_FORM} AS type, o_orderdate::DATE::VARCHAR AS filing_date, o_orderdate::DATE::VARCHAR AS report_date,
    'https://www.sec.gov/Archives/edgar/data/' || c_custkey || '/' || lpad(o_orderkey::VARCHAR, 18, '0') || '/' || CASE WHEN {_DOCUMENT} = '' OR {_DOCUMENT} LIKE '%txt' THEN regexp_replace(lpad(o_orderkey::VARCHAR, 18, '0'), '^(.{{10}})(..)(.*)$', '\\1-\\2-\\3') || '.txt' ELSE {_DOCUMENT} END AS url
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_FORM} IN ('10-K', '20-F', '10-K405')"""


def filing_columns(spark, sf_dir) -> DataFrame:
    """(cik, name, ticker, form, accession, document, filed, reported): a customer's orders as parallel arrays."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    date = F.col("o_orderdate").cast("date").cast("string")
    one = F.struct(F.expr(_FORM).alias("form"), F.concat_ws("-", F.substring(number, 1, 10), F.substring(number, 11, 2), F.substring(number, 13, 6)).alias("accession"), F.expr(_DOCUMENT).alias("document"), date.alias("filed"), date.alias("reported"))
    by = o.groupBy(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name")).agg(F.collect_list(one).alias("x"))
    return by.select("cik", "name", F.lit(None).cast("string").alias("ticker"), *[F.col(f"x.{k}").alias(k) for k in ("form", "accession", "document", "filed", "reported")])


@query(_FILINGS_SQL)
def filings_explode(spark, sf_dir):
    return tables.filings(filing_columns(spark, sf_dir))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS report_date FROM orders WHERE o_orderdate::DATE::VARCHAR LIKE '1995%'")
def fiscal_year_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("report_date"))
    return tables.of_year(o, F.lit(1995))


@query("SELECT DISTINCT c_custkey AS cik, lpad(c_custkey::VARCHAR, 10, '0') AS padded, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS name FROM customer")
def clean_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"))
    return tables.clean_names(c).select("cik", text.padded_cik(F.col("cik")).alias("padded"), "name")


@query("""SELECT '<case num="' || doc_id || '"><sentence>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</sentence><label>' || lang || '</label></case>' AS value FROM documents WHERE text IS NOT NULL""")
def case_export(spark, sf_dir):
    return tables.case_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text", "lang")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 1 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def sql_passthrough(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return tables.execute(spark, f"SELECT event_type, count(*) AS n FROM parquet.`{path}` WHERE value > 1 GROUP BY event_type ORDER BY n DESC, event_type", 3)


# Labels ----------------------------------------------------------------------------------------------


@query(f"WITH {PRED} SELECT vec_id, {', '.join(LABELS)} FROM pred")
def probabilities(spark, sf_dir):
    return demo.predictions(spark, sf_dir).select("vec_id", *LABELS)


@query(f"WITH {PRED}, {COUNTS} SELECT * FROM counts")
def label_counts(spark, sf_dir):
    return demo.counts(spark, sf_dir)


def primary_sql(tax: Taxonomy = FINANCE, per_type: bool = False) -> str:
    t = LABEL_THRESHOLD
    types = tax.types
    top_use = "greatest(" + ", ".join(f"{s} + {s}_use" for s in tax.specific) + ")"
    top_context = "greatest(" + ", ".join(tax.specific) + ")"

    def resolved(top: str, score: Callable[[str], str], value: Callable[[str], object]) -> str:
        whens = " ".join(f"WHEN {score(s)} = {top} THEN {value(s)}" for s in tax.specific)
        return f"(CASE WHEN {top} < {t * 0.7} OR {top} <= 0 THEN {value('gen')} {whens} END)"

    any_use = "(" + " OR ".join(f"{k}_use >= {t}" for k in types) + ")"
    no_time = f"(curr < {t} AND hist < {t} AND spec < {t})"
    out: list[str] = []

    def add(condition: str, rank: str, score: str, label: object) -> None:
        out.append(f"SELECT vec_id, {rank} AS rank, {score} AS score, {len(out)} AS o, {label} AS id FROM pred WHERE {condition}")

    for k in types:
        pen = "0.0" if not per_type else resolved(top_use, lambda s: f"{s} + {s}_use", lambda s: tax.penalised.get(s, 0.0)) if k == "gen" else str(tax.penalised.get(k, 0.0))
        for i, time in enumerate(("curr", "hist", "spec")):
            label = tax.usage_ids[k][i] if k != "gen" else resolved(top_use, lambda s: f"{s} + {s}_use", lambda s, i=i: tax.usage_ids[s][i])
            add(f"{k}_use >= {t} AND {time} >= {t}", f"{i + 1} + {pen}" if time == "spec" else str(i + 1), f"{k}_use * {time}", label)
            if per_type:
                add(f"{k}_use < {t} AND {k} >= {t} AND {time} >= {t}", f"{6 if time == 'spec' else 5} + {pen}", f"{k} * {time}", label)
            elif time != "spec":
                add(f"NOT {any_use} AND spec < {t} AND {k} >= {t} AND {time} >= {t}", "5", f"{k} * {time}", label)
        add(f"{k}_use >= {t} AND {no_time}", f"1.5 + {pen}", f"{k}_use", tax.usage_ids[k][0] if k != "gen" else resolved(top_use, lambda s: f"{s} + {s}_use", lambda s: tax.usage_ids[s][0]))
    for x, (now, then) in tax.extra_ids.items():
        add(f"{x} >= {t} AND curr >= {t}", "4", f"{x} * curr", now)
        add(f"{x} >= {t} AND curr < {t}", "7", x, then)
    for k in types:
        rank = lambda s: 8.1 if s == "eq" else 8.0
        if k == "gen":
            add(f"NOT {any_use} AND gen >= {t}", resolved(top_context, str, rank), k, resolved(top_context, str, lambda s: tax.context_ids[s]))
        else:
            add(f"NOT {any_use} AND {k} >= {t}", str(rank(k)), k, tax.context_ids[k])
    add(f"irr >= {t}", "9", "irr", 24)
    return "cand AS (" + " UNION ALL ".join(out) + "), one AS (SELECT *, row_number() OVER (PARTITION BY vec_id, id ORDER BY rank, score DESC, o) AS r FROM cand), best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY rank, score DESC, o) AS place FROM one WHERE r = 1), prim AS (SELECT pred.*, coalesce(id, 24)::INTEGER AS primary_id, coalesce(score, 0.0) AS primary_score FROM pred LEFT JOIN (SELECT vec_id, id, score FROM best WHERE place = 1) USING (vec_id))"


PRIMARY = primary_sql()
_NAME_CASE = "CASE primary_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in NAMES.items()) + " END"


def _resolved(spark, sf_dir):
    return labels.resolve(demo.predictions(spark, sf_dir))


@query(f"WITH {PRED}, {PRIMARY} SELECT vec_id, primary_id, round(primary_score, 6) AS primary_score, {_NAME_CASE} AS label, replace(split_part({_NAME_CASE}, ' (', 1), ' ', '_') AS category FROM prim")
def primary_label(spark, sf_dir):
    d = _resolved(spark, sf_dir)
    name = labels.name_of(F.col("primary_id"))
    return d.select("vec_id", "primary_id", F.round("primary_score", 6).alias("primary_score"), name.alias("label"), labels.category_of(name).alias("category"))


@query(f"WITH {PRED}, {PRIMARY} SELECT vec_id, coalesce(ids, '24') AS ids FROM pred LEFT JOIN (SELECT vec_id, string_agg(id::VARCHAR, ',' ORDER BY place) AS ids FROM best GROUP BY vec_id) USING (vec_id)")
def all_labels(spark, sf_dir):
    return _resolved(spark, sf_dir).select("vec_id", F.array_join(F.transform("label_ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH {PRED}, {PRIMARY} SELECT CASE WHEN primary_score >= 0.75 THEN 'high' WHEN primary_score >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM prim GROUP BY 1")
def confidence_tier(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


def _hot_sql() -> str:
    on = lambda k: f"{k} >= 0.45"
    rules = []
    for x, (now, then) in FINANCE.extra_ids.items():
        rules += [(f"{on(x)} AND {on('hist')}", then), (on(x), now)]
    for t in FINANCE.types:
        rules += [(f"{on(t + '_use')} AND {on(time)}", FINANCE.usage_ids[t][i]) for i, time in enumerate(FINANCE.times)] + [(on(t + "_use"), FINANCE.usage_ids[t][0])]
    rules += [(f"{on(t)} AND {on('spec')}", FINANCE.usage_ids[t][2]) for t in FINANCE.types] + [(on(t), FINANCE.context_ids[t]) for t in FINANCE.types]
    return "CASE " + " ".join(f"WHEN {c} THEN {i}" for c, i in rules) + " ELSE 24 END"


@query(f"WITH {PRED} SELECT vec_id, {_hot_sql()} AS label FROM pred")
def generator_primary(spark, sf_dir):
    return labels.binary(demo.predictions(spark, sf_dir)).select("vec_id", labels.multi_hot_primary().alias("label"))


@query("SELECT vec_id, CASE WHEN embedding[6] > 0 AND NOT embedding[5] > 0 THEN 5 WHEN embedding[5] > 0 AND NOT embedding[6] > 0 THEN 4 WHEN embedding[1] > 0 THEN 0 WHEN embedding[2] > 0 THEN 2 WHEN embedding[7] > 0 THEN 3 ELSE 6 END AS label FROM embeddings")
def bargaining_primary(spark, sf_dir):
    from filigrane.functions.taxonomy import BARGAINING_LABELS

    v = table(spark, sf_dir, "embeddings").select("vec_id", *[(F.get("embedding", F.lit(i)) > 0).cast("int").alias(k) for i, k in enumerate(BARGAINING_LABELS)])
    return v.select("vec_id", labels.bargaining_primary().alias("label"))


@query("SELECT vec_id, list_position(x, list_max(x)) - 1 AS label FROM (SELECT vec_id, list_slice(embedding, 1, 17) AS x FROM embeddings)")
def argmax_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", labels.argmax_label(F.slice("embedding", 1, 17)).alias("label"))


@query("WITH x AS (SELECT vec_id, unnest(list_slice(embedding, 1, 8))::DOUBLE * 20 AS v, unnest(range(8)) AS i FROM embeddings), s AS (SELECT vec_id, i, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM x) SELECT vec_id, coalesce(string_agg(CASE WHEN p > 0.5 THEN i::VARCHAR END, ','), '') AS labels FROM s GROUP BY vec_id")
def softmax_labels(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 20).alias("x"))
    return v.select("vec_id", F.array_join(F.transform(labels.softmax_above(F.col("x")), lambda i: i.cast("string")), ",").alias("labels"))


@query(f"WITH {PRED} SELECT url, year, n, CASE WHEN n = 1 THEN ir ELSE fx END AS ir, CASE WHEN n = 1 THEN 0.0 ELSE curr END AS curr FROM (SELECT vec_id, 'v' || vec_id AS url, year, ir, fx, curr, unnest([1, 3]) AS n FROM pred)")
def prediction_json(spark, sf_dir):
    d = demo.predictions(spark, sf_dir)
    maps = F.array(F.create_map(F.lit("ir"), F.col("ir")), F.create_map(F.lit("error"), F.lit(-1.0)), F.create_map(F.lit("ir"), F.col("fx"), F.lit("curr"), F.col("curr")))
    packed = d.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("url"), "year", F.to_json(maps).alias("server_response"))
    return labels.from_maps(packed, "server_response").select("url", "year", "n", "ir", "curr")


# Flags and comparison -----------------------------------------------------------------------------


@query(f"WITH {PRED}, {COUNTS}, {FLAGS} SELECT * FROM flags")
def report_flags(spark, sf_dir):
    return flags.report_flags(demo.counts(spark, sf_dir))


@query(f"{BASE} SELECT cik, year, {', '.join(MODEL_COLUMNS)}, url FROM model")
def firm_year_flags(spark, sf_dir):
    return demo.model(spark, sf_dir)


@query(f'WITH {KEYWORD} SELECT cik, year, "user", ir_user, fx_user, cp_user FROM keyword')
def keyword_flags(spark, sf_dir):
    return demo.keyword(spark, sf_dir)


def _confusion_sql() -> str:
    one = lambda c: f"""SELECT '{c.name}' AS category, sum(CASE WHEN "{c.truth}" = 1 AND {c.guess} = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN "{c.truth}" = 0 AND {c.guess} = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN "{c.truth}" = 0 AND {c.guess} = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN "{c.truth}" = 1 AND {c.guess} = 0 THEN 1 ELSE 0 END)::BIGINT AS fn, count(*) AS total FROM merged"""
    return "conf AS (" + " UNION ALL ".join(one(c) for c in compare.COMPARISONS) + ")"


CONFUSION = _confusion_sql()
_METRICS = "round(coalesce((tp + tn) / nullif(total::DOUBLE, 0), 0) * 100, 2) AS accuracy, round(coalesce(tp / nullif((tp + fp)::DOUBLE, 0), 0) * 100, 2) AS precision, round(coalesce(tp / nullif((tp + fn)::DOUBLE, 0), 0) * 100, 2) AS recall, round(coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0) * 100, 2) AS f1"


@query(f"{BASE}, {CONFUSION} SELECT *, {_METRICS} FROM conf")
def metrics_summary(spark, sf_dir):
    return compare.metrics(compare.confusion(demo.merged(spark, sf_dir)))


for _c in compare.COMPARISONS:

    def _cross(spark, sf_dir, c=_c):
        return compare.cross_tab(demo.merged(spark, sf_dir), c.truth, c.guess)

    _cross.__name__ = f"confusion_{_c.slug}"
    query(f"""{BASE} SELECT CASE WHEN grouping("{_c.truth}") = 1 THEN 'All' WHEN "{_c.truth}" = 1 THEN 'Keyword_Yes' ELSE 'Keyword_No' END AS keyword, CASE WHEN grouping({_c.guess}) = 1 THEN 'All' WHEN {_c.guess} = 1 THEN 'Model_Yes' ELSE 'Model_No' END AS model, count(*) AS n FROM merged GROUP BY CUBE ("{_c.truth}", {_c.guess})""")(_cross)


def _detail_sql(c: compare.Comparison) -> str:
    return f"""CASE WHEN "{c.truth}" = {c.guess} THEN 0 WHEN {c.guess} = 1 THEN 1 ELSE -1 END AS agree_{c.slug}, CASE WHEN "{c.truth}" = 1 AND {c.guess} = 1 THEN 'True Positive' WHEN "{c.truth}" = 0 AND {c.guess} = 0 THEN 'True Negative' WHEN {c.guess} = 1 THEN 'False Positive' ELSE 'False Negative' END AS class_{c.slug}"""


@query(f"{BASE} SELECT cik, year, {', '.join(map(_detail_sql, compare.COMPARISONS))} FROM merged")
def detailed(spark, sf_dir):
    names = [n for c in compare.COMPARISONS for n in (f"agree_{c.slug}", f"class_{c.slug}")]
    return compare.detailed(demo.merged(spark, sf_dir)).select("cik", "year", *names)


@query(f'{BASE} SELECT cik, year, url FROM merged WHERE "user" = 0 AND model_user_all = 1')
def model_only(spark, sf_dir):
    return compare.model_only(demo.merged(spark, sf_dir)).select("cik", "year", "url")


@query(f"{BASE} " + " UNION ALL ".join(f"SELECT '{k}' AS flag, sum({k})::BIGINT AS positive, sum(1 - {k})::BIGINT AS negative, count(*) AS total, round(sum({k}) * 100.0 / count(*), 2) AS rate FROM model" for k in MODEL_COLUMNS))
def model_stats(spark, sf_dir):
    return compare.positive_stats(demo.model(spark, sf_dir), list(MODEL_COLUMNS))


@query(f"{BASE} SELECT coalesce(m.cik, k.cik) AS cik, coalesce(m.year, k.year) AS year, coalesce(model_user, 0) AS model_user, coalesce(\"user\", 0) AS \"user\" FROM model m FULL OUTER JOIN keyword k ON m.cik = k.cik AND m.year = k.year")
def outer_merge(spark, sf_dir):
    return demo.merged(spark, sf_dir, "full_outer").select("cik", "year", "model_user", "user")


# Speculation: sentences with spec against sentences with use in the present, by firm-year.
_SPEC = "spec AS (SELECT cik, year, " + ", ".join(f"max(CASE WHEN {t} >= 0.45 AND spec >= 0.45 THEN 1 ELSE 0 END) AS spec_{t}, max(CASE WHEN {t}_use >= 0.45 AND curr >= 0.45 THEN 1 ELSE 0 END) AS actual_{t}, max(CASE WHEN {t}_use >= 0.45 AND (curr >= 0.45 OR hist >= 0.45) THEN 1 ELSE 0 END) AS ever_{t}" for t in FINANCE.types) + " FROM pred GROUP BY cik, year)"


def _speculation(spark, sf_dir):
    d = demo.predictions(spark, sf_dir)
    on = lambda k: F.col(k) >= 0.45
    made = []
    for t in FINANCE.types:
        made += [F.max((on(t) & on("spec")).cast("int")).alias(f"spec_{t}"), F.max((on(f"{t}_use") & on("curr")).cast("int")).alias(f"actual_{t}"), F.max((on(f"{t}_use") & (on("curr") | on("hist"))).cast("int")).alias(f"ever_{t}")]
    return d.groupBy("cik", "year").agg(*made)


@query(f"WITH {PRED}, {_SPEC} " + " UNION ALL ".join(f"SELECT '{t}' AS category, sum(spec_{t})::BIGINT AS speculative, sum(spec_{t} * actual_{t})::BIGINT AS actual, sum(spec_{t} * (1 - actual_{t}))::BIGINT AS not_actual, round(coalesce(sum(spec_{t} * actual_{t}) * 100.0 / nullif(sum(spec_{t}), 0), 0), 2) AS rate FROM spec" for t in FINANCE.types))
def translation_summary(spark, sf_dir):
    return compare.translation(_speculation(spark, sf_dir), {t: (f"spec_{t}", f"actual_{t}") for t in FINANCE.types})


_KEYS = {"IR": ("ir_user", "spec_ir"), "FX": ("fx_user", "spec_fx"), "CP": ("cp_user", "spec_cp"), "EQ": ("user", "spec_eq"), "GEN": ("user", "spec_gen")}


@query(f"WITH {PRED}, {KEYWORD}, {_SPEC}, j AS (SELECT * FROM spec JOIN keyword USING (cik, year)) " + " UNION ALL ".join(f"""SELECT '{n}' AS category, sum("{k}" * (1 - {s}))::BIGINT AS keyword_only, sum("{k}" * {s})::BIGINT AS both, sum((1 - "{k}") * {s})::BIGINT AS spec_only, sum((1 - "{k}") * (1 - {s}))::BIGINT AS neither FROM j""" for n, (k, s) in _KEYS.items()))
def keyword_vs_spec(spark, sf_dir):
    return compare.keyword_against_speculation(compare.merge(_speculation(spark, sf_dir), demo.keyword(spark, sf_dir)), _KEYS)


@query(f"WITH {PRED}, {_SPEC} SELECT cik, year, " + ", ".join(f"CASE WHEN spec_{t} = 1 AND actual_{t} = 1 THEN 'Spec->Actual' WHEN spec_{t} = 1 THEN 'Spec->NoActual' WHEN actual_{t} = 1 THEN 'NoSpec->Actual' ELSE 'NoSpec->NoActual' END AS class_{t}" for t in FINANCE.types) + " FROM spec")
def spec_classes(spark, sf_dir):
    return _speculation(spark, sf_dir).select("cik", "year", *[compare.spec_to_actual(f"spec_{t}", f"actual_{t}").alias(f"class_{t}") for t in FINANCE.types])


def _two_sql(guess: str) -> str:
    rows = " UNION ALL ".join(f"""SELECT '{n}' AS category, sum(k * g) AS tp, sum((1 - k) * g) AS fp, sum((1 - k) * (1 - g)) AS tn, sum(k * (1 - g)) AS fn, count(*) AS total FROM (SELECT "{k}" AS k, {guess}_{t} AS g FROM j)""" for n, k, t in (("IR", "ir_user", "ir"), ("FX", "fx_user", "fx"), ("CP", "cp_user", "cp")))
    return f"(SELECT category, {_METRICS} FROM ({rows}))"


@query(f"WITH {PRED}, {KEYWORD}, {_SPEC}, j AS (SELECT * FROM spec JOIN keyword USING (cik, year)), a AS {_two_sql('actual')}, b AS {_two_sql('ever')} SELECT a.category, " + ", ".join(f"a.{m} AS {m}_before, b.{m} AS {m}_after, round(b.{m} - a.{m}, 2) AS {m}_gain" for m in ("accuracy", "precision", "recall", "f1")) + " FROM a JOIN b ON a.category = b.category")
def current_vs_all(spark, sf_dir):
    j = compare.merge(_speculation(spark, sf_dir), demo.keyword(spark, sf_dir))
    of = lambda kind: compare.metrics(compare.confusion(j, tuple(compare.Comparison(t.upper(), f"{t}_user", f"{kind}_{t}") for t in ("ir", "fx", "cp"))))
    return compare.delta(of("actual"), of("ever"), "category", ["accuracy", "precision", "recall", "f1"])


@query("WITH x AS (SELECT t.doc_id, quality AS t, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS g FROM labels t JOIN documents USING (doc_id)), c AS (SELECT c, (SELECT count(*) FROM x WHERE t = c) AS t, (SELECT count(*) FROM x WHERE g = c) AS g, (SELECT count(*) FROM x WHERE g = c AND t = c) AS h FROM (VALUES (0), (1)) v(c)) SELECT round(sum(coalesce(h / nullif(g::DOUBLE, 0), 0) * t) / sum(t), 4) AS precision, round(sum(coalesce(h / nullif(t::DOUBLE, 0), 0) * t) / sum(t), 4) AS recall, round(sum(coalesce(2 * h / nullif((t + g)::DOUBLE, 0), 0) * t) / sum(t), 4) AS f1 FROM c")
def weighted_scores(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return compare.weighted_scores(j.select(F.col("quality").alias("t"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("g")), "t", "g")


@query("WITH x AS (SELECT toxic AS t, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT t, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS r FROM x) SELECT round((sum(CASE WHEN t = 1 THEN r ELSE 0 END) - sum(t)::DOUBLE * (sum(t) + 1) / 2) / (sum(t)::DOUBLE * sum(1 - t)), 6) AS auc FROM r")
def roc_auc(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return compare.roc_auc(j, "toxic", "n_chars")


@query("WITH x AS (SELECT quality AS qt, toxic AS xt, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS qs, CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END AS xs FROM labels JOIN documents USING (doc_id)), y AS (SELECT (sum(qt * qs) + sum(xt * xs))::BIGINT AS tp, (sum((1 - qt) * qs) + sum((1 - xt) * xs))::BIGINT AS fp, (sum(qt * (1 - qs)) + sum(xt * (1 - xs)))::BIGINT AS fn, sum(CASE WHEN qt = qs AND xt = xs THEN 1 ELSE 0 END) AS e, count(*) AS n FROM x) SELECT tp, fp, fn, round(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0) * 100, 2) AS f1_micro, round(e / n::DOUBLE * 100, 2) AS exact_match FROM y")
def multi_label_scores(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    long = lambda n: F.when(F.col("n_chars") > n, 1.0).otherwise(0.0)
    return compare.multi_label_scores(j.select(F.col("quality").alias("q_truth"), F.col("toxic").alias("x_truth"), long(500).alias("q_score"), long(3000).alias("x_score")), ["q", "x"])


@query(f"""{BASE}, {CONFUSION} SELECT trim(regexp_replace(category, '\\s*\\(.*\\)', '')) AS category, f AS file, total, accuracy FROM (SELECT *, {_METRICS} FROM conf), (SELECT unnest(['a', 'b']) AS f)""")
def metrics_union(spark, sf_dir):
    m = compare.metrics(compare.confusion(demo.merged(spark, sf_dir))).select("category", "total", "accuracy")
    return compare.metrics_union({"a": m, "b": m})


# Matrices and selections --------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    return _resolved(spark, sf_dir).select("vec_id", "url", "cik", "year", "primary_id")


HISTOGRAM = f"{PRED}, {PRIMARY}, hist_t AS (SELECT url, cik, year, count(*) AS total, " + ", ".join(f"sum(CASE WHEN primary_id = {i} THEN 1 ELSE 0 END)::BIGINT AS count_{i}" for i in NAMES) + " FROM prim GROUP BY url, cik, year)"


@query(f"WITH {HISTOGRAM} SELECT * FROM hist_t")
def label_histogram(spark, sf_dir):
    return matrix.label_histogram(_labelled(spark, sf_dir), ["url", "cik", "year"], "primary_id", list(NAMES))


@query(f"WITH {HISTOGRAM} SELECT year, label, count(DISTINCT cik) AS firms FROM (UNPIVOT hist_t ON {', '.join(f'count_{i}' for i in NAMES)} INTO NAME label VALUE v) WHERE v > 0 GROUP BY year, label")
def unique_firms(spark, sf_dir):
    return matrix.unique_firms(label_histogram(spark, sf_dir), [f"count_{i}" for i in NAMES])


@query(f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum(CASE WHEN {a} >= 0.45 AND {b} >= 0.45 THEN 1 ELSE 0 END)::BIGINT AS n FROM pred" for a in LABELS for b in LABELS))
def cooccurrence(spark, sf_dir):
    return matrix.co_occurrence(labels.binary(demo.predictions(spark, sf_dir)), list(LABELS))


_GROUPS = {"ir": ["count_3", "count_4"], "fx": ["count_6", "count_7"], "cp": ["count_9", "count_10"], "gen": ["count_0", "count_1"]}


@query(f"WITH {HISTOGRAM}, firm AS (SELECT cik, " + ", ".join(f"max(greatest({', '.join(c)})) > 0 AS {k}" for k, c in _GROUPS.items()) + " FROM hist_t GROUP BY cik) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum(CASE WHEN {a} AND {b} THEN 1 ELSE 0 END)::BIGINT AS n FROM firm" for a in _GROUPS for b in _GROUPS))
def hedge_cross(spark, sf_dir):
    return matrix.type_cross(label_histogram(spark, sf_dir), _GROUPS)


@query(f"WITH {HISTOGRAM} " + " UNION ALL ".join(f"SELECT h.url, h.cik, h.year, '{k}' AS hedge_type FROM hist_t h SEMI JOIN (SELECT cik, year FROM hist_t GROUP BY cik, year HAVING sum({' + '.join(c)}) > 0) USING (cik, year)" for k, c in _GROUPS.items()))
def hedge_by_type(spark, sf_dir):
    return matrix.rows_by_type(label_histogram(spark, sf_dir), _GROUPS).select("url", "cik", "year", "hedge_type")


_HISTORIC, _CURRENT, _SPECULATIVE = (" + ".join(f"count_{i + k}" for i in (0, 3, 6, 9, 12)) for k in (1, 0, 2))


@query(f"WITH {HISTOGRAM} SELECT url, cik, year FROM hist_t WHERE url IN (SELECT url FROM hist_t GROUP BY url HAVING sum({_HISTORIC}) > 0 AND sum({_CURRENT}) < 3)")
def historic_only(spark, sf_dir):
    return matrix.firms_where(label_histogram(spark, sf_dir), F.expr(f"sum({_HISTORIC}) > 0 AND sum({_CURRENT}) < 3"), "url").select("url", "cik", "year")


@query(f"WITH {HISTOGRAM} SELECT url, cik, year FROM hist_t WHERE url IN (SELECT url FROM hist_t GROUP BY url HAVING sum({_SPECULATIVE}) > 0 AND sum({_HISTORIC}) = 0)")
def speculative_only(spark, sf_dir):
    return matrix.firms_where(label_histogram(spark, sf_dir), F.expr(f"sum({_SPECULATIVE}) > 0 AND sum({_HISTORIC}) = 0"), "url").select("url", "cik", "year")


@query(f"WITH {HISTOGRAM} SELECT url, cik, year FROM hist_t WHERE url IN (SELECT url FROM hist_t GROUP BY url HAVING sum({_SPECULATIVE}) > 0 AND sum(total - ({_SPECULATIVE})) < 100 * sum({_SPECULATIVE}))")
def speculation_heavy(spark, sf_dir):
    return matrix.firms_where(label_histogram(spark, sf_dir), F.expr(f"sum({_SPECULATIVE}) > 0 AND sum(total - ({_SPECULATIVE})) < 100 * sum({_SPECULATIVE})"), "url").select("url", "cik", "year")


@query(f"WITH {HISTOGRAM} SELECT url, count_20 + count_21 AS warrants, count_22 + count_23 AS embedded FROM hist_t WHERE count_20 + count_21 > 0 OR count_22 + count_23 > 0")
def liabilities_embedded(spark, sf_dir):
    h = label_histogram(spark, sf_dir)
    w, e = F.col("count_20") + F.col("count_21"), F.col("count_22") + F.col("count_23")
    return h.where((w > 0) | (e > 0)).select("url", w.alias("warrants"), e.alias("embedded"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, year(o_orderdate)) NOT IN (SELECT o_custkey, year(o_orderdate) FROM orders WHERE o_orderstatus = 'F')")
def not_processed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    return matrix.not_yet(o, o.where("o_orderstatus = 'F'"), ["o_custkey", "year"]).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_shipmode FROM (SELECT l_orderkey, l_linenumber, o_orderpriority AS l_shipmode, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def three_way_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = matrix.keyed(table(spark, sf_dir, "orders"), c, ["o_custkey"]).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("l_shipmode"))
    return table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "l_shipmode")


@query("WITH v AS (SELECT n_chars::DOUBLE AS v FROM documents), s AS (SELECT min(v) AS lo, max(v) AS hi FROM v) SELECT least(100, floor(coalesce((v - lo) * 100 / nullif(hi - lo, 0), 0))::INTEGER + 1) AS bin, count(*) AS n FROM v, s GROUP BY 1")
def length_histogram(spark, sf_dir):
    return matrix.width_histogram(table(spark, sf_dir, "documents"), F.col("n_chars"), 100)


@query("SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.25), 4) AS q25, round(quantile_cont(n_chars, 0.5), 4) AS q50, round(quantile_cont(n_chars, 0.75), 4) AS q75, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS spread, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang")
def describe_length(spark, sf_dir):
    n = F.col("n_chars")
    quantiles = [F.round(F.percentile(n, F.lit(q / 100)), 4).alias(f"q{q}") for q in (25, 50, 75)]
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), *quantiles, F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev_samp(n), 4).alias("spread"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("SELECT o_custkey AS cik, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') AS years FROM orders GROUP BY o_custkey")
def years_by_firm(spark, sf_dir):
    years = F.array_sort(F.collect_set(F.year("o_orderdate")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"))


# Reports ------------------------------------------------------------------------------------------


_TOP_SQL = f"l AS (SELECT vec_id, unnest([{', '.join(LABELS)}]) AS s, unnest([{', '.join(chr(39) + k + chr(39) for k in LABELS)}]) AS k, unnest(range(16)) AS i FROM pred), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS p FROM l), tops AS (SELECT vec_id, string_agg(k || ':' || format('{{:.3f}}', s), ', ' ORDER BY p) AS top FROM r WHERE p <= 5 GROUP BY vec_id)"


def names_sql(sep: str) -> str:
    """All labels of a sentence by name, best first."""
    return f"names AS (SELECT vec_id, string_agg({_NAME_CASE.replace('primary_id', 'id')}, '{sep}' ORDER BY place) AS labels FROM best GROUP BY vec_id)"


def active_sql(sep: str) -> str:
    return f"concat_ws('{sep}', {', '.join(f'CASE WHEN {k} >= {LABEL_THRESHOLD} THEN {chr(39)}{k}{chr(39)} END' for k in LABELS)})"


@query(
    f"WITH {PRED}, {PRIMARY}, {_TOP_SQL}, {names_sql(', ')} SELECT vec_id, url, cik, year, primary_id, {_NAME_CASE} AS primary_label, round(primary_score, 6) AS primary_score, CASE WHEN primary_score >= 0.75 THEN 'high' WHEN primary_score >= 0.5 THEN 'medium' ELSE 'low' END AS tier, coalesce(labels, 'Irrelevant Non-Hedge') AS labels, {active_sql('; ')} AS active, top, "
    + ", ".join(f"{k} AS prob_{k}" for k in LABELS)
    + " FROM prim LEFT JOIN names USING (vec_id) JOIN tops USING (vec_id)"
)
def labeled_sentences(spark, sf_dir):
    return report.labelled_sentences(demo.predictions(spark, sf_dir), ["vec_id", "url", "cik", "year"], LABEL_THRESHOLD)


@query(f"WITH {PRED}, {_TOP_SQL} SELECT vec_id, top FROM tops")
def top5(spark, sf_dir):
    return demo.predictions(spark, sf_dir).select("vec_id", report.top_scores().alias("top"))


def _group_rows() -> str:
    return " UNION ALL ".join(f"SELECT '{g}' AS label_group, primary_id, cik, url, year FROM prim WHERE primary_id IN ({', '.join(map(str, ids))})" for g, ids in report.GROUPS.items() if ids)


@query(f"WITH {PRED}, {PRIMARY}, g AS ({_group_rows()}), s AS (SELECT label_group, coalesce(primary_id::VARCHAR, 'TOTAL') AS label, count(*) AS total, count(DISTINCT cik) AS firms, count(DISTINCT url) AS urls, min(year) AS first_year, max(year) AS last_year FROM g GROUP BY GROUPING SETS ((label_group, primary_id), (label_group))) SELECT s.label_group, label, total, round(total * 100.0 / t.n, 2) AS pct_of_group, firms, urls, round(total / firms::DOUBLE, 2) AS per_firm, round(total / urls::DOUBLE, 2) AS per_url, first_year, last_year FROM s JOIN (SELECT label_group, count(*) AS n FROM g GROUP BY label_group) t ON s.label_group = t.label_group")
def group_summary(spark, sf_dir):
    return report.group_summary(_labelled(spark, sf_dir), "primary_id", "cik", "url", "year")


@query(f"WITH {PRED}, {PRIMARY} SELECT primary_id AS label_id, {_NAME_CASE} AS label, count(*) AS total, round(count(*) * 100.0 / (SELECT count(*) FROM prim), 2) AS pct_of_total FROM prim GROUP BY primary_id")
def overall_summary(spark, sf_dir):
    return report.overall_summary(_labelled(spark, sf_dir), "primary_id")


@query(
    f"WITH {PRED}, {PRIMARY}, m AS (SELECT url, cik, year, primary_id, row_number() OVER (PARTITION BY url, cik, year ORDER BY count(*) DESC, primary_id) AS r FROM prim GROUP BY url, cik, year, primary_id), s AS (SELECT url, cik, year, count(*) AS sentences, "
    + ", ".join(f"sum(CASE WHEN {t}_use >= {LABEL_THRESHOLD} AND curr >= {LABEL_THRESHOLD} THEN 1 ELSE 0 END)::BIGINT AS {t}_current_use" for t in FINANCE.types)
    + f", sum(CASE WHEN greatest({', '.join(f'{t}_use' for t in FINANCE.types)}) >= {LABEL_THRESHOLD} AND curr >= {LABEL_THRESHOLD} THEN 1 ELSE 0 END)::BIGINT AS any_current_use, "
    + ", ".join(f"sum(CASE WHEN primary_id = {i} THEN 1 ELSE 0 END)::BIGINT AS count_{i}" for i in NAMES)
    + " FROM prim GROUP BY url, cik, year) SELECT s.*, m.primary_id AS mode_label FROM s JOIN m USING (url, cik, year) WHERE m.r = 1"
)
def inspector_summary(spark, sf_dir):
    return report.inspection(demo.predictions(spark, sf_dir), ["url", "cik", "year"], LABEL_THRESHOLD)


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS block FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def sentence_block(spark, sf_dir):
    return report.sentence_block(table(spark, sf_dir, "conversations").where("role <> 'system'"), ["conv_id"], "turn", "text")


@query("SELECT s_suppkey, substr(regexp_replace('a/b:' || s_name || '*' || s_name, '[\\[\\]:*?/\\\\]', '_', 'g'), 1, 31) AS sheet FROM supplier")
def sheet_names(spark, sf_dir):
    n = F.concat(F.lit("a/b:"), F.col("s_name"), F.lit("*"), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", report.sheet_name(n).alias("sheet"))


@query("WITH a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations), b AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS i FROM conversations WHERE turn > 0) SELECT conv_id, i AS place, text AS sentence, role AS pred FROM a JOIN b USING (conv_id, i)")
def paired_by_place(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    in_order = lambda col, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", col)))), lambda x: x[col])
    lists = c.groupBy("conv_id").agg(in_order("text", F.lit(True)).alias("a"), in_order("role", F.col("turn") > 0).alias("b"))
    return lists.select("conv_id", F.posexplode(report.paired(F.col("a"), F.col("b"))).alias("i", "x")).select("conv_id", (F.col("i") + 1).cast("long").alias("place"), "x.sentence", "x.pred")


@query(f"{BASE} SELECT cik, year, '' AS reviewer_label, '' AS reviewer_note, {', '.join(sorted(MODEL_COLUMNS))} FROM model")
def review_sheet(spark, sf_dir):
    return report.review_sheet(demo.model(spark, sf_dir), ["cik", "year"])


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN (props::JSON->>'k')::BIGINT ELSE 0 END AS c, CASE WHEN event_type = 'view' THEN (props::JSON->>'k')::BIGINT ELSE 0 END AS v FROM events")
def label_vector(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.create_map("event_type", F.from_json("props", "k long")["k"])
    return e.select("event_id", report.label_vector(m, ("click", "view")).alias("x")).select("event_id", F.get("x", F.lit(0)).alias("c"), F.get("x", F.lit(1)).alias("v"))


@query("SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k, sum(CASE WHEN (props::JSON->>'k')::BIGINT > 3 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY event_type")
def json_sums(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string,long>")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("k") > 3).alias("large"))


@query("SELECT 'S' || s_suppkey || chr(9) || s_name AS value FROM supplier")
def text_export(spark, sf_dir):
    return tables.text_lines(table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("k"), "s_name"), ["k", "s_name"])


@query("SELECT s_suppkey, CASE WHEN n_nationkey IS NULL THEN s_name ELSE n_name END AS s_name FROM supplier LEFT JOIN nation ON s_suppkey = n_nationkey")
def updated_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return tables.update(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), n, ["s_suppkey"])


# Samples --------------------------------------------------------------------------------------------

_ORDER = "md5('42-' || vec_id)"


@query(f"WITH {PRED}, {PRIMARY} SELECT vec_id, primary_id FROM (SELECT *, row_number() OVER (PARTITION BY primary_id ORDER BY {_ORDER}, vec_id) AS r FROM prim) WHERE r <= 50")
def accuracy_sample(spark, sf_dir):
    return sample.stratified(_labelled(spark, sf_dir), ["primary_id"], "vec_id", 50).select("vec_id", "primary_id")


@query(f"{BASE}, d AS (" + " UNION ALL ".join(f"SELECT cik, year, '{c.slug}' AS kind, {_detail_sql(c).split(' AS agree_')[1].split(', ', 1)[1].rsplit(' AS ', 1)[0]} AS class FROM merged" for c in compare.COMPARISONS) + ") SELECT cik, year, kind, class FROM (SELECT *, row_number() OVER (PARTITION BY kind, class ORDER BY md5('42-' || (cik || '-' || year)), cik || '-' || year) AS r FROM d WHERE class LIKE 'False%') WHERE r <= 25")
def disagreement_sample(spark, sf_dir):
    d = compare.detailed(demo.merged(spark, sf_dir))
    long = d.unpivot(["cik", "year"], [f"class_{c.slug}" for c in compare.COMPARISONS], "kind", "class").withColumn("kind", F.replace("kind", F.lit("class_"), F.lit("")))
    rows = long.where(F.startswith("class", F.lit("False"))).withColumn("k", F.concat_ws("-", "cik", "year"))
    return sample.stratified(rows, ["kind", "class"], "k", 25).drop("k")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= round(n * 0.1)")
def fraction_sample(spark, sf_dir):
    return sample.fraction(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.1)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_rows(spark, sf_dir):
    return sample.first_of_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 100")
def random_sample(spark, sf_dir):
    return sample.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id, ('0x' || substr(md5('42-' || doc_id), 1, 7))::BIGINT % 1000 < 800 AS train FROM documents")
def train_split(spark, sf_dir):
    train, valid = sample.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("train", F.lit(True)).union(valid.withColumn("train", F.lit(False)))


# Text -----------------------------------------------------------------------------------------------


def _rewritten_sql(t: str) -> str:
    for old, new in text.REWRITTEN:
        t = f"replace({t}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return t


@query(f"SELECT doc_id, md5(regexp_replace({_rewritten_sql("coalesce(text, '')")}, '[^\\x00-\\x7F€£¥¢]+', '', 'g')) AS digest FROM documents")
def keep_allowed(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.keep_allowed(F.col("text"))).alias("digest"))


#: Every document also as a list item and between the signs that are rewritten.
_SIGNED = "concat('• “', coalesce(text, ''), '” — ‘x’ €')"


@query(f"SELECT doc_id, md5(regexp_replace({_rewritten_sql(_SIGNED)}, '[^\\x00-\\x7F€£¥¢]+', '', 'g')) AS digest FROM documents")
def keep_signs(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.keep_allowed(F.expr(_SIGNED))).alias("digest"))


def _clean_sql(t: str) -> str:
    t = f"CASE WHEN regexp_matches({t}, '^([-*•]\\s*|\\(?\\d+[.)]\\s+)') THEN {t} ELSE regexp_replace({t}, '\\n+', ' ', 'g') END"
    for pattern, new in text.CLEANING:
        flag = "'gi'" if pattern.startswith("(?i)") else "'g'"
        t = f"regexp_replace({t}, '{pattern.removeprefix('(?i)')}', '{new.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', {flag})"
    return f"trim({t})"


@query(f"SELECT doc_id, md5({_clean_sql("coalesce(text, '')")}) AS digest FROM documents")
def clean_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.clean_paragraph(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_clean_sql("CASE WHEN doc_id % 2 = 0 THEN concat('(', doc_id % 90 + 1, ') ', coalesce(text, '')) ELSE concat('- ', coalesce(text, '')) END")}) AS digest FROM documents")
def clean_items(spark, sf_dir):
    item = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("("), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(") "), "text")).otherwise(F.concat(F.lit("- "), "text"))
    return _documents(spark, sf_dir).select("doc_id", F.md5(text.clean_paragraph(item)).alias("digest"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(30), 'g'), '([a-z])([A-Z])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n, md5(array_to_string({_SENTENCES}, '|')) AS digest FROM documents")
def sentence_split(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in DEMO_CATEGORIES) + " END AS category FROM documents")
def category(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.first_category(F.col("text"), DEMO_CATEGORIES).alias("category"))


_WORDS = ("the", "license", "version", "and")


@query("WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> ''), '  ') || ' ' AS t FROM documents) SELECT doc_id, " + ", ".join(f"(length(t) - length(replace(t, ' {w} ', '')))::BIGINT // {len(w) + 2} AS n_{w}" for w in _WORDS) + " FROM w")
def keyword_counts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", *[text.word_count(F.col("text"), w).cast("long").alias(f"n_{w}") for w in _WORDS])


@query("WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> ''), '  ') || ' ' AS t FROM documents), n AS (SELECT doc_id, " + ", ".join(f"(length(t) - length(replace(t, ' {w} ', '')))::BIGINT // {len(w) + 2} AS n_{w}" for w in _WORDS) + " FROM w) SELECT doc_id, n_the + n_and AS common, n_license + n_version AS legal FROM n")
def keyword_groups(spark, sf_dir):
    groups = {"common": ["the", "and"], "legal": ["license", "version"]}
    d = _documents(spark, sf_dir).select("doc_id", text.keyword_counts(F.col("text"), list(_WORDS)).alias("m"))
    return d.select("doc_id", *[c.cast("long").alias(g) for g, c in zip(groups, text.grouped_counts(F.col("m"), groups), strict=True)])


@query("WITH w AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> ''), '  ') || ' ' AS t FROM documents) SELECT doc_id, greatest(round(tanh((length(t) - length(replace(t, ' license ', ''))) // 9 * 0.3 + (length(t) - length(replace(t, ' the ', ''))) // 5 * 0.01), 3), 0.1) AS score FROM w")
def weighted_score(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.weighted_score(F.col("text"), {"license": 0.3, "the": 0.01}, F.lit(0.1)).alias("score"))


@query("SELECT conv_id, turn, merged FROM (SELECT conv_id, turn, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS merged, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n >= 6")
def neighbour_merge(spark, sf_dir):
    return text.neighbours_merged(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("SELECT doc_id FROM documents, (SELECT avg(length(text)) AS m, stddev_samp(length(text)) AS s FROM documents) WHERE length(text) BETWEEN m - 1.96 * s AND m + 1.28 * s")
def length_band(spark, sf_dir):
    return text.length_band(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id")


@query("SELECT page_id, length(regexp_replace(html, '<.*?>', '', 'g')) AS n FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_tags(F.col("html"))).alias("n"))


@query("SELECT conv_id, turn, '<reportYear>' || (2015 + turn) || '</reportYear> ' || text AS tagged FROM conversations")
def year_tag(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.year_tag(F.col("text"), F.col("turn") + 2015).alias("tagged"))


@query("SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM (SELECT DISTINCT source, lang, text FROM documents) GROUP BY source, lang)")
def distinct_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang", "text").dropDuplicates().groupBy("source", "lang").agg(F.count("*").alias("n"))


@query()
def html_paragraphs(spark, sf_dir):
    return documents.paragraphs(table(spark, sf_dir, "pages"), "page_id", "html")


DEMO = Taxonomy(**{**FINANCE.__dict__, "categories": DEMO_CATEGORIES, "allowed": ("license", "version", "the")})


@query()
def expand_context(spark, sf_dir):
    return documents.expand_context(_documents(spark, sf_dir), "doc_id", "text", DEMO)


@query()
def legacy_windows(spark, sf_dir):
    import json

    make = lambda t: json.dumps(documents.legacy_windows(t or "", 2020, ["license", "the "], ["warranty"]), ensure_ascii=False)
    return documents.per_document(_documents(spark, sf_dir), "doc_id", "text", make, "matches")


#: Greedy pieces of at most 600 characters, then pieces under 15 joined to the one before, both as folds over texts with a sign between pieces.
_PACKED = f"CASE WHEN len({_SENTENCES}) = 0 THEN '' ELSE list_reduce({_SENTENCES}, lambda a, x: CASE WHEN length(regexp_extract(a, '[^' || chr(30) || ']*$')) + length(x) + 1 <= 600 THEN a || ' ' || x ELSE a || chr(30) || x END) END"
_MERGED = "CASE WHEN packed = '' THEN '' ELSE list_reduce(string_split(packed, chr(30)), lambda a, x: CASE WHEN length(x) < 15 THEN a || ' ' || x ELSE a || chr(30) || x END) END"


@query(f"WITH p AS (SELECT doc_id, {_PACKED} AS packed FROM documents), m AS (SELECT doc_id, {_MERGED} AS merged FROM p) SELECT doc_id, CASE WHEN merged = '' THEN 0 ELSE len(string_split(merged, chr(30))) END AS n, sha256(replace(merged, chr(30), '|')) AS digest FROM m")
def pack_sentences(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.merge_short(text.pack_sentences(text.sentences(F.col("text")), 600)).alias("parts")).select("doc_id", F.size("parts").alias("n"), F.sha2(F.array_join("parts", "|"), 256).alias("digest"))


# Whole pipeline, streams and generation -----------------------------------------------------------


@query()
def pipeline_end_to_end(spark, sf_dir):
    """Documents → passages by category → scores → labels → counts by source."""
    d = documents.expand_context(_documents(spark, sf_dir), "doc_id", "text", DEMO)
    rows = d.select("doc_id", F.explode(report.flat_matches(F.col("matches"))).alias("sentence"))
    found = analysis.scored(rows, "sentence", analysis.HashScorer)
    wide = found.select("doc_id", *[F.coalesce(F.col("pred")[k], F.lit(0.0)).alias(k) for k in LABELS])
    source = table(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.resolve(wide).join(source, "doc_id").groupBy("source", "primary_id").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    d = incremental.event_windows(table(spark, sf_dir, "events"))
    return d.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    d = incremental.sessions(table(spark, sf_dir, "events"))
    return d.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("SELECT r_name AS region, n_name AS nation, 'We hold ' || n_name || ' bonds in ' || r_name || '.' AS sentence FROM region JOIN nation ON n_regionkey = r_regionkey")
def template_join(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.format_string("We hold %s bonds in %s.", "n_name", "r_name").alias("sentence"))


@query("SELECT a AS kind, b AS thing, 'The ' || a || ' ' || b || ' expired.' AS sentence FROM (SELECT unnest(['new', 'old', 'long']) AS a), (SELECT unnest(['swap', 'option']) AS b)")
def template_product(spark, sf_dir):
    return generate.product(spark, "The {kind} {thing} expired.", {"kind": ["new", "old", "long"], "thing": ["swap", "option"]})


@query("SELECT kind, type, time, n FROM (VALUES " + ", ".join(f"('hedge', '{t}', '{time}', {k})" for t in FINANCE.types for time, k in (("curr", 60), ("hist", 60), ("spec", 10))) + ", ('hedge', 'any', 'spec', 10), " + ", ".join(f"('{x}', '{x}', '{time}', 60)" for x in ("warr", "emb") for time in ("curr", "hist")) + ", " + ", ".join(f"('noise', 'topic{i}', 'none', 40)" for i in range(6)) + ", ('noise', 'random', 'none', 100), ('noise', 'filing', 'none', 50)) v(kind, type, time, n)")
def corpus_plan(spark, sf_dir):
    return generate.seeds(generate.hedge_plan(spark, 100)).groupBy("kind", "type", "time").agg(F.count("*").cast("int").alias("n"))


@query()
def corpus_sentences(spark, sf_dir):
    """Every row of the three plans."""
    plan = generate.hedge_plan(spark, 100).union(generate.bargaining_plan(spark, 20)).union(generate.legacy_plan(spark, 50))
    return generate.corpus(generate.seeds(plan))


@query("SELECT kind, type, time, n FROM (VALUES " + ", ".join(f"('old_hedge', '{t}', '{time}', {10 * k})" for t in ("ir", "fx", "cp", "gen") for time, k in (("curr", 3), ("hist", 3), ("spec", 1))) + ", " + ", ".join(f"('liability', '{i}', 'none', 5)" for i in range(3, 8)) + ", ('old_noise', 'random', 'none', 100), " + ", ".join(f"('bargaining', '{k}', 'none', {20 * w})" for k, w in (("coverage", 3), ("no_coverage", 2), ("risk", 1), ("international", 1), ("us_only", 1), ("adversarial", 1), ("irrelevant", 1))) + ") v(kind, type, time, n)")
def other_plans(spark, sf_dir):
    plan = generate.legacy_plan(spark, 50).union(generate.bargaining_plan(spark, 20))
    return generate.seeds(plan).groupBy("kind", "type", "time").agg(F.count("*").cast("int").alias("n"))


def _templates_sql() -> str:
    """The builders' numbers of templates by type, counted from the pools."""
    rows = []
    for t in FINANCE.types:
        results = len(templates.RESULTS["gen"]) + (len(templates.RESULTS[t]) if t != "gen" else 0)
        rows += [(t, time, len(templates.POSITIONS[time]) * (1 if time == "spec" else len(templates.FIGURES) * len(templates.CONNECTORS) * results)) for time in ("curr", "hist", "spec")]
        rows += [(t, "mitigation", len(templates.INSTRUMENTS) * len(templates.MITIGATIONS)), (t, "context", 3 * len(templates.EXPOSURES[t]))]
    return "SELECT type, builder, n FROM (VALUES " + ", ".join(f"('{a}', '{b}', {n}::BIGINT)" for a, b, n in rows) + ") v(type, builder, n)"


@query(_templates_sql())
def built_templates(spark, sf_dir):
    parts = []
    for t in FINANCE.types:
        parts += [generate.position_templates(spark, t, time).withColumn("builder", F.lit(time)) for time in ("curr", "hist", "spec")]
        parts += [generate.mitigation_templates(spark, t).withColumn("builder", F.lit("mitigation")), generate.context_templates(spark, t).withColumn("builder", F.lit("context"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().groupBy("type", "builder").agg(F.count("*").alias("n"))
