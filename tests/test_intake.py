import json
import random
import re

import pytest
from pyspark.sql import functions as F

from filigrane.functions import text
from filigrane.functions.taxonomy import FINANCE, WORDINGS, Wording, phrase_tree
from filigrane.operators import compare, labels, report, sample
from filigrane.operators.registry import Registry, Sheet
from filigrane.plans import generate
from filigrane.sources import fetch, tables


class Clock:
    """Time that passes by sleeping and by a fixed cost of each look."""

    def __init__(self, cost):
        self.now, self.cost, self.slept = 0.0, cost, []

    def __call__(self):
        self.now += self.cost
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


@pytest.mark.parametrize(("cost", "grows"), [(0.0, False), (1.0, False)])
def test_pacer_holds_its_rate(cost, grows):
    clock = Clock(cost)
    pacer = fetch.Pacer(4, clock, clock.sleep)
    began = clock.now
    for _ in range(400):
        pacer.wait()
    assert 400 / (clock.now - began) <= 4.6
    assert (pacer.pause > 0.25) == grows or cost == 0.0
    fast = fetch.Pacer(4, clock, clock.sleep)
    fast.pause = 0.0
    busy = Clock(0.01)
    fast.clock, fast.sleep, fast.began = busy, busy.sleep, busy()
    for _ in range(3000):
        fast.wait()
    assert fast.pause > 0.1


def test_answers_and_failures():
    clock = Clock(0.0)
    pacer = fetch.Pacer(100, clock, clock.sleep)
    given = iter([fetch.Answer(429, "slow down", 7.0), fetch.Answer(200, "ok")])
    assert fetch.fetched("u", pacer, lambda u: next(given)) == fetch.Answer(200, "ok") and 7.0 in clock.slept
    assert fetch.fetched("u", pacer, lambda u: fetch.Answer(429, "x", 1.0), retries=2) == fetch.Answer(429, None)
    assert fetch.fetched("u", pacer, lambda u: fetch.Answer(429, "x")) == fetch.Answer(429, None)
    assert fetch.fetched("u", pacer, lambda u: fetch.Answer(404, "gone")).body is None
    assert fetch.over_http("http://127.0.0.1:9/none").status == 0 and fetch.over_http("not a url").status == 0


def test_fetched_pages_are_rows(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a</p>")
    (tmp_path / "urls").write_text(f"file://{tmp_path}/a.html\n\nfile://{tmp_path}/none.html\n")
    spark.dataSource.register(fetch.FetchedPages)
    got = spark.read.format("filigrane_fetched").option("path", f"{tmp_path}/urls").option("rate", "100").option("tasks", "2").load().collect()
    assert sorted((r.url[-6:], r.body) for r in got) == [("a.html", "<p>a</p>"), ("e.html", None)]


def test_recent_and_older_filings(spark):
    columns = lambda n, form: {"form": [form] * n, "accessionNumber": [f"0000000001-20-{i:06}" for i in range(n)], "primaryDocument": ["d.htm"] * n, "filingDate": ["2020-01-01"] * n, "reportDate": ["2019-12-31"] * n}
    body = json.dumps({"name": "N", "tickers": ["T", "U"], "filings": {"recent": columns(2, "10-K"), "files": [{"name": "old.json"}, {"name": "missing.json"}]}})
    firms = spark.createDataFrame([(1, body), (2, None), (3, "oops"), (4, "{}")], "cik long, body string")
    older = spark.createDataFrame([("old.json", json.dumps(columns(3, "20-F"))), ("other.json", json.dumps(columns(1, "10-K")))], "file string, body string")
    got = tables.submitted_filings(firms, older).collect()
    assert sorted(r.type for r in got) == ["10-K"] * 2 + ["20-F"] * 3 and {r.ticker for r in got} == {"T"}


def test_failures_have_reasons_once(spark):
    reports = spark.createDataFrame([(1, 2020, "a"), (2, 2020, "b"), (3, 2020, "c"), (4, 2020, "d")], "cik long, year int, url string")
    results = spark.createDataFrame([("a", "[]"), ("b", "x"), ("b", None), ("c", '[{"ir": 1}]'), ("d", None), ("z", None)], "url string, r string")
    known = spark.createDataFrame([(4, 2020, "d", "before")], "cik long, year int, url string, reason string")
    good, failed = tables.accepted(results, "r", "array<map<string,double>>", reports, known)
    assert [r.url for r in good.collect()] == ["c"]
    assert sorted((r.url, r.reason) for r in failed.collect()) == [("a", "no predictions"), ("b", "no response")]


def test_registry(spark, tmp_path):
    r = Registry()
    r.add_source("x", spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string"))
    with pytest.raises(ValueError, match="registered"):
        r.add_source("x", spark.range(1))
    with pytest.raises(ValueError, match="unknown"):
        r.add_sheet(Sheet("b", "s", "y"))
    r.add_sheet(Sheet("book", "All/n", "x", index=("s",)))
    r.add_sheet(Sheet("book", "none", "x", "n > 5"))
    assert r.frame(r.sheets[0]).columns == ["s", "n"]
    assert r.write(str(tmp_path)) == ["book/All/n"] and spark.read.parquet(f"{tmp_path}/book/All_n").count() == 2
    assert [tuple(x) for x in r.summary().collect()] == [("book", "All_n", 2)]


def test_missing_tables_are_empty(spark, tmp_path):
    assert tables.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    spark.range(3).write.parquet(f"{tmp_path}/some")
    assert tables.read_or_empty(spark, f"{tmp_path}/some", "id long").count() == 3


def test_a_frequent_value_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "b").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are too few to be kept apart otherwise
    try:
        tables.write_by(rows, str(tmp_path), "v", file_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(str(tmp_path)).groupBy("v").count().where("v = 'hot'").first()["count"] == 900
    assert len(list((tmp_path / "v=hot").glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path)).count() == 1000


def test_phrase_trees_match_their_terms():
    rng = random.Random(2)
    for _ in range(200):
        terms = ["".join(rng.choice(["a", "b", "c", "[- ]", "d?", "(?:x|yz)"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))]
        tree, plain = re.compile(rf"(?:{phrase_tree(terms)})\Z"), re.compile("(?:" + "|".join(terms) + r")\Z")
        for _ in range(40):
            t = "".join(rng.choice("abcdxyz- ") for _ in range(rng.randint(0, 7)))
            assert bool(tree.match(t)) == bool(plain.match(t)), (terms, t)
    assert re.search(Wording(("a",), ("b",), ("c",)).pattern, "x A-b") and not re.search(Wording(("a",), ("b",), ("c",)).pattern, "xa b")


def test_categories_of_known_phrases(spark):
    want = {"ethanol swaps": "cp", "crude oil-linked forwards": "cp", "SOFR swap": "ir", "floating-rate contract": "ir", "swap agreements": "gen", "an NDF": "fx", "call options": "eq", "we sold derivatives": None, "interest rates swap": None, "LIBOR-based caps": "ir", "wood chip price hedging": "cp"}
    d = spark.createDataFrame([(k,) for k in want], "t string").select("t", text.first_category(F.col("t"), FINANCE.categories).alias("c"))
    assert {r.t: r.c for r in d.collect()} == want
    assert tuple(WORDINGS) == tuple(n for n, _ in FINANCE.categories)


def test_unescaped_and_keywords(spark):
    rows = ["plain", "a\\u0041b", "caf\u00e9", "bad \\x", None, "tab\\t"]
    d = spark.createDataFrame([(t,) for t in rows], "t string").select(text.unescaped(F.col("t")).alias("u"))

    def plain(t):
        try:
            return t if t is None else t.encode("utf-8").decode("unicode_escape")
        except UnicodeDecodeError:
            return t

    assert [r.u for r in d.collect()] == [plain(t) for t in rows]
    assert text.flat_keywords({"a": {"x": ["p", "q"], "y": ["q"]}, "b": ["r", "p"]}) == ["p", "q", "r"]


def test_fraction_equals_ranking(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "cold").alias("s"))
    got = {r.id for r in sample.fraction(rows, ["s"], "id", 0.137).collect()}
    import hashlib

    want = set()
    for s in ("hot", "cold", None):
        ids = [i for i in range(5000) if ("hot" if i % 10 < 8 else "cold" if i % 10 == 8 else None) == s]
        ids.sort(key=lambda i: (hashlib.md5(f"42-{i}".encode()).hexdigest(), i))
        want |= set(ids[: int(len(ids) * 0.137 + 0.5)])
    assert got == want


def test_roc_auc_equals_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.choice([rng.randint(0, 30) / 7, 3.0])) for _ in range(700)]
    pairs = [(a > b) + (a == b) / 2 for t, a in rows if t for u, b in rows if not u]
    got = compare.roc_auc(spark.createDataFrame(rows, "t int, s double"), "t", "s").first().auc
    assert abs(got - sum(pairs) / len(pairs)) < 1e-6
    assert compare.roc_auc(spark.createDataFrame([(1, 1.0)], "t int, s double"), "t", "s").first().auc is None


def test_joins_of_the_samplers(spark):
    a = spark.createDataFrame([(1, "old", 5), (2, "old", 6)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "new", "x")], "k int, v string, z string")
    assert sorted(tuple(r) for r in compare.refreshed(a, b, ["k"]).select("k", "v", "w", "z").collect()) == [(1, "new", 5, "x"), (2, None, 6, None)]
    many = spark.createDataFrame([(1, 9, "late"), (1, 2, "first")], "k int, o int, v2 string")
    assert sorted((r.k, r.v2) for r in compare.looked_up(a, many, ["k"], ["o"]).collect()) == [(1, "first"), (2, None)]


def test_inspection_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "url string, sentences long, any_current_use long")
    assert tuple(report.inspection_totals(empty, "url", "sentences", "any_current_use").first()) == (0, 0, 0, 0)


def test_plans_give_the_right_labels():
    for seed in range(200):
        _, y = generate.paragraph("hedge", "any", "spec", seed)
        assert y["spec"] and not any(y[f"{t}_use"] for t in FINANCE.types) and sum(y[t] for t in FINANCE.types) == 1
        _, y = generate.paragraph("bargaining", "us_only", "none", seed)
        assert y["cb_coverage"] and not y["cb_international"]
        s, y = generate.paragraph("liability", "6", "none", seed)
        assert y["embed"] and y["curr"] and not y["irrelevant"] and "{" not in s
        _, y = generate.paragraph("old_hedge", "ir", "hist", seed)
        assert y["deriv"] and y["ir"] and y["hist"] and len(y) == 17
        _, y = generate.paragraph("noise", f"topic{seed % 6}", "none", seed)
        assert y["irr"] and sum(y.values()) == 1


def test_notebook_ranks(spark):
    from filigrane.functions.taxonomy import NOTEBOOK

    zero = dict.fromkeys(FINANCE.labels, 0.0)
    rows = [zero | {"ir": 0.9, "spec": 0.8}, zero | {"eq_use": 0.9, "ir_use": 0.5}, zero | {"gen": 0.9, "fx": 0.3}, zero]
    d = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} double" for k in zero))
    got = [r.label_ids for r in labels.resolve(d, NOTEBOOK, per_type=True).collect()]
    assert got[0] == [2, 15] and got[1][:2] == [0, 9] and got[2] == [16] and got[3] == [24]
