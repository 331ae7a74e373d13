import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE
from filigrane.plans import analysis, catalog, generate, intake, reviews  # noqa: F401  (the last two register queries)
from filigrane.sources import tables
from filigrane.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables.create(spark, folder)
    tables.append(spark.createDataFrame([(1, 2020, ""), (1, 2020, "u")], tables.SCHEMAS["report_data"]), folder, "report_data")
    d = tables.scan(spark, folder, "report_data")
    assert tables.valid_reports(d).count() == tables.valid_reports(d, False).count() == 1
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("b", 1, "z"), ("c", 0, "w")], "k string, v int, s string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], "v").collect()) == [("a", 1, "x"), ("b", 1, "z"), ("c", 0, "w")]
    assert [r.k for r in tables.insert_missing(old, new, ["k"]).collect()] == ["c"]
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, f"{folder}/none.csv", "url string")
    (tmp_path / "a.csv").write_text("cik\n1\n")
    with pytest.raises(ValueError, match="url"):
        tables.read_csv(spark, f"{folder}/a.csv", "cik long", required=("url",))
    tables.write_bundle({"All [x]": old}, f"{folder}/b")
    assert spark.read.parquet(f"{folder}/b/All _x_").count() == 2


def test_offline_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>x</p>")
    spark.dataSource.register(tables.OfflinePages)
    assert [r.body for r in spark.read.format("filigrane_pages").option("path", str(tmp_path)).load().collect()] == ["<p>x</p>"]


def test_ingest_twice_adds_once(spark, tmp_path):
    source, done = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "url string, n int").write.parquet(source)
    run = lambda name: incremental.ingest_new(spark, source, "url string, n int", done, f"{tmp_path}/{name}", "url", lambda d: d.withColumn("m", F.col("n") * 2)).awaitTermination()
    run("c1")
    run("c2")  # a fresh checkpoint sees all files again
    assert sorted(tuple(r) for r in spark.read.parquet(done).select("url", "n", "m").collect()) == [("a", 1, 2), ("b", 2, 4)]


def test_stream_windows_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/e")
    want = {tuple(r)[:3] for r in incremental.event_windows(e).collect()}
    stream = incremental.event_windows(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e"), late="10000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r)[:3] for r in spark.table("win").collect()} == want


def test_pipeline_isolates_failures(spark):
    class Twice(analysis.Analyzer):
        def analyze(self, data, **options):
            return {"out": data["x"].selectExpr("id * 2 AS id")}

    p = analysis.Pipeline({"x": spark.range(3)})
    p.register("bad", lambda d: 1 / 0)
    p.register("twice", Twice())
    out = p.run()
    assert sorted(r.id for r in out["twice.out"].collect()) == [0, 2, 4] and set(p.failures) == {"bad"}
    assert p.run(analysis.Options(("bad",))) == {}


def test_scorer_keeps_places(spark):
    class Odd(analysis.HashScorer):
        def score(self, texts):
            return super().score(texts)[: len(texts) - ("drop" in texts)]

    d = spark.createDataFrame([(i, "drop" if i == 2 else f"t{i}") for i in range(4)], "i int, t string").coalesce(1)
    got = {r.i: r.pred for r in analysis.scored(d, "t", Odd, batch=2).collect()}
    assert set(got[2]) == set(got[3]) == {"error"} and set(got[0]) == set(FINANCE.labels)


def test_corpus_is_stable(spark):
    rows = generate.seeds(generate.hedge_plan(spark, 25).union(generate.bargaining_plan(spark, 3)).union(generate.legacy_plan(spark, 15)))
    a = sorted(tuple(r) for r in generate.corpus(rows).collect())
    assert a == sorted(tuple(r) for r in generate.corpus(rows.repartition(5)).collect())
    assert all("{" not in s and not s[0].islower() for s, _ in a)
    with pytest.raises(ValueError, match="no paragraph"):
        generate.paragraph("other", "x", "none", 1)
    assert generate.product(spark, "{a}-{b}-{a}", {"a": ["1", "2"], "b": ["x"]}).count() == 2
    terms = spark.createDataFrame([(f"t{i}",) for i in range(200)], "term string")
    assert 200 < generate.with_prefixes(terms, ["long-term"], 0.15).count() < 260


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def rows(df):
        plain = lambda v: None if v is None or v is pd.NA or v != v else (round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v))
        return sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist())

    assert rows(got) == rows(want)
