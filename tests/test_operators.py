from pyspark.sql import functions as F

from filigrane.functions.taxonomy import FINANCE
from filigrane.operators import compare, flags, matrix, report, sample


def counts(spark, **n):
    keys = {"url": "u", "cik": 1, "year": 2020} | {f"n_{k}": n.get(k, 0) for k in FINANCE.labels}
    return spark.createDataFrame([tuple(keys.values())], list(keys))


def test_flags_join_use_and_time_over_the_report(spark):
    r = flags.report_flags(counts(spark, ir_use=1, curr=1)).first()
    assert (r.model_ir_user, r.model_user, r.model_user_all) == (1, 1, 1)
    r = flags.report_flags(counts(spark, eq_use=1, warr=1)).first()
    assert (r.model_eq_user, r.model_warr_user, r.model_user, r.model_user_all) == (0, 0, 0, 1)
    r = flags.report_flags(counts(spark, gen_use=1, curr=5)).first()
    assert (r.model_user, r.model_user_all) == (0, 1)


def test_rollup_takes_the_first_url(spark):
    rows = spark.createDataFrame([(1, 2020, "b", 2, 1), (1, 2020, "a", 1, 0)], "cik int, year int, url string, o int, model_user int")
    assert flags.firm_years(rows, F.col("o")).first().asDict() == {"cik": 1, "year": 2020, "model_user": 1, "url": "a"}


def test_metrics_with_zero_denominators(spark):
    d = spark.createDataFrame([(0, 0)] * 3, "t int, g int")
    c = compare.confusion(d, (compare.Comparison("x", "t", "g"),))
    m = compare.metrics(c).first()
    assert (m.tp + m.fp + m.tn + m.fn, m.accuracy, m.precision, m.recall, m.f1) == (3, 100.0, 0.0, 0.0, 0.0)
    assert {tuple(r) for r in compare.cross_tab(d, "t", "g").collect()} == {("Keyword_No", "Model_No", 3), ("All", "Model_No", 3), ("Keyword_No", "All", 3), ("All", "All", 3)}
    assert compare.metrics(compare.confusion(d.limit(0), (compare.Comparison("x", "t", "g"),))).first().accuracy == 0.0


def test_co_occurrence_is_symmetric(spark):
    d = spark.createDataFrame([(1, 0, 2), (1, 1, None), (0, 1, 1)], "a int, b int, c int")
    n = {(r.a, r.b): r.n for r in matrix.co_occurrence(d, ["a", "b", "c"]).collect()}
    assert all(n[x, y] == n[y, x] for x, y in n)
    assert (n["a", "a"], n["a", "b"], n["b", "c"]) == (2, 1, 1)


def test_rows_by_type_repeat(spark):
    d = spark.createDataFrame([(1, 2020, 1, 0), (1, 2020, 0, 2), (2, 2020, 0, 0)], "cik int, year int, a int, b int")
    got = matrix.rows_by_type(d, {"A": ["a"], "B": ["b"]})
    assert sorted((r.cik, r.hedge_type) for r in got.collect()) == [(1, "A"), (1, "A"), (1, "B"), (1, "B")]


def test_samples_are_bounded_and_stable(spark):
    d = spark.range(1000).withColumn("s", F.col("id") % 3)
    a = sample.stratified(d, ["s"], "id", 7).collect()
    assert len(a) == 21 and sorted(a) == sorted(sample.stratified(d.repartition(7), ["s"], "id", 7).collect())
    train, valid = sample.split(d, "id")
    assert train.count() + valid.count() == 1000 and 740 < train.count() < 860
    assert train.join(valid, "id").count() == 0


def test_matches_of_both_shapes(spark):
    d = spark.createDataFrame([('{"ir": ["a", "b"], "fx": ["c"]}',), ('["x"]',), ("bad",), (None,)], "m string")
    assert [r[0] for r in d.select(report.flat_matches(F.col("m"))).collect()] == [["a", "b", "c"], ["x"], None, None]
    one = spark.range(1)
    assert one.select(F.size(report.paired(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "xy"))))).first()[0] == 2
    assert one.select(report.first_label(F.lit("A (x), B")), report.first_label(F.lit(""))).first()[:] == ("A (x)", "Irrelevant")
