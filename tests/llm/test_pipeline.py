import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from filigrane.llm import toxicity
from tests.llm import brute
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_print

KINDS = ["email", "ip", "card", "phone"]


def test_stages_keep_clean_documents(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(14))
    filler = [" ".join(f"the{i} word{i * j % 97} of{j}" for j in range(25)) for i in range(240)]
    rows = [(i, t + (" moron scum" if i % 8 == 0 else ""), "en", "s", len(t)) for i, t in enumerate(filler)]
    rows += [(1000, filler[1], "en", "s", 1), (1001, "mail a@b.c or 1.2.3.4 now " + filler[2][::-1], "en", "s", 1), (1002, "lead " + passage, "en", "s", 1), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
    assert toxic == {i for i in range(0, 240, 8)}
    left = {i: t for i, t, *_ in rows if i not in toxic}
    prints = {i: brute_print(t) for i, t in left.items()}
    roots = brute_components(sorted(set(prints.values())))
    least = {}
    for i in sorted(left):
        least.setdefault(roots[prints[i]], i)
    left = {i: left[i] for i in least.values()}
    dirty = {r[0] for r in brute_hits(list(left.items()), [(1, passage)]) if r[-1]}
    assert dirty == {1002}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left.items():
        if i not in dirty:
            t = (t or "").replace("a@b.c", "[EMAIL]").replace("1.2.3.4", "[IP]")
            assert brute.pii(t)[:4] == (0, 0, 0, 0)
            ids = lib.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "bpe"]


def test_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    """Further columns of any name pass through all stages but the last; empty tables give empty ones."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{base} number{i} of{i * 7} them{i * 31 % 11}", "en", None, i, 0.5, "x", i, "k", 1.0) for i in range(12)] + [(None, None, None, None, None, None, None, None, None, None), (20, "", "", "", 0, 0.0, "", 0, "", 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score double, _row string, fp long, _keep string, held_out double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, f"{tmp_path}/a")
        assert made.columns == docs.columns, name
        assert {r.doc_id for r in made.collect()} <= {r[0] for r in rows}
    kept = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {None, 20} <= {r.doc_id for r in kept} and len(kept) >= 3
    for table, columns in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/b/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_earlier_stages_are_deleted(spark, tmp_path):
    import os

    from filigrane.llm import state

    spark.createDataFrame([(1, "a text", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = state.shared_folder(spark)
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    made = [f for f in set(os.listdir(folder)) - before if f.startswith("pipeline-")]
    assert len(made) == 1 and os.listdir(f"{folder}/{made[0]}") == ["pii"]
