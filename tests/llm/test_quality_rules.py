import random
import re

from filigrane.llm import quality_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_measures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "ab", "é😀", "#x", "|", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["", None, " \t\n", "same line here\n" * 40, "w " * 30000, "a b c d e f g h a b c d e f g h"]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _w string")
    got = {r[0]: tuple(r)[1:7] for r in quality_rules.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdict_and_empty(spark):
    text = "the way of all the words in a text that is read by one and the same man " * 1 + "and so on to be sure it is long"
    df = spark.createDataFrame([(1, text), (2, text.replace(" ", " #%& "))], "doc_id long, text string")
    assert [r.kept for r in quality_rules.quality_rules(df).orderBy("doc_id").collect()] == [True, False]
    assert quality_rules.quality_rules(df.limit(0)).count() == 0
