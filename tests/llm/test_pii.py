import random

from filigrane.llm import pii
from tests.llm import brute

WHOLE = "doc_id long, text string, lang string, n_email string, _t int, _spans string"


def texts():
    rng = random.Random(5)
    bits = ["a@b.c", "_d@e.f-g.h", "x.y+z@mail5.example.com", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2345", "+49.30.12345678", "GB82 WEST 1234 5698 7654 32", "é", "ñ😀", " ", "-", ".", "@", "+", "7", "12", "ssn 078-05-1120", "IBAN ", "\n"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return made + ["", None, "9" * 30000, "1 " * 20000, "a" * 50000 + "@b", "+1" + "(" * 30000 + "2", "4111111111111111" * 3000]


def run(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in enumerate(rows)], WHOLE)


def test_base_spans_equal_the_plain_patterns(spark):
    rows = texts()
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.scan(run(spark, rows)).collect()}
    assert got == {i: brute.pii(t) for i, t in enumerate(rows)}


def test_method_adds_iban_and_context(spark):
    rows = ["IBAN GB82WEST12345698765432.", "IBAN GB82WEST12345698765431.", "ssn 078-05-1120", "part 078-05-1120"]
    got = [r.spans for r in pii.scan(run(spark, rows)).orderBy("doc_id").collect()]
    assert got == ["card:13:27,iban:5:27" if brute.luhn("12345698765432") else "iban:5:27", "card:13:27" if brute.luhn("12345698765431") else "", "ssn:4:15", ""]


def test_redact_keeps_the_rest(spark):
    rows = ["é mail a@b.c and 1.2.3.4!", None, "", "plain"]
    got = pii.redact(run(spark, rows)).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "lang", "n_email", "_t", "_spans"]
    assert [r.text for r in got.collect()] == ["é mail [EMAIL] and [IP]!", None, "", "plain"]


def test_empty_and_repeated(spark):
    assert pii.scan(run(spark, [])).count() == 0
    twice = spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c")], "doc_id long, text string")
    assert [r.n_email for r in pii.scan(twice).collect()] == [1, 1]


def test_context_is_the_text_before(spark):
    numbers = [f"078-05-{1000 + k}" for k in range(40)]
    rows = ["SSN: 078-05-1120, 219-09-9999", "SSN: " + ", ".join(numbers), "078-05-1120, SSN of Ann 219-09-9999 and her part 219-09-9998"]
    got = [r.spans for r in pii.scan(run(spark, rows)).orderBy("doc_id").collect()]
    assert got[0] == "ssn:5:16,ssn:18:29"
    assert got[1] == ",".join(f"ssn:{5 + 13 * k}:{16 + 13 * k}" for k in range(40))
    assert got[2] == "ssn:24:35,ssn:49:60"
    assert pii.redact(run(spark, rows[:1])).first().text == "SSN: [SSN], [SSN]"
