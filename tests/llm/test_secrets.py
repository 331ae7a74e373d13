import math
import random
import re

from filigrane.llm import secrets
from tests.llm import brute


def texts():
    rng = random.Random(2)
    bits = ["password", "PassWD", "ſecret", "api_Key", "apikey", "toKen", "=", ":", " ", "  ", '"', "'", "abcd1234", "A+/_.=-z", "AKIA", "ABCDEFGHIJKL0", "0123456789abcdef", "é", "😀", "\n", "f", "x"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    return made + ["", None, "0" * 40000, 'a="' * 20000, "token=" * 10000, "a" * 60000 + "=b"]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_hex int, id string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(df).collect()}
    assert got == {i: brute.secrets(t) for i, t in enumerate(rows)}


def test_constants_reach_sensitive_targets():
    text = 'k = "Zx81-qqPw7"\nclient_secret = k\ncolor = "Zx81-blueish"\n'
    assert secrets.literal_spans(text) == [("literal", 5, 15)]
    assert secrets.literal_spans('a = "Zx81-" \ndbPassword = a + "qqPw77"') == [("literal", 5, 10), ("literal", 31, 37)]
    assert secrets.literal_spans("<password>Zx81-qqPw7</password>") == [("literal", 10, 20)]
    assert secrets.literal_spans("password: ${DB_PASSWORD}\npwd = changeme\nthe key: is here") == []


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.n_hex, r.spans) for r in secrets.scan(df).collect()] == [(0, ""), (0, "")]
    assert secrets.scan(df.limit(0)).count() == 0


def test_every_literal_of_an_assignment_counts():
    parts = [f'"Zx{k:02}-q"' for k in range(40)]
    text = "k = " + " + ".join(parts) + "\nclient_secret = k\n"
    assert len(secrets.literal_spans(text)) == 40
    long = 'a = "' + "Zx81-qqPw7" * 500 + '"\npassword = a + "Zx82-qqPw8"'
    assert len(secrets.literal_spans(long)) == 2
    doubled = 'a0 = "Zx81-qqPw7"\n' + "".join(f"a{k + 1} = a{k} + a{k}\n" for k in range(2000)) + "password = a2000"
    assert secrets.literal_spans(doubled) == [("literal", 6, 16)]
    assert secrets.literal_spans('a = "' + "x" * 5000 + '"\npassword = a + "x"') == []


def test_names_and_expressions_are_no_literals():
    for text in ("password = get_password()", "token = os.environ['x']", "secret = self.token", "def f(password=None, token=default_token): pass", "api_key = settings.API_KEY\n", "password = value\n", "token: SecretStr\n"):
        assert secrets.literal_spans(text) == [], text
    for text, want in (("password=hunterhunter\n", "hunterhunter"), ("password: Zx81qqPw7  # old\n", "Zx81qqPw7"), ("DB_PASSWORD=Zx81/qq+Pw7=", "Zx81/qq+Pw7="), ('passphrase = "correct horse battery staple"', "correct horse battery staple"), ('signing_encryption = "Zx81-qqPw7aB"', "Zx81-qqPw7aB")):
        found = [text[a:b] for _, a, b in secrets.find(text)[1] if text[a:b] == want]
        assert found, text
    assert secrets.literal_spans('password = "Enter your password here"') == []


def plain_score(name, value):
    """The score by its definition, on the whole value."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
    how = min(1.0, sum(secrets.SENSITIVE.get(w, 0) for w in {*words, *(a + b for a, b in zip(words, words[1:], strict=False))}))
    if not how or len(value) < secrets.MIN_LENGTH or secrets.PLACEHOLDER.match(value) or " " in value:
        return 0.0
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(value.count(c) / len(value) * math.log2(value.count(c) / len(value)) for c in set(value))
    return how * min(1.0, 0.4 + 0.1 * mixed + 0.08 * entropy)


def test_programs_equal_a_plain_interpreter():
    """Random programs of assignments, run statement by statement on whole strings; a literal counts if any sensitive value holds it."""
    rng = random.Random(11)
    for _ in range(300):
        names = ["a", "color", "client_secret", "dbPassword", "api_key", "k2", "authToken", "note"]
        text, bound, secret = "", {}, set()
        for _ in range(rng.randint(1, 12)):
            name, parts, written = rng.choice(names), [], []
            for _ in range(rng.choice([1, 1, 2, 3, 1000 if rng.random() < 0.02 else 12])):
                if rng.random() < 0.6 or not bound:
                    literal = "".join(rng.choice("abcXYZ019-+/") for _ in range(rng.choice([2, 5, 9, 30, 10_000 if rng.random() < 0.01 else 3])))
                    written.append(f'"{literal}"')
                    parts.append(("new", literal))
                else:
                    old = rng.choice(sorted(bound))
                    written.append(old)
                    parts.append(("old", old))
            start, value, spans = len(text) + len(name) + 3, "", set()
            for (kind, what), w in zip(parts, written, strict=True):
                if kind == "new":
                    value, spans = value + what, spans | {(start + 1, start + 1 + len(what))}
                else:
                    value, spans = value + bound[what][0], spans | bound[what][1]
                start += len(w) + 3
            text += f"{name} = {' + '.join(written)}\n"
            if len(value) > 200_000:
                break
            bound[name] = (value, spans)
            if plain_score(name, value) >= secrets.MIN_SCORE:
                secret |= spans
        else:
            assert secrets.literal_spans(text) == [("literal", *x) for x in sorted(secret)]
