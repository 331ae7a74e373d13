import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from filigrane.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(9)
    bits = ["the", "Étude", "it's", "we'LL", "12345", "ñandú", "  ", "\n", " ", " ", " ", "!!", "…", "ß", "Σίσυφος", "İ", "é", "<|endoftext|>", "😀", " ", "\x1c", "ﬁ", "中文", "_a", "a_b", "​", "²", "½"]
    plain = ["the", "Étude", "it's", "we'LL", "12345", "ñandú", " ", " ", " ", "\n", "!!", "ß", "x" * 40, "²½"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    made += ["".join(rng.choice(plain) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    return made + ["", None, " ", "a" * 20000, "ab" * 9000 + " " + "é" * 3000, "for " * 9000, "the <|endoftext|>x of " * 300, "<|startoftext|>", "'s" * 50, *[chr(i) + "a" + chr(i) + "B 'S" for i in range(1, 0x2100)]]


def test_ids_and_text_equal_the_library(spark):
    lib, rows = Tokenizer.from_file(PATH), texts()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in enumerate(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, ids int, id string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect()}
    assert got == want
    one = bpe.encode(df.where("doc_id = 1"), PATH).first()
    assert (len(one.ids), sha(one.decoded)) == (want[1][0], want[1][2])


def test_chunks_are_reused_and_joins_repaired():
    """Cuts fall anywhere, also inside words; every one of them is a join that is encoded again."""
    lib, rng = Tokenizer.from_file(PATH), random.Random(4)
    words = ["".join(rng.choice("abcdefgilmnorstuéß'!9") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(6000))
    c = bpe.Coder(PATH)
    texts = ["lead " + passage, "another lead of other words " + passage, passage[:20000] + "#" + passage[20000:]]
    for t in texts:
        ids, n, decoded = c.encode(t)
        own = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, own)) and n == len(own) and decoded == lib.decode(own, skip_special_tokens=False)
    cuts = sum(len(bpe.cuts(t.encode())) for t in texts)
    assert c.did["chunks"] + c.did["reused"] == cuts + 3
    assert c.did["reused"] > 0.6 * cuts and c.did["repaired"] > 0.3 * cuts
    assert any(b not in b" " and a not in b" " for t in texts for x in bpe.cuts(t.encode()) for a, b in [(t.encode()[x - 1 : x], t.encode()[x : x + 1])])


def test_windows_grow_until_both_ends_agree():
    """Where the chunks' ids don't agree with a window, it takes in more; at the last it is the whole text."""
    c = bpe.Coder(PATH)
    runs = b"one two three four five six seven".split()
    right = [c._run(r) for r in runs]
    whole = " ".join(right)
    for wrong, joins in (([], [(3, 3)]), ([], [(1, 2), (5, 5)]), ([2], [(3, 3)]), ([0, 6], [(3, 3)]), ([2, 4], [(3, 3), (5, 5)])):
        c.forget()
        values = list(right)
        for i in wrong:
            values[i] = "1 2 3"
        for first, last in joins:
            values[first : last + 1] = [None] * (last + 1 - first)
        c._mend(runs, values, joins)
        if wrong in ([2], [2, 4]):
            assert " ".join(values).split() == whole.split()
        else:
            assert [" ".join(values[a : b + 1]).split() for a, b in joins] == [" ".join(right[a : b + 1]).split() for a, b in joins]


def test_cuts_follow_content():
    rng = random.Random(3)
    body = bytes(rng.randrange(97, 123) for _ in range(60_000))
    a, b = bpe.cuts(body), bpe.cuts(b"x" * 777 + body)
    assert len(a) > 80 and len({x + 777 for x in a} & set(b)) > 0.95 * len(a)
    text = ("é" * 50 + "ab") * 500
    assert all(text.encode()[x : x + 1] not in (bytes([c]) for c in range(0x80, 0xC0)) for x in bpe.cuts(text.encode()))


def test_memo_is_bounded():
    small = bpe.Memo(2000)
    for i in range(100):
        small.put(str(i), "x" * 50)
        assert small.get(str(i))
    assert small.held <= 1000 and len(small.young) + len(small.old) <= 14


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [r.n_tokens for r in bpe.digests(df, PATH).collect()] == [0, 0]
    assert bpe.digests(df.limit(0), PATH).count() == 0
