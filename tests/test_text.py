import collections
import random
import re

from pyspark.sql import functions as F

from filigrane.functions import documents, text
from filigrane.functions.taxonomy import FINANCE, Taxonomy

TOY = Taxonomy(**{**FINANCE.__dict__, "categories": (("ir", r"(?i)\bswap\b"), ("fx", r"(?i)\bforward\b"), ("gen", r"(?i)\bhedge\b")), "allowed": ("rate",)})


def test_cleaning_in_spark_equals_python(spark):
    samples = ["SwapRate12months cost$5 ( a ) , b ---- <b>x</b> Table of Contents F-12 end", "• item\nnext", "(1) one\ntwo", "plain\n\ntext here", "é€£—•“q”"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").orderBy("i")
    got = [r[0] for r in d.select(text.clean_paragraph(text.keep_allowed(F.col("s")))).collect()]
    assert got == [(documents.clean_paragraphs([documents.ascii_only(s)]) or [""])[0] for s in samples]
    assert got[0].startswith("Swap Rate 12 months cost $5 (a), b")


def test_sentences_and_categories(spark):
    one = spark.range(1)
    assert one.select(text.sentences(F.lit("One two.  Three! fourFive? "))).first()[0] == ["One two.", "Three!", "four", "Five?"]
    assert documents.split_sentences("One two.  Three! fourFive? ") == ["One two.", "Three!", "four", "Five?"]
    names = [one.select(text.first_category(F.lit(s))).first()[0] for s in ("an interest rate swap", "currency forwards", "crude oil futures", "equity options", "derivative contracts", "nothing")]
    assert names == ["ir", "fx", "cp", "eq", "gen", None]


def test_packing_and_short_merge(spark):
    parts = F.array(*map(F.lit, ["aaaa", "bbbb", "cc", "dddddddddddd"]))
    assert spark.range(1).select(text.pack_sentences(parts, 10)).first()[0] == ["aaaa bbbb", "cc", "dddddddddddd"]
    assert spark.range(1).select(text.merge_short(F.array(*map(F.lit, ["ab", "a longer paragraph", "cd", "ef"])), 5)).first()[0] == ["ab", "a longer paragraph cd ef"]


def test_word_counts(spark):
    one = spark.range(1)
    assert one.select(text.word_count(F.lit("Swap swap swaps SWAP-swap"), "swap")).first()[0] == 4
    assert one.select(text.weighted_score(F.lit("swap"), {"swap": 0.5}, F.lit(0.9))).first()[0] == 0.9
    assert one.select(text.sentence_case(F.lit("hELLO there. next ONE"))).first()[0] == "Hello there. Next one"
    assert text.duration(3725) == "1h 2m 5s" and text.duration(59) == "59s"


def test_lists_tables_and_html():
    assert documents.join_lists(["* a", "* b", "(1) x", "(2) y", "unfinished", "goes on."]) == ["* a\n* b", "(1) x\n(2) y unfinished goes on."]
    assert documents.join_lists(["•", "first", "done."]) == ["• first done."]
    table = "<TABLE>\n<CAPTION>\nName of\nthing\n<S>   \nrow one   1   2\n-----  ---\nrow two   3   4\n</TABLE>"
    rows = documents.fixed_width_table(table)
    assert ["row two", "3", "4"] in rows and any(r[0].endswith("Name of thing") for r in rows)
    assert documents.extract("<p>Alpha beta gamma delta.</p><script>x()</script><p>Second paragraph here.</p>") == ["Alpha beta gamma delta.", "Second paragraph here."]
    assert documents.extract(None) == [] and documents.extract("Para one is long enough.\n\nPara two is long enough.", False) == ["Para one is long enough.", "Para two is long enough."]


def test_expansion_limits():
    sentences = [f"Sentence number {i} about nothing at all." for i in range(20)]
    sentences[10] = "The swap is here."
    for compat, near in ((True, 8), (False, 9)):
        e = documents.Expander(sentences, TOY, documents.Window(least=100, most=200, compat=compat))
        got = e.run()
        assert len(got["ir"]) == 1 and len(got["ir"][0]) <= 201
        assert f"number {near} " in got["ir"][0] and ("number 9 " in got["ir"][0]) is not compat
    e = documents.Expander(["A forward one.", "B", "The swap is here.", "C", "Another forward."], TOY, documents.Window(least=500, compat=False))
    assert e.run()["ir"] == ["B. The swap is here. C."]


def test_expansion_counts_uses_and_generic_length():
    same = ["A swap."] * 4
    got = documents.Expander(same, TOY, documents.Window(least=1)).run()
    assert got["ir"] == ["A swap.."]
    short = documents.Expander(["We hedge it.", "We hedge it with very many words."], TOY, documents.Window(least=1)).run()
    assert short["gen"] == ["We hedge it with very many words.."]


def test_legacy_windows():
    t = " . ".join(f"word{i} two three four five six seven" for i in range(40)) + " . the license of this work is old now . end"
    got = documents.legacy_windows(t, 2020, ["license"], ["warranty"])
    assert len(got) == 1 and "license" in got[0] and 250 < len(got[0]) <= 2000
    assert documents.legacy_windows(t, 2020, ["license"], ["license"]) == []


class PlainExpander:
    """Context expansion that joins its parts anew at each step."""

    def __init__(self, sentences, tax, window):
        self.s, self.tax, self.w, self.used = sentences, tax, window, collections.Counter()
        self.category = [next((n for n, p in tax.categories if re.search(p, s)), None) for s in sentences]

    def joined(self, parts):
        return ". ".join(p if self.w.compat else p.rstrip(".") for p in parts).strip() + "."

    def admits(self, i, category):
        if not 0 <= i < len(self.s) or self.used[i] >= self.w.uses:
            return False
        return self.category[i] in (None, category, self.tax.generic) or any(x in self.s[i].lower() for x in self.tax.allowed)

    def grow(self, seed, category):
        parts, members, reach = [self.s[seed]], {seed}, 2 if self.w.compat else 1
        front = {-1: seed - reach, 1: seed + reach}
        while len(self.joined(parts)) < self.w.least and any(v is not None for v in front.values()):
            for side in (-1, 1):
                at = front[side]
                if at is None or not self.admits(at, category):
                    front[side] = None
                    continue
                t = self.s[at]
                over = len(self.joined([t, *parts])) - self.w.most
                if over > 0:
                    t = t[over:] if side < 0 else t[:-over]
                parts = [t, *parts] if side < 0 else [*parts, t]
                members.add(at)
                front[side] = None if over > 0 else at + side
        return self.joined(parts), members


def test_expansion_equals_the_plain_version():
    rng = random.Random(5)
    tax = Taxonomy(**{**TOY.__dict__, "allowed": ("rate", "cost")})
    for _ in range(400):
        sentences = [" ".join(rng.choice(["swap", "forward", "hedge", "rate", "cost", "land", "x.", "was", "sold"]) for _ in range(rng.randint(1, 9))) + rng.choice([".", "", "!", ".."]) for _ in range(rng.randint(1, 14))]
        for compat in (True, False):
            w = documents.Window(least=rng.choice([40, 90, 200]), most=rng.choice([60, 100, 220]), compat=compat)
            a, b = documents.Expander(sentences, tax, w), PlainExpander(sentences, tax, w)
            for i in range(len(sentences)):
                got, want = a.grow(i, "ir"), b.grow(i, "ir")
                assert got == want
                a.used.update(got[1])
                b.used.update(want[1])
