"""Many rules at once against rule after rule, and Hungarian inputs with the words that are expected, letter by letter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuelane.functions import hungarian as hu
from cuelane.functions import normalise as nm
from cuelane.functions.rules import RuleTrie, rule_table

RNG = random.Random(2)
PARTS = ["a", "b", "c", "Ab", "é", "s", "ſ", "K", "K", "a-b", "-", "--", "b c", "c  a", "_x", "x", ".", " ", "a a", "ba", "", ". a", "a ."]


def one_by_one(text, rules):
    for key, value in rules:
        text = re.sub(rf"(?i)(?<!\w){re.escape(key)}(?!\w)", lambda _, v=value: v, text)
    return text


def test_trie_equals_rule_after_rule():
    for _ in range(4000):
        rules = [(k, RNG.choice([*PARTS, "a b", "X-Y"])) for k in ((RNG.choice(PARTS) + RNG.choice(["", "", " ", "-", " " + RNG.choice(PARTS)])) for _ in range(RNG.randint(1, 12))) if k]
        text = "".join(RNG.choice([*PARTS, " ", " "]) for _ in range(RNG.randint(0, 14)))
        assert RuleTrie(rules).apply(text) == one_by_one(text, rules)


def test_as_many_rules_as_a_real_file_has(spark):
    """717 rules, most of them chained, words and phrases; a text that no rule meets is untouched."""
    words = [f"word{i}" for i in range(700)]
    rules = [(w, words[(7 * i + 3) % 700]) for i, w in enumerate(words)] + [(f"{words[i]} {words[i + 1]}", f"two of {i}") for i in range(17)]
    texts = [" ".join(RNG.choice(words) for _ in range(60)) for _ in range(20)] + [" ".join(words[:18]), "Nothing here.", "", None, "WORD1, Word2!"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.said for r in docs.select("id", rule_table(rules)(F.col("text")).alias("said")).collect()}
    assert got == {i: None if t is None else one_by_one(t, rules) for i, t in enumerate(texts)}


def test_cost_does_not_follow_the_number_of_rules():
    import time

    text = " ".join(RNG.choice(["here", "there", "word7", "nothing"]) for _ in range(20_000))

    def took(n):
        t = RuleTrie([(f"word{i}", f"said {i}") for i in range(n)])
        begin = time.perf_counter()
        t.apply(text)
        return time.perf_counter() - begin

    took(10)
    assert took(20_000) < 5 * took(20) + 0.5


@pytest.mark.parametrize(
    ("text", "spoken"),
    [
        ("SW10-es", "ess dupla vé tíz es"),
        ("A B2 vitamin és C3PO robot.", "A bé kettő vitamin és cé három pé ó robot."),
        ("Az X-Wing és a T-1000 is itt van. K9-es egység.", "Az X-Wing és a té ezer is itt van. ká kilenc es egység."),
        ("A-1, B2-C, D-3E.", "a egy, bé kettő C, dé három e."),
        ("A1, B2B, C3C3, E5-F6, J10K", "a egy, bé kettő bé, cé három cé három, e öt F hat, jé tíz ká"),
        ("A123B és K-9 és 5-ös alma 10-én", "a százhuszonhárom bé és ká kilenc és 5-ös alma 10-én"),
        ("R2D2 Q7Y ŐZ3", "er kettő dé kettő kú hét ipszilon ő zé három"),
    ],
)
def test_mixed_words(text, spoken):
    assert hu.alphanumeric_hu(text) == spoken


@pytest.mark.parametrize(
    ("text", "spoken"),
    [
        ("A IV. és IX. fejezet fontos.", "A negyedik és kilencedik fejezet fontos."),
        ("2024. aug. 10-én tartja a B42-es teremben", "kétezer-huszonnégy augusztus tizedikeén tartja a bé negyvenkettő es teremben".replace("-", "")),
        ("Az 1. helyezett, a 23. versenyző és a 100. évforduló.", "Az első helyezett, a huszonharmadik versenyző és a századik évforduló."),
        ("Vettem 1234 almát és 567 körtét. Van 0 darab.", "Vettem ezerkétszázharmincnégy almát és ötszázhatvanhét körtét. Van nulla darab."),
        ('Ez *egy* "szöveg" (sok) fölösleges: karakterrel/. #@jel', "Ez egy szöveg sok fölösleges karakterrel . jel"),
        ("   Itt   van  néhány  extra   szóköz.", "Itt van néhány extra szóköz."),
        ("XIV Lajos, IV Béla.", "XIV Lajos, IV Béla."),
    ],
)
def test_normalised(text, spoken):
    assert hu.normalise_text(text) == spoken


def test_letters_and_acronyms(spark):
    said = lambda f, *texts: [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert said(nm.spell_letters, "AIOSW", "ŐZű", "x-1", "", None) == ["a í ó ess dupla vé", "ő zé ű", "iksz - 1", "", None]
    assert said(nm.spell_acronyms, "A NATO és az EU-ban XIV Lajos, MIX Ab USA.", "ÁFA", None, "semmi") == ["A en a té ó és az e ú-ban XIV Lajos, MIX Ab ú ess a.", "á ef a", None, "semmi"]


def test_registry(spark):
    rows = spark.createDataFrame([("en", "AND 5"), ("hu", "A 5 alma"), ("xx", "5"), (None, "5"), ("hu", None)], "lang string, text string")
    got = [r[0] for r in rows.select(nm.normalise_by_lang(F.col("text"), F.col("lang"), {"hu": hu.normaliser([("alma", "körte")]), "en": F.lower})).collect()]
    assert got == ["and 5", "A öt körte", "5", "5", None]
