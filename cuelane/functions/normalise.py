"""Text normalisation for speech: ordered rules, clean-up, spelling, number words."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelane.functions.rules import by_text


def _quote(s: str) -> str:
    return re.escape(s).replace("\\ ", " ")


def apply_word_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Whole words replaced, ignoring case, rule after rule (a later rule sees the earlier result). For up to about 50 rules; beyond, see rules.rule_table."""
    for key, value in rules:
        text = F.regexp_replace(text, f"(?iu)(?<![\\p{{L}}\\p{{N}}_]){_quote(key)}(?![\\p{{L}}\\p{{N}}_])", value.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def apply_force_rules(text: Column, rules: list[tuple[str, str, int, int]]) -> Column:
    """Substrings (key, value, spaces before, spaces after) replaced rule after rule."""
    for key, value, before, after in rules:
        text = F.replace(text, F.lit(key), F.lit(" " * before + value + " " * after))
    return text


def normalise_en(text: Column, substrings: list[tuple[str, str]], words: list[tuple[str, str]]) -> Column:
    """Substring rules with a space on both sides, whole-word rules, single spaces, '... ' in front, lower case."""
    t = apply_word_rules(apply_force_rules(text, [(k, v, 1, 1) for k, v in substrings]), words)
    return F.concat(F.lit("... "), F.lower(F.trim(F.regexp_replace(t, "\\s+", " "))))


#: Doubled number words that keep a space where other hyphens go.
DOUBLED = {"egy-egy": "egy egy", "két-két": "két két", "három-három": "három három", "négy-négy": "négy négy", "öt-öt": "öt öt"}


def clean_chars(text: Column, final: list[tuple[str, str]] = ()) -> Column:
    """Symbols *"':()/#@[]{} (fixed values) become spaces, hyphens go but for doubled number words, single spaces; at the end plain replacements in order."""
    t = F.regexp_replace(text, "[*\"':()/#@\\[\\]{}]", " ")
    for pair, apart in DOUBLED.items():
        t = F.regexp_replace(t, f"(?U)\\b{pair}\\b", apart)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "-", ""), "\\s+", " "))
    for old, new in final:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


#: Endings of words.
SUFFIXES = ["t", "n", "ban", "ben", "nak", "nek", "val", "vel", "hoz", "hez", "höz", "ról", "ről", "tól", "től", "ba", "be", "ra", "re", "ig", "ként", "kkal", "kkel", "unk", "ünk", "etek", "tok", "jük", "ások", "ések", "áson", "ésen", "ásban", "ésben", "ással", "éssel"]


def strip_suffix(word: Column) -> Column:
    """The word without '-suffix' of a known suffix, else without its longest listed ending, in any case of letters; something is always left."""
    hyphen = F.regexp_extract(F.trim(word), "(?iu)^(.+)-(" + "|".join(SUFFIXES) + ")$", 1)
    endings = [(F.length(word) > len(s)) & F.endswith(F.lower(word), F.lit(s)) for s in SUFFIXES]
    longest = F.greatest(F.lit(0), *[F.when(e, len(s)).otherwise(0) for e, s in zip(endings, SUFFIXES, strict=True)])
    return F.when(hyphen != "", hyphen).otherwise(F.substring(word, F.lit(1), F.length(word) - longest))


#: Names of letters.
LETTERS = {
    "a": "a", "b": "bé", "c": "cé", "d": "dé", "e": "e", "f": "ef", "g": "gé", "h": "há", "i": "í", "j": "jé", "k": "ká", "l": "el", "m": "em", "n": "en", "o": "ó", "p": "pé", "q": "kú", "r": "er", "s": "ess", "t": "té", "u": "ú", "v": "vé", "w": "dupla vé", "x": "iksz", "y": "ipszilon", "z": "zé",
    "á": "á", "é": "é", "í": "í", "ó": "ó", "ö": "ö", "ő": "ő", "ú": "ú", "ü": "ü", "ű": "ű",
}


def spell_letters(word: Column) -> Column:
    """Letters by their names, joined by spaces; other characters stay as they are."""
    names = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(names[F.lower(c)], c)), " ")


def spell_acronyms(text: Column) -> Column:
    """Words of two or more capitals by the names of their letters, unless all of them are Roman digits."""
    cut = F.split(F.regexp_replace(text, "(?U)\\b(?![IVXLCDM]+\\b)([A-ZÁÉÍÓÖŐÚÜŰ]{2,})\\b", "\u0001$1\u0001"), "\u0001")  # every second part is an acronym
    return F.array_join(F.transform(cut, lambda part, i: F.when(i % 2 == 1, spell_letters(part)).otherwise(part)), "")


_EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_EN_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
_HU = "nulla egy kettő három négy öt hat hét nyolc kilenc".split()
_HU_TENS = "_ tíz húsz harminc negyven ötven hatvan hetven nyolcvan kilencven".split()


#: (size, name) from the largest down: short scale in English, long scale in Hungarian.
SIZES_EN = [(1000 ** (i + 1), name) for i, name in enumerate("thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion".split())][::-1]
SIZES_HU = [(1000, "ezer"), *[(10 ** (6 * i + 3 * half), prefix + end) for i, prefix in enumerate("mi bi tri kvadri kvinti".split(), 1) for half, end in enumerate(("llió", "lliárd"))]][::-1]


def cardinal_en(n: int) -> str:
    if n < 20:
        return _EN[n]
    if n < 100:
        return _EN_TENS[n // 10] + ("-" + _EN[n % 10] if n % 10 else "")
    if n < 1000:
        return _EN[n // 100] + " hundred" + (" and " + cardinal_en(n % 100) if n % 100 else "")
    for size, name in SIZES_EN:
        if n >= size:
            rest = n % size
            return cardinal_en(n // size) + " " + name + ((" and " if rest < 100 else ", ") + cardinal_en(rest) if rest else "")
    return ""


def cardinal_hu(n: int) -> str:
    """Number words: up to 2000 in one word, above with hyphens between groups of thousands."""
    if n < 10:
        return _HU[n]
    if n < 100:
        t, r = divmod(n, 10)
        return _HU_TENS[t] if not r else {1: "tizen", 2: "huszon"}.get(t, _HU_TENS[t]) + _HU[r]
    if n < 1000:
        h, r = divmod(n, 100)
        return ("" if h == 1 else "két" if h == 2 else _HU[h]) + "száz" + (cardinal_hu(r) if r else "")
    for size, name in SIZES_HU:
        if n >= size:
            q, r = divmod(n, size)
            head = ("" if q == 1 and size == 1000 else "két" if q == 2 else cardinal_hu(q)) + name
            return head + (("-" if n > 2000 else "") + cardinal_hu(r) if r else "")
    return ""


CARDINALS: dict[str, Callable[[int], str]] = {"en": cardinal_en, "hu": cardinal_hu}
#: Numbers from here on have no name in the lists above and are left as digits.
MOST = 10**36


def numbers_to_words(rows: DataFrame, lang: str, col: str = "text") -> DataFrame:
    """Adds spoken: whole numbers in the text as words of the language (en, hu); others stay."""
    say = CARDINALS[lang]
    return rows.withColumn("spoken", by_text(lambda t: re.sub(r"\b\d+\b", lambda m: say(int(m[0])) if int(m[0]) < MOST else m[0], t))(F.col(col)))


#: Fixed values of Roman letters.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(s: str) -> int:
    total = 0
    for a, b in zip(s, [*s[1:], ""], strict=True):
        total += -ROMAN[a] if b and ROMAN[b] > ROMAN[a] else ROMAN[a]
    return total


def roman_before_dot(rows: DataFrame, col: str = "text") -> DataFrame:
    """Adds arabic: runs of IVXLCDM before a dot as numbers, without a check of their form."""
    return rows.withColumn("arabic", by_text(lambda t: re.sub(r"[IVXLCDM]+(?=\.)", lambda m: str(roman_value(m[0])), t))(F.col(col)))


def normalise_by_lang(text: Column, lang: Column, registry: dict[str, Callable[[Column], Column]]) -> Column:
    """Each row's text by the normaliser that the registry has for its language, a column function of SQL or of by_text;
    each sees the texts of its own language only. An unknown or null language changes nothing."""
    out = F.when(~F.coalesce(lang.isin(*registry), F.lit(False)), text)
    for name, f in registry.items():
        out = F.coalesce(out, f(F.when(lang == name, text)))
    return out
