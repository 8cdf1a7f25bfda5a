"""Hungarian spoken forms of times, dates, ordinals and mixed words, and the whole chain over different texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelane.functions.normalise import DOUBLED, LETTERS, MOST, cardinal_hu, roman_value
from cuelane.functions.rules import RuleTrie, by_text

#: Names of months, ordinals that are not built from the cardinal, and endings of the last number word.
MONTHS = "január február március április május június július augusztus szeptember október november december".split()
SHORT_MONTHS = {"jan.": 1, "feb.": 2, "márc.": 3, "már.": 3, "ápr.": 4, "máj.": 5, "jún.": 6, "júl.": 7, "aug.": 8, "szept.": 9, "szep.": 9, "okt.": 10, "nov.": 11, "dec.": 12}
ROMAN_MONTHS = {r: i for i, r in enumerate("I II III IV V VI VII VIII IX X XI XII".split(), 1)}
ORDINALS = {1: "első", 2: "második"}
ORDINAL_ENDS = {"nulla": "nulladik", "egy": "egyedik", "kettő": "kettedik", "három": "harmadik", "négy": "negyedik", "öt": "ötödik", "hat": "hatodik", "hét": "hetedik", "nyolc": "nyolcadik", "kilenc": "kilencedik", "tíz": "tizedik", "húsz": "huszadik", "harminc": "harmincadik", "negyven": "negyvenedik", "ötven": "ötvenedik", "hatvan": "hatvanadik", "hetven": "hetvenedik", "nyolcvan": "nyolcvanadik", "kilencven": "kilencvenedik", "száz": "századik", "ezer": "ezredik", "llió": "lliomodik", "lliárd": "lliárdodik"}
#: Days as said in dates, where they are not the ordinal with the ending of possession.
DAYS = {1: "elseje"}


def ordinal_hu(n: int) -> str:
    if n in ORDINALS:
        return ORDINALS[n]
    word = cardinal_hu(n)
    end = max((e for e in ORDINAL_ENDS if word.endswith(e)), key=len)
    return word[: len(word) - len(end)] + ORDINAL_ENDS[end]


def day_hu(n: int) -> str:
    word = ordinal_hu(n) if n != 2 else "második"
    return DAYS.get(n, word + ("a" if set(word) & set("aáoóuú") else "e"))


def times_hu(text: str) -> str:
    """H:MM, H:MM:SS, with -kor, in words; zero minutes before seconds are left out. Of the two wordings of hours and minutes a hash of the text in question picks one."""

    def say(m: re.Match) -> str:
        hour, minute = cardinal_hu(int(m[1])), int(m[2])
        if m[3]:
            out = f"{hour} óra {cardinal_hu(minute) if minute else ''} perc {cardinal_hu(int(m[3]))} másodperc"
        elif not minute:
            out = f"{hour} óra"
        else:
            out = f"{hour} óra {cardinal_hu(minute)} perc" if zlib.crc32(m[0].encode()) % 2 else f"{hour} {cardinal_hu(minute)}"
        return out + ("kor" if m[4] else "")

    # fixed value: the form of a time
    return re.sub(r"(\d{1,2}):(\d{2})(?::(\d{2}))?(-kor)?\b", say, text)


#: Fixed value: the form of a word of letters and digits; small letters with accents are no part of it, so that days and numbers with endings are not taken.
_MIXED = re.compile(r"\b(?=[A-Za-zÁÉÍÓÖŐÚÜŰ\d-]*\d)(?=[A-Za-zÁÉÍÓÖŐÚÜŰ\d-]*[A-Za-zÁÉÍÓÖŐÚÜŰ])[A-Za-zÁÉÍÓÖŐÚÜŰ\d-]+\b")


def alphanumeric_hu(text: str) -> str:
    """Words of letters and digits: letters by name, numbers in words; a hyphen is a space and letters after it stay."""

    def say(m: re.Match) -> str:
        out, after_hyphen = [], False
        for part in re.findall(r"\d+|[^\W\d_]+|-", m[0]):
            if part.isdigit():
                out.append(cardinal_hu(int(part)) if int(part) < MOST else part)
            elif part != "-":
                out.append(part if after_hyphen else " ".join(LETTERS.get(c.lower(), c) for c in part))
            after_hyphen = part == "-"
        return " ".join(out)

    return _MIXED.sub(say, text)


_SHORT = "|".join(map(re.escape, sorted(SHORT_MONTHS, key=len, reverse=True)))
#: Every way to write a month in a dotted date, with the month's number.
_MONTH_NUMBER = {m: i for i, m in enumerate(MONTHS, 1)} | SHORT_MONTHS | {f"{r}.": i for r, i in ROMAN_MONTHS.items()}
#: Dates with dots (the day ends in a dot or, after a short month, in an ending), and dates with hyphens.
_DOTTED = re.compile(rf"\b(\d{{4}})\.\s*({'|'.join(MONTHS)}|{_SHORT}|\d{{1,2}}\.|[IVX]+\.)\s*(\d{{1,2}})\.(?!\d)")
_ENDED = re.compile(rf"\b(\d{{4}})\.\s*({_SHORT})\s*(\d{{1,2}})-([a-záéíóöőúüű]+)\b")
_HYPHENS = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})(?!\d)")
_DAY = re.compile(r"\b(\d{1,2})-(án|én)\b")
_MONTH = re.compile(rf"(?<!\w)({_SHORT})(?!\w)")


def dates_hu(text: str) -> str:
    """Dates in words: year, month (name, short name, number or Roman numeral) and day with dots, and with hyphens; an
    ending after a short month's day is added as it is. Then days with -án or -én as ordinals, and short months by
    their names. Impossible dates stay, but for their short months."""

    def say(m: re.Match) -> str:
        number = m[2].rstrip(".")
        month, day = int(number) if number.isdigit() else _MONTH_NUMBER.get(m[2], 0), int(m[3])
        if not (1 <= month <= 12 and 1 <= day <= 31):
            return m[0]
        return f"{cardinal_hu(int(m[1]))} {MONTHS[month - 1]} {day_hu(day)}" + "".join(m.groups()[3:])

    for shape in (_DOTTED, _HYPHENS, _ENDED):
        text = shape.sub(say, text)
    text = _DAY.sub(lambda m: ordinal_hu(int(m[1])) + m[2], text)
    return _MONTH.sub(lambda m: MONTHS[SHORT_MONTHS[m[1]] - 1], text)


def ordinals_hu(text: str) -> str:
    """Numbers of up to three, or of five and more digits, before a dot that does not end the sentence; numbers without a name stay."""
    # fixed value: the form of an ordinal
    return re.sub(r"\b(\d{1,3}|\d{5,})\.(?!\s*$|\s*[.!?])", lambda m: ordinal_hu(int(m[1])) if int(m[1]) < MOST else m[0], text)


def numbers_hu(text: str) -> str:
    return re.sub(r"\b\d+\b", lambda m: cardinal_hu(int(m[0])) if int(m[0]) < MOST else m[0], text)


def roman_hu(text: str) -> str:
    return re.sub(r"[IVXLCDM]+(?=\.)", lambda m: str(roman_value(m[0])), text)


def clean_hu(text: str, final: list[tuple[str, str]] = ()) -> str:
    """Symbols (fixed values) to spaces, hyphens go but for doubled number words, single spaces; at the end plain replacements in order."""
    text = re.sub(r"[*\"':()/#@\[\]{}]", " ", text)
    text = re.sub(rf"\b({'|'.join(DOUBLED)})\b", lambda m: DOUBLED[m[0]], text)
    text = re.sub(r"\s+", " ", text.replace("-", "")).strip()
    for old, new in final:
        text = text.replace(old, new)
    return text


def normalise_text(text: str, words: list[tuple[str, str]] | RuleTrie = (), force: list[tuple[str, str, int, int]] = (), final: list[tuple[str, str]] = ()) -> str:
    """Roman numerals, times, word rules, forced rules, mixed words, dates, ordinals, numbers, clean-up, final replacements, in this order."""
    text = times_hu(roman_hu(text))
    text = (words if isinstance(words, RuleTrie) else RuleTrie(list(words))).apply(text)
    for key, value, before, after in force:
        text = text.replace(key, " " * before + value + " " * after)
    return clean_hu(numbers_hu(ordinals_hu(dates_hu(alphanumeric_hu(text)))), final)


def over_texts(rows: DataFrame, rule: Callable[[str], str], name: str, col: str = "text") -> DataFrame:
    """Adds name: rule of the text, done once per different text of a batch; null stays null."""
    return rows.withColumn(name, by_text(rule)(F.col(col)))


def normaliser(words: list[tuple[str, str]] = (), force: list[tuple[str, str, int, int]] = (), final: list[tuple[str, str]] = ()) -> Callable[[Column], Column]:
    """normalise_text as a column function, for a registry of languages."""
    trie = RuleTrie(list(words))
    return by_text(lambda t: normalise_text(t, trie, force, final))
