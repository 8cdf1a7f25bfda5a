"""Hungarian spelling of phoneme tokens, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spelling of a phoneme. A colon marks a long one.
SINGLE = {
    "a": "a", "a:": "á", "ɑ": "a", "ɑ:": "á", "ɐ": "a", "ɒ": "a", "ɒ:": "á", "ʌ": "a",
    "e": "e", "e:": "é", "ɛ": "e", "ɛ:": "é", "æ": "e", "ə": "ö", "ɜ": "ö", "ɜ:": "őr", "ɚ": "ör", "ɝ": "őr",
    "i": "i", "i:": "í", "ɪ": "i", "ɪ:": "í",
    "o": "o", "o:": "ó", "ɔ": "o", "ɔ:": "ó", "ɞ": "ö",
    "u": "u", "u:": "ú", "ʊ": "u", "ʊ:": "ú",
    "2": "ö", "2:": "ő", "y": "ü", "y:": "ű", "ø": "ö", "ø:": "ő",
    "ju": "ju", "ju:": "jú", "jʊ": "jü",
    "aɪ": "áj", "aI": "áj", "eɪ": "éj", "eI": "éj", "oʊ": "ó", "oU": "ó", "uə": "ua",
    "əʊ": "ó", "aʊ": "au", "aU": "au", "ɔɪ": "oj", "OI": "oj", "ɪʊ": "iu",
    "ɪə": "ia", "iə": "ia", "eə": "eö", "ʊə": "ua",
    "r": "r", "ɹ": "r", "R": "r", "ɾ": "r", "l": "l", "ɫ": "l", "L": "ly", "j": "j", "J": "j", "ʎ": "j",
    "m": "m", "n": "n", "N": "ny", "ŋ": "ng", "ɲ": "ny", "n̩": "an", "m̩": "m",
    "p": "p", "b": "b", "pʰ": "p", "bʰ": "b", "t": "t", "d": "d", "tʰ": "t", "dʰ": "d",
    "k": "k", "g": "g", "ɡ": "g", "kʰ": "k", "gʰ": "g", "f": "f", "v": "v", "w": "v", "ʍ": "hu",
    "s": "sz", "S": "s", "ʃ": "s", "ʂ": "s", "z": "z", "Z": "zs", "ʒ": "zs", "ʐ": "zs",
    "ts": "c", "dz": "dz", "dʒ": "dzs", "dZ": "dzs", "tʃ": "cs", "tS": "cs",
    "h": "h", "x": "x", "χ": "h", "θ": "sz", "ð": "z", "β": "v", "ɣ": "g", "ʔ": "tt", "ɸ": "f", "ʋ": "v",
}
#: Spelling of two neighbouring phonemes.
PAIRS = {
    "d ʒ": "dzs", "t ʃ": "cs", "d Z": "dzs", "t S": "cs", "j u": "ju", "j ʊ": "jü", "i ə": "ia", "i e": "ie", "ə ʊ": "ó",
    "ə ɹ": "er", "ɑ ɹ": "ar", "ɒ ɹ": "ar", "ɔ ɹ": "or", "ɔ: ɹ": "or", "o: ɹ": "or", "a: ɹ": "ár",
}
#: Replacements in the whole spelling (patterns), in this order, and of characters left over.
SEQUENCES = {"mju": "mu", "mjú": "mu", "mj": "m", "árk": "ark", "ziam": "zeum", "ziem": "zeum", "ziom": "zeum", "ingtan": "ington", "han$": "hatán", "ávn": "ovn", "ávan": "ovn"}
LEFT_OVER = {"ɑ": "a", "ɒ": "a", "ɔ": "o", "ɹ": "r", "ʔ": "", "̩": "", "ɡ": "g", "ʃ": "s", "ʒ": "zs", "|": "", "ø": "ö"}
#: Tokens without a sound.
SILENT = ["", "ˈ", "ˌ", "."]


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _spelt(token: Column) -> Column:
    """One phoneme: as listed; a long one that is not listed as its short one with the last letter doubled; in lower case; else itself without colons."""
    single, short = _table(SINGLE), F.rtrim(token, F.lit(":"))
    long = F.when(F.endswith(token, F.lit(":")), F.coalesce(single[F.concat(short, F.lit(":"))], F.concat(single[short], F.right(single[short], F.lit(1)))))
    return F.coalesce(single[token], long, single[F.lower(token)], F.replace(token, F.lit(":"), F.lit("")))


def phonemes_to_hu(tokens: Column) -> Column:
    """Spelling of an array of phoneme tokens; null if nothing is said (null, empty or silent tokens only).

    From left to right a token and its neighbour are spelt as a pair if they are listed as one, else the token alone.
    The fold holds back one token until its neighbour is seen.
    """
    clean = F.transform(tokens, lambda t: F.when(F.trim(t).isin(SILENT), "").otherwise(F.regexp_replace(F.replace(F.coalesce(F.trim(t), F.lit("")), F.lit("ː"), F.lit(":")), "\\|", "")))
    pairs = _table(PAIRS)

    def step(at: Column, token: Column) -> Column:
        pair = pairs[F.concat_ws(" ", at["held"], token)]
        return F.when(pair.isNotNull(), F.struct(F.concat(at["said"], pair).alias("said"), F.lit("").alias("held"))).otherwise(F.struct(F.concat(at["said"], _spelt(at["held"])).alias("said"), token.alias("held")))

    said = F.aggregate(clean, F.struct(F.lit("").alias("said"), F.lit("").alias("held")), step, lambda at: F.concat(at["said"], _spelt(at["held"])))
    out = said
    for pattern, new in SEQUENCES.items():
        out = F.regexp_replace(out, pattern, new)
    out = F.lower(out)
    for old, new in LEFT_OVER.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(said != "", out)
