"""Words, characters and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters beyond ASCII that are special, some of them blanks: fixed values.
OTHER_SPECIAL = (
    "    　    ￼’“”–ー一▬…✦�­£​•€«»°·═"
    "×士＾˘⇓↓↑←→（）§″′´¿−±∈﻿¢ø‚„½¼¾¹²³―⁃，ˌ¸‹›ʺˈʻ¦‐⠀‰‑≤≥‖"
    "◆●■►▼▲▴∆▻¡★☆✱ːº。¯˜¥ɪ≈†上ン：∼⁄・♡✓⊕․．⋅÷１‟；،、¨ाাी्े◦˚"
    "゜ʼ≖ʼ¤ッツシ℃√！【】‿∞➤～πه۩☛₨➩☻๑٪♥ıॽ《‘©﴿٬？▷Г♫∟™ª₪®「—❖"
    "」﴾》"
)
#: Emoji of one character, by the blocks that hold them.
EMOJI = r"\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{25FB}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
#: Inside a character class: ASCII punctuation, digits and blanks, the characters above and emoji.
SPECIAL = r"\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E" + OTHER_SPECIAL + EMOJI
#: Blanks that count as a space when texts are normalised: fixed values.
SPACES = "\u00a0\u0084\ufffc\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Unicode punctuation and its plain form: fixed values.
PUNCTUATION = {"，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-"}


def split_words(text: Column) -> Column:
    """Pieces between single spaces, line ends and tabs; no other blank separates."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \n\t]"), lambda x: x != "")


def strip_special(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, f"^[{SPECIAL}]+", ""), f"[{SPECIAL}]+$", "")


def _low(special: bool) -> str:
    """The characters below 256 that are special, or the others, one by one."""
    ascii_special = [*range(0x09, 0x0E), *range(0x20, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
    return "".join(f"\\x{c:02X}" for c in range(256) if (c in ascii_special or chr(c) in OTHER_SPECIAL) == special)


#: The classes ``[^SPECIAL]`` and ``[SPECIAL]`` with characters below 256 listed, which Java looks up in one table;
#: the members of SPECIAL, some 200, it asks one inside another for every character.
PLAIN_CLASS, SPECIAL_CLASS = rf"[{_low(False)}[[^\x00-\xFF]&&[^{SPECIAL}]]]", rf"[{_low(True)}[[^\x00-\xFF]&&[{SPECIAL}]]]"
#: From a character that isn't special to the last such one before a space, line end or tab.
WORD = f"{PLAIN_CLASS}(?:[^ \n\t]*{PLAIN_CLASS})?"


def words(text: Column) -> Column:
    """Lower-cased words without special characters at their ends, by one expression over the text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def standard_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, " " * len(SPACES))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1F\x7F-\x9F]", "")


def zero_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "0")


def plain_punctuation(text: Column) -> Column:
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for k, v in PUNCTUATION.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def normalise(text: Column, lower: bool = True, spaces: bool = True, digits: bool = True, punctuation: bool = True, unprintable: bool = False) -> Column:
    """The steps asked for, in this order; removing unprintable characters takes line ends too, so it is off."""
    text = F.lower(text) if lower else text
    text = F.trim(standard_spaces(text)) if spaces else text
    text = zero_digits(text) if digits else text
    text = plain_punctuation(text) if punctuation else text
    return printable(text) if unprintable else text


def ngrams(tokens: Column, n: int) -> Column:
    """The n-word sequences of an array of words, space-joined; none if there are fewer words."""
    size = F.size(tokens)
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))
