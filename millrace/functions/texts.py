"""Clean-up and extraction rules for articles, answers, code and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_dateline(text: Column) -> Column:
    """An article's body: after the first "-- ", before the mail-a-friend line."""
    body = F.coalesce(F.get(F.split(text, "-- ", 2), F.lit(1)), text)
    return F.trim(F.substring_index(body, " E-mail to a friend", 1))


def two_sections(text: Column, first: str, second: str) -> Column:
    """The texts under two headings, in this order, from the start; null if it isn't so."""
    pattern = rf"(?is)^\s*{first}\s*:?\s*(.*?)\s*{second}\s*:?\s*(.*?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("first"), part(2).alias("second")))


def repaired_ends(text: Column) -> Column:
    """A mark and a full stop become the question mark."""
    return F.replace(F.replace(text, F.lit("?."), F.lit("?")), F.lit("!."), F.lit("?"))


def bad_ends(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[?!:]\."))


def sentence(text: Column) -> Column:
    """Trimmed, the first letter a capital, with a full stop if it ends without a mark."""
    t = F.trim(text)
    cased = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return F.when(t == "", t).when(t.rlike(r"[.!?]$"), cased).otherwise(F.concat(cased, F.lit(".")))


def code_blocks(text: Column) -> Column:
    """HTML and CSS of an answer with exactly two fenced blocks: css from its first line with a brace; else null."""
    parts = F.split(text, "```")
    body = lambda i: F.regexp_replace(F.get(parts, F.lit(i)), r"^[A-Za-z]*\n", "")
    css = F.regexp_extract(body(3), r"(?s)((?:^|(?<=\n))[^\n]*\{.*)$", 1)
    return F.when(F.size(parts) == 5, F.struct(body(1).alias("html"), css.alias("css"), F.regexp_extract(body(1), r"(?is)(<body.*</body>)", 1).alias("body")))


def shared_key(name: Column) -> Column:
    """What names of one object share: the first piece that is a number, or else the sorted pieces."""
    pieces = F.filter(F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), r"[-_.]"), lambda x: x != "")
    number = F.get(F.filter(pieces, lambda x: x.rlike("^[0-9]+$")), F.lit(0))
    return F.coalesce(number, F.array_join(F.array_sort(pieces), "_"))


def gold_answer(text: Column) -> Column:
    """What follows the four hashes, without thousands separators."""
    return F.replace(F.trim(F.get(F.split(text, "####"), F.lit(1))), F.lit(","), F.lit(""))


def cloze_text(text: Column) -> Column:
    """A task text without bracketed notes and with one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), "  +", " "))


def choices(options: Column, answer: Column) -> Column:
    """Options as lettered lines, and the letter of the answer (null if it isn't one of them)."""
    letter = lambda i: F.char(F.lit(65) + i)
    lines = F.array_join(F.transform(options, lambda x, i: F.concat(letter(i), F.lit(". "), x)), "\n")
    at = F.array_position(options, answer)
    return F.struct(lines.alias("lines"), F.when(at > 0, letter(at - 1)).alias("letter"))


def table_text(header: Column, rows: Column) -> Column:
    """A table as lines of cells between bars, the header first."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    return F.concat_ws("\n", line(header), F.array_join(F.transform(rows, line), "\n"))


def boxed(text: str) -> str | None:
    """The contents of the last \\boxed{...}, braces balanced."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 7 : i]
    return None


def final_answer(text: str | None) -> str | None:
    """A solution's answer: boxed, or after "answer is", or the last number."""
    text = text or ""
    if (found := boxed(text)) is not None:
        return plain_math(found)
    if m := re.findall(r"(?i)answer\s+is:?\s*([^\n]+?)(?:\.\s|\.?$)", text, re.M):
        return plain_math(m[-1])
    numbers = re.findall(r"-?\d[\d,]*(?:\.\d+)?", text)
    return plain_math(numbers[-1]) if numbers else None


def plain_math(text: str) -> str:
    """An answer as it is compared: no spacing, dollar or degree signs, units or text wrappers; fractions as a/b."""
    text = text.strip().rstrip(".").replace("\\!", "").replace("\\,", "").replace("\\$", "").replace("$", "")
    text = text.replace("\\left", "").replace("\\right", "").replace("\\%", "").replace("%", "")
    text = re.sub(r"\^\{?\\circ\}?|\\degree", "", text)
    text = re.sub(r"\\(?:text|mbox|mathrm|textbf)\{([^{}]*)\}", lambda m: "" if text.strip() != m[0] and m[1].strip().isalpha() else m[1], text)
    text = re.sub(r"\\[dt]frac", r"\\frac", text)
    text = re.sub(r"\\frac\s*(\d)\s*(\d)", r"\\frac{\1}{\2}", text)
    text = re.sub(r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"(\1)/(\2)", text)
    text = re.sub(r"\((-?[\w.]+)\)/\((-?[\w.]+)\)", r"\1/\2", text)
    text = re.sub(r"\\sqrt\s*(\w)", r"\\sqrt{\1}", text)
    text = re.sub(r"^[a-zA-Z]\s*=\s*", "", text)
    if re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.\d+)?", text.strip()):
        text = text.replace(",", "")
    text = re.sub(r"\s+", "", text)
    if re.fullmatch(r"-?\.\d+", text):
        text = text.replace(".", "0.", 1)
    return text[:-2] if re.fullmatch(r"-?\d+\.0", text) else text


def same_answer(a: str | None, b: str | None) -> bool:
    """Equal as plain text or as numbers."""
    if a is None or b is None:
        return False
    a, b = plain_math(a), plain_math(b)
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) < 1e-6
    except ValueError:
        return False


def rouge_l(prediction: str | None, reference: str | None) -> float:
    """F1 of the longest common subsequence of words."""
    a, b = (prediction or "").lower().split(), (reference or "").lower().split()
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    n = row[-1]
    return 2 * n / (len(a) + len(b)) if n else 0.0


def bleu(prediction: str | None, reference: str | None, longest: int = 4) -> float:
    """Geometric mean of clipped n-gram precisions with the brevity penalty, unsmoothed."""
    import math
    from collections import Counter

    a, b = (prediction or "").split(), (reference or "").split()
    logs = 0.0
    for n in range(1, longest + 1):
        said = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        held = Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        hit = sum((said & held).values())
        if not hit:
            return 0.0
        logs += math.log(hit / sum(said.values()))
    return math.exp(logs / longest) * min(1.0, math.exp(1 - len(b) / len(a)))


def candidates(response: str | None) -> list:
    """What an open answer may mean: its numbers, and its last statement's words in lower case."""
    text = (response or "").strip()
    numbers = [float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*(?:\.\d+)?", text)]
    tail = re.split(r"(?i)\b(?:so|is|are|thus|therefore|final|answer|result)\b:?", text)[-1].strip(" .\n").lower()
    return [*dict.fromkeys(numbers), *([tail] if tail else [])]


def open_answer_correct(response: str | None, answers: list[str]) -> bool:
    """Whether a candidate equals an answer as a number, or holds it as text."""
    found = candidates(response)
    for a in answers:
        try:
            number = float(a.replace(",", ""))
        except ValueError:
            if any(isinstance(c, str) and a.lower() in c for c in found):
                return True
        else:
            if any(isinstance(c, float) and abs(c - number) < 5e-3 for c in found):
                return True
    return False


def trigrams(name: Column) -> Column:
    """The distinct three-letter pieces of a name, its ends marked."""
    t = F.concat(F.lit("^"), F.lower(name), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
