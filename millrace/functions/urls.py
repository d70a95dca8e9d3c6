"""URL parts and checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A usable http(s) address: scheme, a dotted or local host or an IPv4 number, an optional port and path.
VALID = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,}\.?|localhost|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::[0-9]+)?(?:[/?#][^ ]*)?$"


def netloc(url: Column) -> Column:
    """The authority with port and user, as written; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(VALID), F.lit(False))


def absolute(src: Column, page: Column) -> Column:
    """A media address made absolute against its page."""
    rest = F.regexp_replace(F.regexp_replace(src, r"^(\./)+", ""), "^/", "")
    return F.when(src.startswith("//"), F.concat(F.lit("http:"), src)).when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), src).otherwise(F.concat(F.lit("https://"), netloc(page), F.lit("/"), rest))


def file_words(url: Column) -> Column:
    """The words of a file name: extension, separators and lone digits gone."""
    name = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z]+", " "), " +", " "))


def size_in_pixels(value: Column) -> Column:
    """A width or height attribute as a number: px and plain numbers; null for %, auto and the rest."""
    return F.regexp_extract(F.lower(F.trim(value)), r"^([0-9]+(?:\.[0-9]+)?)(?:px)?$", 1).try_cast("double")


def resolved_percent(value: Column, original: Column) -> Column:
    """A percentage of the original size, half to even; null where it isn't one."""
    share = F.regexp_extract(F.trim(value), r"^([0-9]+)%$", 1).try_cast("int")
    return F.bround(original * share / 100)
