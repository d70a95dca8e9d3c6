"""Numeric transforms and arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arcsinh_scaled(flux: Column, scale: Column, limit: float = 20.0) -> Column:
    """Flux squeezed by arcsinh of its scale and clamped; ``flux_of`` takes it back."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.asinh(flux / scale)))


def flux_of(value: Column, scale: Column) -> Column:
    return F.sinh(value) * scale


def per_frequency(flux: Column, wavelength: Column) -> Column:
    """Flux per wavelength as flux per frequency, in squeezed form: arrays in, array out."""
    return F.zip_with(flux, wavelength, lambda f, w: F.asinh(f * w * w / 2.99792458e18))


def clean_number(value: Column, warned: Column | None = None) -> Column:
    """Null for NaN, infinities and values under a warning."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~(bad if warned is None else bad | F.coalesce(warned, F.lit(False))), value)


def gram_id(ids: Column, vocabulary: int) -> Column:
    """One number for a sequence of up to four word ids: digits in a base of the vocabulary's size."""
    powered = F.transform(ids, lambda x, i: (x + 1).cast("long") * F.pow(F.lit(float(vocabulary)), i.cast("double")).cast("long"))
    return F.aggregate(powered, F.lit(0).cast("long"), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))


def length_weight(n: Column, kind: str) -> Column:
    """What a sample counts in a loss: by token, by sample, or by the root between them."""
    return {"token": F.lit(1.0), "sample": 1.0 / n, "square": 1.0 / F.sqrt(n)}[kind]


def to_multiple(value: Column, factor: int, how: str = "round") -> Column:
    f = {"round": F.bround, "ceil": F.ceil, "floor": F.floor}[how]
    return (f(value / factor) * factor).cast("long")


def patches(values: Column, size: int) -> Column:
    """An array in runs of ``size``; a rest that doesn't fill one is left out."""
    n = F.floor(F.size(values) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * size + 1, size)))


def standardised(values: Column) -> Column:
    """Less the mean, over the standard deviation (of a constant: zeros)."""
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  (a lambda would work its outer values out again for each element)
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n
    return bound(mean, lambda m: bound(var(m), lambda v: F.transform(values, lambda x: F.when(v > 0, (x - m) / F.sqrt(v)).otherwise(0.0))))


def spiral(side: int) -> list[int]:
    """Row-major places of a square grid from the middle outwards, turning right, down, left, up."""
    y = x = (side - 1) // 2
    out, step, turn = [], 1, 0
    moves = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if 0 <= y < side:
        out.append(y * side + x)
    while len(out) < side * side:
        for _ in range(2):
            dy, dx = moves[turn % 4]
            for _ in range(step):
                y, x = y + dy, x + dx
                if 0 <= y < side and 0 <= x < side:
                    out.append(y * side + x)
            turn += 1
        step += 1
    return out


def reordered(values: Column, order: list[int]) -> Column:
    return F.transform(F.array(values), lambda v: F.transform(F.array(*map(F.lit, order)), lambda i: F.get(v, i)))[0]


def minutes_seconds(frame: Column, rate: float) -> Column:
    s = F.floor(frame / rate)
    return F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def perplexity(log_scores: Column, words: Column) -> Column:
    """10 to the minus summed log10 scores of lines over their words and ends, to one digit."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = total(F.transform(words, lambda x: x + 1.0))
    return F.when(n > 0, F.round(F.pow(F.lit(10.0), -total(log_scores) / n), 1))
