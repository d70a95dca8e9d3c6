"""Image hashes on grey pixels, and content keys on bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def perceptual_hash(grey) -> int:
    """64 bits: the low frequencies of a 32 x 32 grey picture against their median, the mean left out of it."""
    import numpy as np

    x = np.asarray(grey, dtype=np.float64).reshape(32, 32)
    k, n = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    cosine = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = (cosine @ x @ cosine.T)[:8, :8]
    bits = (low >= np.median(low.reshape(-1)[1:])).reshape(-1)
    return int(np.packbits(bits).view(">u8")[0])


def average_hash(grey) -> str:
    """100 bits as hex: pixels of a 10 x 10 grey picture above their mean."""
    import numpy as np

    x = np.asarray(grey, dtype=np.float64).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in x > x.mean()), 2):025x}"


def difference_hash(grey) -> int:
    """64 bits: whether each of 9 x 8 pixels outshines the one to its left."""
    import numpy as np

    x = np.asarray(grey, dtype=np.float64).reshape(8, 9)
    return int(np.packbits((x[:, 1:] > x[:, :-1]).reshape(-1)).view(">u8")[0])


def content_key(images: Column) -> Column:
    """One key for a list of image bytes: their MD5 sums in order."""
    return F.array_join(F.transform(images, lambda b: F.md5(b)), "")


def wavelet_hash(grey) -> int:
    """64 bits: an 8 x 8 grey picture's Haar coefficients, the mean left out, against their median."""
    import numpy as np

    x = np.asarray(grey, dtype=np.float64).reshape(8, 8).copy()
    n = 8
    while n > 1:
        for _ in range(2):  # rows, then columns
            even, odd = x[:n, 0:n:2].copy(), x[:n, 1:n:2].copy()
            x[:n, : n // 2], x[:n, n // 2 : n] = (even + odd) / 2, (even - odd) / 2
            x = x.T
        n //= 2
    flat = x.reshape(-1)
    return int(np.packbits(flat > np.median(flat[1:])).view(">u8")[0])


def hash_column(f):
    """A hash of grey pixels as a function of an array column; 64 bits come as 16 hex digits."""
    @F.pandas_udf("string")
    def run(grey: pd.Series) -> pd.Series:
        shown = lambda h: h if isinstance(h, str) else f"{h:016x}"
        return grey.map(lambda x: None if x is None else shown(f(x)))

    return run


def difference_bits(grey: Column, width: int = 9, height: int = 8) -> Column:
    """``difference_hash`` as a text of bits, by array expressions."""
    at = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    left = lambda i: (F.floor(i / (width - 1)) * width + i % (width - 1)).cast("int")
    bits = lambda g: F.transform(at, lambda i: F.when(F.get(g, left(i) + 1) > F.get(g, left(i)), "1").otherwise("0"))
    # Bound once: a lambda would work out all pixels again for each that it compares.
    return F.array_join(F.transform(F.array(grey), bits)[0], "")
