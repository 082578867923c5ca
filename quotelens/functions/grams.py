"""Word-bounded character n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All grams of length low..high inside words padded by one blank on each side.

    A padded word not longer than n gives itself once and no longer grams.
    """
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)
        lengths = F.filter(
            F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: (n == low) | (n - 1 < size)
        )
        return F.flatten(F.transform(lengths, lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(padded, i, n)
        )))

    return F.flatten(F.transform(words, of_word))
