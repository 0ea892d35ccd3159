"""Edit distances for recognised text.

The standard distance is Spark's own levenshtein. The weighted one charges less for characters that recognition takes
for each other; it runs over Arrow batches, one numpy step for each cell of the table, over all pairs of a batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of characters that are often confused, by weight; both directions.
CONFUSIONS = {
    0.3: ("0O", "0o", "1l", "1I", "lI", "1|", "l|", "I|", "-–", "-—"),
    0.5: ("5S", "5s", "8B", "2Z", "2z", "Cc", "Ww", ".,", "-_", "kK", "oO", "pP", "sS", "uU", "vV", "xX", "zZ"),
    0.7: ("6G", "9g", "9q", "CG", "cG", "EF", "ec", "HN", "MN", "UV", "uv", "DO", "D0", " _"),
}
SAME_LETTER = 0.3

Weights = Mapping[tuple[str, str], float]


def confusion_weights(custom: Iterable[tuple[str, str, float]] = ()) -> dict[tuple[str, str], float]:
    """The fixed pairs and custom ones, which come on top; no state is shared."""
    pairs = [(p[0], p[1], w) for w, group in CONFUSIONS.items() for p in group] + list(custom)
    return {k: w for a, b, w in pairs for k in ((a, b), (b, a))}


def confusion_table(spark: SparkSession, weights: Weights | None = None) -> DataFrame:
    """c1, c2, weight: a row for each direction."""
    return spark.createDataFrame([(a, b, w) for (a, b), w in (weights or confusion_weights()).items()], "c1 string, c2 string, weight double")


def substitution_cost(a: str, b: str, weights: Weights) -> float:
    """The pair itself, then two letters in lower case."""
    if a == b:
        return 0.0
    found = weights.get((a, b))
    if found is None and a.isalpha() and b.isalpha():
        x, y = a.lower(), b.lower()
        found = SAME_LETTER if x == y else weights.get((x, y))
    return 1.0 if found is None else found


def distances(left: list[str], right: list[str], weights: Weights) -> np.ndarray:
    """Of each pair. Pairs of one shape share the steps over the table."""
    out = np.zeros(len(left))
    groups: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(zip(left, right)):
        groups[len(a), len(b)].append(i)
    letters = sorted(set("".join(left)) | set("".join(right)))
    costs = np.array([[substitution_cost(a, b, weights) for b in letters] for a in letters]).reshape(len(letters), len(letters))
    number = {c: i for i, c in enumerate(letters)}
    for (m, n), rows in groups.items():
        a = np.array([[number[c] for c in left[i]] for i in rows], np.int32).reshape(len(rows), m)
        b = np.array([[number[c] for c in right[i]] for i in rows], np.int32).reshape(len(rows), n)
        last = np.tile(np.arange(n + 1.0), (len(rows), 1))
        for i in range(1, m + 1):
            row = np.empty_like(last)
            row[:, 0] = i
            for j in range(1, n + 1):
                x, y = a[:, i - 1], b[:, j - 1]
                best = np.minimum(np.minimum(last[:, j] + 1, row[:, j - 1] + 1), last[:, j - 1] + costs[x, y])
                row[:, j] = np.where(x == y, last[:, j - 1], best)
            last = row
        out[rows] = last[:, n]
    return out


def weighted_distance(left: Column, right: Column, custom: Iterable[tuple[str, str, float]] = ()) -> Column:
    """The weighted distance of two string columns; null where one is null."""
    weights = confusion_weights(custom)

    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        known = a.notna() & b.notna()
        out = pd.Series(np.nan, index=a.index, dtype=object)
        out[known] = distances(list(a[known]), list(b[known]), weights)
        return out.where(known, None).astype(float)

    return measured(left, right)


def similarity(distance: Column, left: Column, right: Column) -> Column:
    """D3: 1 - distance / the longer length; 1 for two empty strings."""
    longest = F.greatest(F.char_length(left), F.char_length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance / longest.cast("double"))
