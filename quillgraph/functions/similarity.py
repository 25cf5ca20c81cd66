"""String similarities without a built-in counterpart, in Arrow batches."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two texts, without the junk heuristic for long ones."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one that starts at a matching block."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    best = 0.0
    for _, j, _ in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        lo = max(0, j - len(a) + 1)
        for start in {max(0, min(j, len(b) - len(a))), lo}:
            best = max(best, ratio(a, b[start:start + len(a)]))
    return best


def composite(a: str, b: str) -> float:
    """Weighted mix of ratio, sorted tokens, best window and word overlap; equal texts give 1."""
    x, y = a.lower(), b.lower()
    if x == y:
        return 1.0
    score = 0.3 * ratio(x, y) + 0.3 * token_sort(x, y) + 0.2 * partial(x, y)
    s, t = set(x.split()), set(y.split())
    return score + 0.2 * len(s & t) / len(s | t) if s and t else score


def weighted(a: str, b: str, least: float = 0.0) -> float:
    """Weighted ratio after the published scheme: full, sorted-token and, for texts of different length, scaled window ratios.

    A pair whose characters alone rule out ``least`` gives that upper bound instead.
    """
    x, y = a.lower(), b.lower()
    if not x or not y:
        return 0.0
    bound = SequenceMatcher(None, x, y, autojunk=False).quick_ratio()
    if bound < least and max(len(x), len(y)) < 1.5 * min(len(x), len(y)):
        return bound
    base = ratio(x, y)
    long = max(len(x), len(y)) / min(len(x), len(y))
    if long < 1.5:
        return max(base, 0.95 * token_sort(x, y))
    scale = 0.9 if long <= 8 else 0.6
    shared = sum((Counter(x) & Counter(y)).values()) / min(len(x), len(y))
    if max(scale * shared, bound) < least:  # no window of the longer text can reach it
        return max(scale * shared, bound)
    return max(base, scale * partial(x, y), 0.95 * scale * partial(" ".join(sorted(x.split())), " ".join(sorted(y.split()))))


def _vector(fn):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for p in zip(a, b, strict=True):
            if p not in memo:
                memo[p] = None if p[0] is None or p[1] is None else fn(*p)
            out.append(memo[p])
        return pd.Series(out, dtype="float64")

    return run


ratio_udf = _vector(ratio)
composite_udf = _vector(composite)


def weighted_above(least: float):
    """The weighted ratio, exact for pairs that reach ``least``."""
    return _vector(lambda a, b: weighted(a, b, least))
