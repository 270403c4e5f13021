"""Vectors as bit masks: counts of places where two vectors agree become bit counts, inside generated code.

A vector of small integers over channels is cut into slices: for histograms a slice a bin, whose bit k says that channel k
is in it; for products a slice a binary digit of the numbers. A slice is one long for each 64 channels. What two vectors
share in two slices is bit_count(a & b), so that a pair costs no array, no row a channel, and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def words(channels: int) -> int:
    return max(1, -(-channels // WORD))


def _mask(values: str, word: int, test: str) -> Column:
    """The long whose bit k is set where entry 64 word + k, v, passes a test; null for a null array."""
    bits = f"transform(slice({values}, {word * WORD + 1}, {WORD}), (v, k) -> if({test}, shiftleft(1L, k), 0L))"
    return F.expr(f"aggregate({bits}, 0L, (s, b) -> s | b)")


def bin_slices(bins: str, n: int, channels: int, name: str) -> dict[str, Column]:
    """Columns name_i_w of an array column of bins: the channels of word w whose bin is i."""
    return {f"{name}_{i}_{w}": _mask(bins, w, f"v = {i}") for i in range(n) for w in range(words(channels))}


def digit_slices(numbers: str, digits: int, channels: int, name: str) -> dict[str, Column]:
    """Columns name_p_w of an array column of whole numbers, 0 or more: the channels of word w that have binary digit p."""
    return {f"{name}_{p}_{w}": _mask(numbers, w, f"v & {1 << p}L <> 0") for p in range(digits) for w in range(words(channels))}


def _shared(a: str, b: str, channels: int) -> str:
    return " + ".join(f"bit_count({a}_{w} & {b}_{w})" for w in range(words(channels)))


# Expressions of many terms are written as SQL: a plan of some hundred small columns takes longer to build than to run.


def joint_counts(a: str, b: str, n: int, channels: int) -> dict[str, Column]:
    """Columns _ci_j: counts of channels by the bins of two vectors, from their bin_slices()."""
    return {f"_c{i}_{j}": F.expr(f"CAST({_shared(f'{a}_{i}', f'{b}_{j}', channels)} AS DOUBLE)") for i in range(n) for j in range(n)}


def with_information(pairs: DataFrame, a: str, b: str, n: int, channels: int, alpha: float, eps: float, name: str = "mi") -> DataFrame:
    """pairs with their mutual information in nats over n x n bins, each count raised by alpha; never negative."""
    cells, side = joint_counts(a, b, n, channels), range(n)
    raised = f"{n * alpha!r}D"
    sides = {f"_x{i}": F.expr(" + ".join([raised, *[f"_c{i}_{j}" for j in side]])) for i in side} | {f"_y{j}": F.expr(" + ".join([raised, *[f"_c{i}_{j}" for i in side]])) for j in side}
    summed = pairs.withColumns(cells).withColumns(sides).withColumn("_t", F.expr(" + ".join(f"_x{i}" for i in side)))
    terms = []
    for i in side:
        for j in side:
            share = f"((_c{i}_{j} + {alpha!r}D) / _t)"
            term = f"{share} * ln({share} / (_x{i} / _t * (_y{j} / _t) + {eps!r}D))"
            terms.append(term if alpha > 0 else f"CASE WHEN _c{i}_{j} > 0 THEN {term} ELSE 0D END")
    return summed.withColumn(name, F.expr(f"greatest({' + '.join(terms)}, 0D)")).drop(*cells, *sides, "_t")


def agreement(a: str, b: str, n: int, channels: int) -> Column:
    """Number of channels where two vectors' bins agree."""
    return F.expr(" + ".join(_shared(f"{a}_{i}", f"{b}_{i}", channels) for i in range(n)))


def product(a: str, b: str, digits: int, channels: int) -> Column:
    """Exact inner product of two vectors of whole numbers, from their digit_slices()."""
    return F.expr(" + ".join(f"CAST({_shared(f'{a}_{p}', f'{b}_{q}', channels)} AS BIGINT) * {1 << (p + q)}L" for p in range(digits) for q in range(digits)))
