"""Distribution measures over a short array (one entry per zone)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _fold(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def total(values: Column) -> Column:
    return _fold(values, lambda x: x)


def distribution(values: Column) -> Column:
    """Non-negative parts scaled to sum to one; uniform when nothing is positive."""
    kept = F.transform(values, lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    whole = total(kept)
    return F.transform(kept, lambda x: F.when(whole > 0, x / whole).otherwise(1.0 / F.size(kept)))


def spatial_freedom(shares: Column) -> Column:
    """Entropy of the shares over its maximum; one for a single zone, null for none."""
    n = F.size(shares)
    entropy = _fold(shares, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    return F.when(n == 1, F.lit(1.0)).when(n > 1, entropy / F.ln(n.cast("double")))


def occupancy_imbalance(shares: Column) -> Column:
    """Half the L1 distance to the uniform distribution; null for no zones."""
    n = F.size(shares)
    return F.when(n > 0, _fold(shares, lambda p: F.abs(p - 1.0 / n)) * 0.5)


def half_l1(left: Column, right: Column) -> Column:
    """Half the L1 distance of two aligned vectors; null when one is missing."""
    return total(F.zip_with(left, right, lambda a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))) * 0.5


def half_l1_maps(left: Column, right: Column) -> Column:
    """Half the L1 distance of two zone→share maps aligned on the union of their zones."""
    gaps = F.map_zip_with(
        left, right, lambda _, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    )
    return total(F.map_values(gaps)) * 0.5


def one_hot(state: Column, size: int) -> Column:
    return F.array(*[F.when(state == i, F.lit(1.0)).otherwise(F.lit(0.0)) for i in range(size)])


def padded(values: Column, index: int) -> Column:
    """Entry ``index`` (from 0) or zero past the end."""
    return F.coalesce(F.try_element_at(values, F.lit(index + 1)), F.lit(0.0))


def dot(values: Column, weights: Column) -> Column:
    return total(F.zip_with(values, weights, lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0))))


def grid_edges(length: Column, parts: int) -> Column:
    """``parts + 1`` integer cell edges from 0 to ``length``."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda i: F.floor(i * length / parts).cast("int"))


def rectangle(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Four-corner polygon, clockwise from the top-left corner."""
    return F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))
