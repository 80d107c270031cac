"""Array expressions: softmax, entropy, norms, argmax."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def scaled_to_one(arr: Column, floor: float = 0.0) -> Column:
    """Elements divided by their sum (never by less than ``floor``)."""
    return let(arr, lambda a: let(F.greatest(total(a), F.lit(floor)), lambda s: F.transform(a, lambda x: x / s)))


def softmax(arr: Column, temperature: float | Column = 1.0) -> Column:
    """Numerically stable softmax of ``arr / temperature``."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return let(arr, lambda a: let(F.array_max(a), lambda m: scaled_to_one(
        F.transform(a, lambda x: F.exp((x - m) / t)))))


def temperature_softmax(arr: Column, temperature: float | Column) -> Column:
    """Softmax with the temperature kept above 0.001."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return softmax(arr, F.greatest(t, F.lit(1e-3)))


def argmax(arr: Column) -> Column:
    """0-based position of the first largest element."""
    return let(arr, lambda a: F.array_position(a, F.array_max(a)) - 1).cast("int")


def entropy(arr: Column, eps: float = 1e-10) -> Column:
    return -F.aggregate(arr, F.lit(0.0), lambda acc, p: acc + p * F.log(p + eps))


def clipped_entropy(arr: Column) -> Column:
    return -F.aggregate(arr, F.lit(0.0), lambda acc, p: acc + p * F.log(clip(p, 1e-8, 1.0)))


def l2_norm(arr: Column) -> Column:
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(arr: Column, eps: float = 1e-8) -> Column:
    return let(arr, lambda a: let(l2_norm(a) + eps, lambda n: F.transform(a, lambda x: x / n)))


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col))


def set_add(arr: Column, x: Column) -> Column:
    return F.array_union(F.coalesce(arr, F.array().cast("array<string>")), F.array(x))


def set_remove(arr: Column, x: Column) -> Column:
    return F.array_remove(arr, x)
