"""Ordered affine scan ``y_t = a * y_(t-1) + b_t`` as Catalyst windows.

Inside one block the recursion is a running sum of ``b_j * a^(-j)`` scaled by
``a^t``.  A block is long enough that ``a^block`` is below e^-60, so the rows of
the block before it carry everything a double can hold of the earlier past.
Rows are therefore read in blocks of two (the earlier one as halo); no key is
ever ordered inside one task as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.operators.ordering import blocked

_NATS = 60.0     # decay over one block of the slowest scan of a pass
_RANGE = 600.0   # exponent range a double can carry on either side


@dataclass(frozen=True)
class Scan:
    """One recursion: ``b`` is null before the start and the seed at the start."""

    name: str
    decay: float
    b: Column


def affine_scan(df: DataFrame, scans: Sequence[Scan], keys: Sequence[str] = ("symbol",), rn: str = "rn") -> DataFrame:
    """Add one column per scan; null before the scan's start row."""
    pending = sorted(scans, key=lambda s: -s.decay)
    out = df
    while pending:
        slowest = -math.log(pending[0].decay)
        block = math.ceil(_NATS / slowest)
        taken = [s for s in pending if -math.log(s.decay) * block <= _RANGE]
        pending = [s for s in pending if s not in taken]
        out = blocked(out, block, lambda rows, w, t=taken, b=block: _local(rows, w, t, b, rn), keys, rn, block)
    return out


def _local(rows: DataFrame, window: Window, scans: Sequence[Scan], block: int, rn: str) -> DataFrame:
    prefix = window.rowsBetween(Window.unboundedPreceding, 0)
    shift = F.col(rn) - 1 - F.col("_blk") * block
    added = {}
    for s in scans:
        rate = -math.log(s.decay)
        running = F.sum(s.b * F.exp(shift * F.lit(rate))).over(prefix)
        added[s.name] = running * F.exp(-shift * F.lit(rate))
    return rows.withColumns(added)


def ema_terms(value: Column, start: Column, seed: Column, span: float | None = None, alpha: float | None = None,
              rn: str = "rn") -> tuple[float, Column]:
    """Decay and ``b`` of an exponential mean that starts at row ``start``."""
    alpha = alpha if alpha is not None else 2.0 / (span + 1.0)
    b = F.when(F.col(rn) == start, seed).when(F.col(rn) > start, F.lit(alpha) * value)
    return 1.0 - alpha, b
