"""Contractions kept up to date over a stream, an extension of the one-shot algebra.

A sum in any of the semirings is associative and commutative, so a grouped contraction
of a stream is a stateful aggregation; windows and watermarks bound its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirel.operators.contraction import _total
from semirel.relation import VALUE, KRel


def streaming_select(rel: KRel, *names: str) -> DataFrame:
    """Keep the named indices of a streaming table; for the output modes ``update`` and ``complete``."""
    return rel.df.groupBy(*names).agg(_total(rel).alias(VALUE))


def windowed_select(rel: KRel, time: str, width: str, late: str, *names: str, slide: str | None = None) -> DataFrame:
    """Sums in event-time windows; what comes later than ``late`` is dropped and closed windows leave the state."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    timed = rel.df.withWatermark(time, late)
    return timed.groupBy(window.alias("window"), *names).agg(_total(rel).alias(VALUE))
