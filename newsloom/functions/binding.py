"""Naming a value inside an expression, so that it is worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
