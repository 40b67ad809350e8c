"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a line.
SPACE = " \t\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also when body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def unrepeated(lines: Column, same: Callable[[Column, Column], Column]) -> Column:
    """lines without those for which same(line, line before) holds; linear in the text."""
    return let(lines, lambda l: F.filter(l, lambda x, i: (i == 0) | ~same(x, F.get(l, F.greatest(i - 1, F.lit(0))))))  # noqa: E741
