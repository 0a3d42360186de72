"""Arrays of spans in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(spans: str, fields: list[tuple[str, str]]) -> Column:
    """The sorted array ``spans`` with touching spans made one; ``fields`` has pairs of int fields, a start and its end.

    The first pair decides what touches. A span that lies inside another widens nothing.
    """
    kind = "struct<" + ",".join(f"`{n}`:int" for pair in fields for n in pair) + ">"
    start, end = fields[0]
    both = ", ".join(f"'{a}', element_at(a, -1).`{a}`, '{b}', greatest(element_at(a, -1).`{b}`, x.`{b}`)" for a, b in fields)
    joined = f"concat(slice(a, 1, size(a) - 1), array(named_struct({both})))"
    return F.expr(f"aggregate({spans}, cast(array() as array<{kind}>), (a, x) -> case when size(a) > 0 and x.`{start}` <= element_at(a, -1).`{end}` then {joined} else concat(a, array(x)) end)")


def replaced(text: Column, spans: str, start: str, end: str, mask: str) -> Column:
    """``text`` with the code points of each span, sorted and apart, replaced by ``mask``; unchanged without spans."""
    s = F.col(spans)
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(s, i - 1)[end])
    parts = F.transform(s, lambda x, i: F.concat(F.substring(text, before(i) + 1, x[start] - before(i)), F.lit(mask)))
    tail = F.substring(text, F.element_at(s, -1)[end] + 1, F.length(text))
    return F.when(s.isNull() | (F.size(s) < 1), text).otherwise(F.concat(F.array_join(parts, ""), tail))
