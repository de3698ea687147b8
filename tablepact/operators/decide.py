"""What validation decides, from counts of patterns alone.

Rules apply one after the other, each to the rows that those before it left, and a rule drops rows
only if some row definitely breaks it; it then drops those for which it is unknown as well. All of this follows
from how many rows have which pattern of nulls (by column) and outcomes (by rule), so the table is read
once, however many rules there are. There is no Spark here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TRUE, FALSE, UNKNOWN = 0, 1, 2

#: (null by column, outcome by rule) -> rows
Histogram = dict[tuple[tuple[bool, ...], tuple[int, ...]], int]


@dataclass
class Column:
    name: str
    nullable: bool
    fill: bool


@dataclass
class Decision:
    null_counts: dict[str, int] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    drop_null: list[str] = field(default_factory=list)
    violations: list[tuple[int, int]] = field(default_factory=list)
    apply: list[int] = field(default_factory=list)
    rows_in: int = 0
    rows_out: int = 0
    #: What a strict validation stops at: ("null", column, rows) or ("rule", rule, rows).
    error: tuple[str, object, int] | None = None


def decide(histogram: Histogram, columns: list[Column], rules: int, strict: bool) -> Decision:
    out = Decision(rows_in=sum(histogram.values()))
    rows = dict(histogram)
    for i, c in enumerate(columns):
        nulls = sum(n for (isnull, _), n in rows.items() if isnull[i])
        if not nulls:
            continue
        out.null_counts[c.name] = nulls
        if c.fill:
            out.filled[c.name] = nulls
        elif not c.nullable:
            if strict:
                out.error = ("null", c.name, nulls)
                return out
            out.drop_null.append(c.name)
            rows = {k: n for k, n in rows.items() if not k[0][i]}
    for i in range(rules):
        broken = sum(n for (_, states), n in rows.items() if states[i] == FALSE)
        if not broken:
            continue
        out.violations.append((i, broken))
        if strict:
            out.error = ("rule", i, broken)
            return out
        out.apply.append(i)
        rows = {k: n for k, n in rows.items() if k[1][i] == TRUE}
    out.rows_out = sum(rows.values())
    return out
