"""Validation of a DataFrame against a contract.

One aggregate reads the table and counts its rows by pattern (which columns are null, and
whether each rule is true, false or unknown). From these counts ``decide`` knows every violation count, the first
error of a strict validation, and which predicates apply. The result is the table behind one lazy filter, which Catalyst
pushes down and fuses with what follows. No rows come to the driver but samples that are shown.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.nodes import Node
from ..functions.regex import PatternError
from ..functions.spark import Compiler
from ..rules import call, for_tables
from . import decide as D
from .normalise import default_column, normalise

log = logging.getLogger(__name__)

#: Outcomes held by one 64-bit number of a pattern, two bits each; nulls take one bit each.
PER_WORD = 31
#: Patterns beyond which counting goes rule by rule.
MOST_PATTERNS = 50_000
SHOWN, SHOWN_STRICT = 10, 5


@dataclass
class Violation:
    constraint: str
    count: int
    rows: DataFrame

    def sample(self, n: int = SHOWN) -> list:
        return self.rows.limit(n).collect()


@dataclass
class ValidationReport:
    rows_in: int = 0
    rows_out: int = 0
    null_counts: dict[str, int] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    violations: list[Violation] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class SparkValidator:
    """Validates tables. Constraints are read when it is made, so a malformed rule fails here."""

    def __init__(self, schema_cls: type):
        self.schema_cls = schema_cls
        self.fields = schema_cls.fields()
        self.constraints: list[tuple[Node | Column, str]] = [c for f in self.fields.values() for c in f.get_constraints()]
        self.constraints += [for_tables(call(r, schema_cls)) for r in schema_cls.model_validators()]
        self.report = ValidationReport()

    @property
    def schema(self) -> T.StructType:
        return T.StructType(list(self.schema_cls.to_struct().fields))

    def describe_constraints(self) -> list[str]:
        return [message for _, message in self.constraints]

    # -- plan ---------------------------------------------------------------------------------

    def normalise(self, df: DataFrame) -> DataFrame:
        return normalise(df, self.fields)

    def _filled(self, base: DataFrame) -> DataFrame:
        fill = {n: F.coalesce(_quoted(n), default_column(f)) for n, f in self.fields.items() if f.has_default and f.default is not None}
        return base.withColumns(fill) if fill else base

    def _conditions(self, filled: DataFrame) -> list[tuple[Column, str]]:
        """Rules as columns; one that can't be evaluated is skipped with a warning."""
        compile_ = Compiler(self.schema_cls.kinds(), filled)
        out = []
        for rule, message in self.constraints:
            try:
                c = compile_.condition(rule) if isinstance(rule, Node) else rule
                kind = filled.select(c.alias("c")).schema["c"].dataType
                if not isinstance(kind, (T.BooleanType, T.NullType)):
                    raise TypeError(f"not boolean but {kind.simpleString()}")
                out.append((c, message))
            except (AnalysisException, PatternError, TypeError, ValueError, OverflowError) as e:
                log.warning("Could not evaluate constraint %r: %s", message, str(e).splitlines()[0])
                self.report.skipped.append(message)
        return out

    def _histogram(self, base: DataFrame, filled: DataFrame, rules: list[Column]) -> D.Histogram | None:
        """Rows by pattern, from one aggregate; None if there are too many patterns."""
        names = list(self.fields)
        was_null = [f"__null_{i}" for i in range(len(names))]
        # The nulls are those before filling, the outcomes those after it.
        both = base.withColumns({w: _quoted(n).isNull() for w, n in zip(was_null, names)})
        if filled is not base:
            both = self._filled(both)
        words: dict[str, Column] = {}
        for k in range(0, len(names), 62):
            bits = [F.when(F.col(w), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, w in enumerate(was_null[k : k + 62])]
            words[f"n{k}"] = sum(bits[1:], bits[0])
        for k in range(0, len(rules), PER_WORD):
            states = [F.when(c.isNull(), F.lit(D.UNKNOWN << 2 * i)).when(c, F.lit(0)).otherwise(F.lit(D.FALSE << 2 * i)).cast("bigint") for i, c in enumerate(rules[k : k + PER_WORD])]
            words[f"r{k}"] = sum(states[1:], states[0])
        counts = both.select(*[c.alias(n) for n, c in words.items()]).groupBy(*words).agg(F.count("*").alias("rows")).limit(MOST_PATTERNS + 1).collect()
        if len(counts) > MOST_PATTERNS:
            return None
        out: D.Histogram = {}
        for r in counts:
            nulls = tuple(bool(r[f"n{i // 62 * 62}"] >> i % 62 & 1) for i in range(len(names)))
            states = tuple(r[f"r{i // PER_WORD * PER_WORD}"] >> 2 * (i % PER_WORD) & 3 for i in range(len(rules)))
            out[nulls, states] = out.get((nulls, states), 0) + r["rows"]
        return out

    def _one_by_one(self, base: DataFrame, columns: list[D.Column], rules: list[Column], strict: bool, fill: bool) -> D.Decision:
        """The same decision where patterns are too many to count together: an aggregate for all nulls, then one for each rule."""
        out, kept = D.Decision(rows_in=base.count()), base
        for c in columns:
            nulls = kept.filter(_quoted(c.name).isNull()).count()
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
                kept = kept.filter(_quoted(c.name).isNotNull())
        kept = self._filled(kept) if fill else kept
        for i, rule in enumerate(rules):
            broken = kept.filter(~rule).count()
            if broken:
                out.violations.append((i, broken))
                if strict:
                    out.error = ("rule", i, broken)
                    return out
                out.apply.append(i)
                kept = kept.filter(rule)
        out.rows_out = kept.count()
        return out

    # -- run ----------------------------------------------------------------------------------

    def validate(self, df: DataFrame, strict: bool = True, show_violations: bool = False, fill_nulls: bool = False) -> DataFrame:
        """The valid rows of ``df`` in the contract's shape; with ``strict``, an error at the first violation.

        ``report`` then has the counts. The table is read once to decide, and the result is lazy; persist ``df`` if reading
        it again could give other rows.
        """
        self.report = ValidationReport()
        base = self.normalise(df)
        filled = self._filled(base) if fill_nulls else base
        rules = self._conditions(filled)
        columns = [D.Column(n, f.nullable, fill_nulls and f.has_default) for n, f in self.fields.items()]
        conditions = [c for c, _ in rules]
        histogram = self._histogram(base, filled, conditions)
        made = D.decide(histogram, columns, len(rules), strict) if histogram is not None else self._one_by_one(base, columns, conditions, strict, fill_nulls)

        out = base
        for name in made.drop_null:
            out = out.filter(_quoted(name).isNotNull())
        if fill_nulls:
            out = self._filled(out)
        self.report.rows_in, self.report.rows_out, self.report.null_counts, self.report.filled = made.rows_in, made.rows_out, made.null_counts, made.filled
        for name, n in made.filled.items():
            log.info("filled %d nulls of %r with %r", n, name, self.fields[name].default)
        for i, n in made.violations:
            self.report.violations.append(Violation(rules[i][1], n, out.filter(~conditions[i])))
            if i in made.apply:
                out = out.filter(conditions[i])
        if show_violations:
            for v in self.report.violations:
                log.warning("%s: %d rows\n%s", v.constraint, v.count, "\n".join(map(str, v.sample())))
        if made.error:
            kind, what, n = made.error
            if kind == "null":
                raise ValueError(f"Column {what!r} has {n} null values but is not nullable")
            sample = "\n".join(map(str, self.report.violations[-1].sample(SHOWN_STRICT)))
            raise ValueError(f"Constraint violation: {rules[what][1]}\nFound {n} violations.\nSample violations:\n{sample}")
        return out

    # -- extensions ---------------------------------------------------------------------------

    def row_filter(self, df: DataFrame, fill_nulls: bool = False) -> DataFrame:
        """Each row judged by itself, without a look at the others: kept if no column is null that mustn't be and no rule is false.

        Needs no pass over the table, so it works on streams.
        """
        self.report = ValidationReport()
        base = self.normalise(df)
        for n, f in self.fields.items():
            if not f.nullable and not (fill_nulls and f.has_default):
                base = base.filter(_quoted(n).isNotNull())
        out = self._filled(base) if fill_nulls else base
        for c, _ in self._conditions(out):
            out = out.filter(F.coalesce(c, F.lit(True)))
        return out

    def flag(self, df: DataFrame, column: str = "violations") -> DataFrame:
        """Every row in the contract's shape, with the messages of what it breaks by itself (for a quarantine)."""
        self.report = ValidationReport()
        base = self.normalise(df)
        said = [F.when(_quoted(n).isNull(), F.lit(f"{n} is null")) for n, f in self.fields.items() if not f.nullable]
        said += [F.when(~c, F.lit(m)) for c, m in self._conditions(base)]
        return base.withColumn(column, F.array_compact(F.array(*said)) if said else F.array().cast("array<string>"))

    def duplicate_keys(self, df: DataFrame) -> DataFrame:
        """Values of the primary key (and of each unique column) that more than one row has: column, key, rows."""
        base = self.normalise(df)
        keys = [[n for n, f in self.fields.items() if f.primary_key], *[[n] for n, f in self.fields.items() if f.unique]]
        out = None
        for k in filter(None, keys):
            found = base.groupBy(*k).agg(F.count("*").alias("rows")).filter("rows > 1").select(F.lit(", ".join(k)).alias("column"), F.concat_ws(", ", *[_quoted(n).cast("string") for n in k]).alias("key"), "rows")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else base.sparkSession.createDataFrame([], "column string, key string, rows long")


def create_spark_validator(schema_cls: type) -> SparkValidator:
    return SparkValidator(schema_cls)
