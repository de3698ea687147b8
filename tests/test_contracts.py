"""Schemas, table validation, row models, table definitions and streams."""

import itertools
import warnings
from datetime import date, datetime
from typing import Optional

import pytest
from hypothesis import given, settings, strategies as st
from pydantic import ValidationError
from pyspark.sql import functions as F

from tablepact import Field, Schema, col, model_validator
from tablepact.fields import Integer
from tablepact.operators.decide import FALSE, TRUE, UNKNOWN, Column, decide
from tablepact.sources import read_csv, read_json, read_parquet, write_parquet, write_table
from tablepact.streaming import filter_stream, validate_batches


class BuoySchema(Schema):
    buoy: int = Field(primary_key=True)
    bay: str
    depth: int | None = None


class ReadingSchema(Schema):
    serial: int = Field(primary_key=True, ge=100)
    station: str = Field(min_length=2, max_length=12)
    humidity: int = Field(ge=5, le=95)
    wind: float = Field(gt=0.5)
    code: str = Field(pattern=r"^[A-Z]{2}-\d{3}$")
    checked: bool = True
    taken: datetime


class LampSchema(Schema):
    lamp: int = Field(primary_key=True)
    colour: str = Field(default="amber")
    lumens: int = 40
    lit: bool = False
    fitted: datetime = datetime(2019, 7, 4, 6)


class LeaseSchema(Schema):
    opens: date
    closes: date

    @model_validator
    def ordered():
        return (col("opens") < col("closes"), "opens before it closes")


DAWN = datetime(2021, 3, 9, 5, 40)


@pytest.fixture
def readings(spark):
    """Row 7 has too small a serial and is too dry; 205 has too short a station and too wet air; 310 is fine."""
    rows = [(310, "Kap Nord", 61, 3.5, "KN-310", DAWN), (7, "Delta", 2, 1.0, "DE-007", DAWN), (205, "x", 99, 9.0, "XX-205", DAWN)]
    return spark.createDataFrame(rows, "serial long, station string, humidity long, wind double, code string, taken timestamp_ntz")


def test_strict_passes_and_orders_columns(spark):
    df = spark.createDataFrame([("north", 12, 4, 0.5), ("south", 40, 9, 0.1)], "bay string, depth int, buoy int, drift double")
    out = BuoySchema.to_spark_validator().validate(df)
    assert out.columns == ["buoy", "bay", "depth"] and out.count() == 2
    assert out.schema["buoy"].dataType.simpleString() == "bigint"


def test_missing_columns(spark):
    for strict in (True, False):
        with pytest.raises(ValueError, match="Missing required columns"):
            BuoySchema.to_spark_validator().validate(spark.createDataFrame([(4,)], "buoy long"), strict=strict)


def test_strict_and_non_strict(readings):
    v = ReadingSchema.to_spark_validator()
    with pytest.raises(ValueError, match="Constraint violation: serial must be >= 100\nFound 1 violations"):
        v.validate(readings, show_violations=True)
    out = v.validate(readings, strict=False)
    assert [r.serial for r in out.collect()] == [310] and out.first().checked is True
    # Row 7 is gone when humidity is judged, and row 205 by its station.
    assert [(x.constraint, x.count) for x in v.report.violations] == [("serial must be >= 100", 1), ("station must have at least 2 characters", 1)]
    assert [r.serial for r in v.report.violations[1].sample()] == [205] and (v.report.rows_in, v.report.rows_out) == (3, 1)


def test_nulls(spark):
    df = spark.createDataFrame([(4, "north", 12), (9, None, None)], "buoy long, bay string, depth long")
    v = BuoySchema.to_spark_validator()
    with pytest.raises(ValueError, match="has 1 null values"):
        v.validate(df)
    assert [r.buoy for r in v.validate(df, strict=False).collect()] == [4] and v.report.null_counts == {"bay": 1}


def test_defaults(spark):
    v = LampSchema.to_spark_validator()
    assert v.validate(spark.createDataFrame([(70,), (71,)], "lamp long")).first().asDict() == {"lamp": 70, "colour": "amber", "lumens": 40, "lit": False, "fitted": datetime(2019, 7, 4, 6)}
    df = spark.createDataFrame([(70, "red", 900), (71, None, None)], "lamp long, colour string, lumens long")
    assert v.validate(df, fill_nulls=True).collect()[1][1:3] == ("amber", 40) and v.report.filled == {"colour": 1, "lumens": 1}


def test_unknown_rows_go_only_if_some_row_is_false(spark):
    class TideSchema(Schema):
        gauge: int
        metres: int | None = Field(le=6)

    v = TideSchema.to_spark_validator()
    df = spark.createDataFrame([(1, 5), (2, None)], "gauge long, metres long")
    high = df.union(spark.createDataFrame([(3, 9)], df.schema))
    assert v.validate(df, strict=False).count() == 2
    assert [r.gauge for r in v.validate(high, strict=False).collect()] == [1]
    assert sorted(r.gauge for r in v.row_filter(high).collect()) == [1, 2]


def test_unevaluable_rules_are_skipped(spark, caplog):
    class OddSchema(Schema):
        a: int
        b: str = Field(pattern="(?=x)")

        @model_validator
        def mixed():
            return (col("a") > "x", "int against str")

        @model_validator
        def absent():
            return (F.col("nowhere") > 1, "no such column")

        @model_validator
        def good():
            return (col("a") > 1, "a above 1")

    v = OddSchema.to_spark_validator()
    assert [r.a for r in v.validate(spark.createDataFrame([(1, "p"), (2, "q")], "a long, b string"), strict=False).collect()] == [2]
    assert len(v.report.skipped) == 3 and "Could not evaluate constraint" in caplog.text


def test_lenient_casts(spark):
    class TypedSchema(Schema):
        a: int | None
        b: bool | None
        c: datetime | None
        d: date | None
        e: float | None

    rows = [("12", "true", 0, 1, "1.5"), (" 12 ", "yes", None, None, "x"), ("1.5", "false", 1_000_000, 0, None), ("99999999999999999999", None, 5, 2, "NaN")]
    out = TypedSchema.to_spark_validator().validate(spark.createDataFrame(rows, "a string, b string, c long, d int, e string")).collect()
    assert [r.a for r in out] == [12, None, None, None] and [r.b for r in out] == [True, None, False, None]
    assert out[2].c == datetime(1970, 1, 1, 0, 0, 1) and out[0].d == date(1970, 1, 2) and out[0].e == 1.5 and out[1].e is None
    assert out[0].c == datetime(1970, 1, 1)


def test_rule_formats(spark):
    class RuleSchema(Schema):
        a: int
        b: int

        @model_validator
        def plain(cls):
            return col("a") < col("b")

        @classmethod
        @model_validator
        def dict_rule(cls):
            return {"spark": (col("a") > 0, "positive"), "python": lambda row: (row.a > 0, "positive")}

    v = RuleSchema.to_spark_validator()
    assert v.describe_constraints() == ["Validation failed", "positive"]
    assert v.validate(spark.createDataFrame([(1, 2), (2, 1), (-1, 5)], "a long, b long"), strict=False).count() == 1
    Model = RuleSchema.to_pydantic()
    assert Model.__name__ == "RuleModel" and Model(a=1, b=2).a == 1
    for bad in ((2, 1), (-1, 5)):
        with pytest.raises(ValidationError):
            Model(a=bad[0], b=bad[1])
    for result in ({"python": len}, True, "text", (True, "m")):
        made = model_validator(eval("lambda: r", {"r": result}))
        with pytest.raises(ValueError):
            type("BadSchema", (Schema,), {"__annotations__": {"a": int}, "rule": made}).to_spark_validator()


def test_schema_rules():
    assert list(ReadingSchema.fields()) == ["serial", "station", "humidity", "wind", "code", "checked", "taken"]
    assert BuoySchema.fields()["depth"].nullable and not BuoySchema.fields()["depth"].required and BuoySchema.fields()["buoy"].required
    for annotations, values in (({"a": int | str}, {}), ({"a": list}, {}), ({"a": int}, {"a": Integer()}), ({"a": int}, {"a": Field(min_length=1)}), ({"a": bool}, {"a": Field(ge=1)})):
        with pytest.raises(TypeError):
            type("BadSchema", (Schema,), {"__annotations__": annotations, **values})

    class MooredSchema(BuoySchema):
        chain: Optional[str]  # noqa: UP045

    assert list(MooredSchema.fields()) == ["buoy", "bay", "depth", "chain"] and MooredSchema.fields()["chain"].nullable and MooredSchema.fields()["chain"].required
    with pytest.raises(RuntimeError, match="field name"):
        Integer(ge=1).get_constraints()
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        BuoySchema.fields()["depth"]._warned = False
        BuoySchema.to_spark_validator()
        BuoySchema.to_spark_validator()
    assert len([w for w in found if "nullable and has a default" in str(w.message)]) == 1


def test_dates_and_own_rules(spark):
    df = spark.createDataFrame([(date(2018, 5, 1), date(2020, 5, 1)), (date(2020, 6, 2), date(2020, 5, 1))], "opens date, closes date")
    assert LeaseSchema.to_spark_validator().validate(df, strict=False).count() == 1

    class BoundSchema(Schema):
        day: date = Field(ge=date(2024, 1, 5))

    BoundSchema.fields()["day"].add_validator(lambda c: c.dt.day() < 20, "before the 20th")
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 10, 25)], "day date")
    assert [r.day.day for r in BoundSchema.to_spark_validator().validate(days, strict=False).collect()] == [10]


def test_row_model():
    Model = ReadingSchema.to_pydantic()
    good = dict(serial="144", station="Delta", humidity=40, wind=2.5, code="DE-144", taken=DAWN)
    assert Model(**good).serial == 144 and Model(**good).checked is True
    for change in (dict(serial=99), dict(station="D"), dict(humidity=96), dict(wind=0.5), dict(code="de-144"), dict(taken="soon")):
        with pytest.raises(ValidationError):
            Model(**good | change)


def test_row_model_over_a_table(spark):
    """Rows are judged one by one, whatever the others are; the schema has to be one that executors can import."""
    from tablepact.operators import check_rows
    from tablepact.plans.contracts import AccountSchema

    rows = [(1, 3, 50.0, "AUTO", "x"), (2, 21, -4.0, "BUILDING", "x"), (3, 3, 50.0, "BUILDING", "x"), (4, None, 1.0, "AUTO", "x")]
    df = spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string, spare string")
    got = {r.c_custkey: [e.split(":")[0] for e in r.errors] for r in check_rows(df, AccountSchema).collect()}
    assert got == {1: [], 2: ["c_nationkey", "c_acctbal"], 3: ["row"], 4: ["c_nationkey"]}
    assert check_rows(df.limit(0), AccountSchema).columns == [*df.columns, "errors"] and check_rows(df.limit(0), AccountSchema).count() == 0
    with pytest.raises(ValueError, match="errors"):
        check_rows(df.withColumn("errors", F.lit(1)), AccountSchema)


def test_table_definition(spark):
    made = ReadingSchema.to_table()
    assert made.name == "readings" and made.primary_key == ["serial"] and made.columns["station"].type == "VARCHAR(12)"
    assert BuoySchema.to_table("moorings", "db").full_name == "`db`.`moorings`" and BuoySchema.to_table().columns["depth"].nullable
    LampSchema.to_table("lamps_made").create(spark)
    spark.sql("INSERT INTO lamps_made (lamp) VALUES (7)")
    row = spark.table("lamps_made").first()
    assert (row.lamp, row.colour, row.lumens, row.lit, row.fitted) == (7, "amber", 40, False, datetime(2019, 7, 4, 6))
    write_table(LampSchema.to_spark_validator().validate(spark.createDataFrame([(8,)], "lamp long")), "lamps_made")
    assert spark.table("lamps_made").count() == 2


def test_integer_powers_are_exact(spark):
    from tablepact.functions.spark import to_column

    df = spark.createDataFrame([(3,), (-3,), (2,), (0,), (None,), (10,)], "x long")
    for power in (0, 1, 2, 39, 62, 63):
        got = [r[0] for r in df.select(to_column(col("x").pow(power), {"x": "int"}, df)).collect()]
        assert got == [None if x is None or abs(x**power) > 2**63 - 1 else x**power for x in (3, -3, 2, 0, None, 10)], power


def test_files(spark, tmp_path):
    class FileSchema(Schema):
        id: int
        name: str | None

    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, other double")
    write_parquet(df, str(tmp_path / "p"))
    df.write.csv(str(tmp_path / "c"), header=True)
    df.write.json(str(tmp_path / "j"))
    for got in (read_parquet(spark, str(tmp_path / "p"), schema=FileSchema), read_csv(spark, str(tmp_path / "c"), FileSchema), read_json(spark, str(tmp_path / "j"), FileSchema)):
        assert got.columns == ["id", "name"]
        assert sorted(map(tuple, FileSchema.to_spark_validator().validate(got).collect())) == [(1, "a"), (2, "b")]


def test_quarantine_and_keys(spark):
    df = spark.createDataFrame([(4, "north", 12), (4, None, 30)], "buoy long, bay string, depth long")
    v = BuoySchema.to_spark_validator()
    assert sorted(r.violations for r in v.flag(df).collect()) == [[], ["bay is null"]]
    assert [tuple(r) for r in v.duplicate_keys(df).collect()] == [("buoy", "4", 2)]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(4, "north", 12), (9, None, 30)], "buoy long, bay string, depth long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("buoy long, bay string, depth long").parquet(str(tmp_path / "in"))
    run = filter_stream(stream, BuoySchema).writeStream.format("memory").queryName("buoys_kept").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.buoy for r in spark.table("buoys_kept").collect()] == [4]
    got, reports = [], []
    run = validate_batches(stream, BuoySchema, lambda df, i: got.extend(df.collect()), lambda r, i: reports.append(r.null_counts)).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.buoy for r in got] == [4] and reports == [{"bay": 1}]


def plainly(rows, columns, rules):
    """Validation as it is defined: one step after the other over the rows."""
    counts = {}
    for i, c in enumerate(columns):
        n = sum(r[0][i] for r in rows)
        if n:
            counts[c.name] = n
            if not c.fill and not c.nullable:
                rows = [r for r in rows if not r[0][i]]
    broken = []
    for i in range(rules):
        n = sum(r[1][i] == FALSE for r in rows)
        if n:
            broken.append((i, n))
            rows = [r for r in rows if r[1][i] == TRUE]
    return counts, broken, len(rows)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.tuples(*[st.booleans()] * 3), st.tuples(*[st.sampled_from([TRUE, FALSE, UNKNOWN])] * 4)), max_size=40), st.lists(st.tuples(st.booleans(), st.booleans()), min_size=3, max_size=3))
def test_decisions_equal_plain_steps(rows, kinds):
    columns = [Column(str(i), nullable, fill) for i, (nullable, fill) in enumerate(kinds)]
    made = decide({k: len(list(g)) for k, g in itertools.groupby(sorted(rows))}, columns, 4, strict=False)
    assert (made.null_counts, made.violations, made.rows_out) == plainly(rows, columns, 4)


def test_many_rules_and_many_patterns(spark, monkeypatch):
    from tablepact.operators import validator

    class WideSchema(Schema):
        a: int | None
        b: int

    for k in range(70):
        WideSchema.fields()["b"].add_validator(lambda c, k=k: (c != k) | (col("a") < 0), f"not {k}")
    df = spark.createDataFrame([(None if i % 7 == 0 else i, i) for i in range(100)], "a long, b long")
    v = WideSchema.to_spark_validator()
    one = v.validate(df, strict=False, fill_nulls=False).collect(), [(x.constraint, x.count) for x in v.report.violations]
    monkeypatch.setattr(validator, "MOST_PATTERNS", 1)
    assert (v.validate(df, strict=False).collect(), [(x.constraint, x.count) for x in v.report.violations]) == one
