"""One query for each operator, and DuckDB SQL of the same result over the same tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import col
from ..functions.nodes import Node
from ..functions.spark import Compiler
from . import contracts as C

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool", "timestamp_ntz": "datetime", "date": "date"}


def project(df: DataFrame, keys: list[str], **exprs: Node) -> DataFrame:
    """Key columns and named expressions, compiled for the table's types."""
    compile_ = Compiler({n: KINDS.get(t, "any") for n, t in df.dtypes}, df)
    return df.select(*keys, *[compile_(e).column.alias(n) for n, e in exprs.items()])


def valid(schema: type, df: DataFrame, **options) -> DataFrame:
    return schema.to_spark_validator().validate(df, strict=False, **options)


# -- validation -------------------------------------------------------------------------------


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 AND l_quantity BETWEEN 10 AND 50 AND l_extendedprice > 0 AND l_discount BETWEEN 0 AND 0.05 AND regexp_matches(l_returnflag, '^[AN]$')")
def validate_lineitem_filter(spark, d):
    return valid(C.LineitemSchema, table(spark, d, "lineitem"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 400000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' AND regexp_matches(o_orderpriority, '^[1-3]-')")
def validate_orders_datetime(spark, d):
    return valid(C.OrdersSchema, table(spark, d, "orders"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'")
def validate_orders_open_bounds(spark, d):
    return valid(C.OrdersOpenSchema, table(spark, d, "orders"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part WHERE p_size > 3 AND p_size < 49 AND p_size % 5 = 0")
def validate_multiple_of(spark, d):
    return valid(C.PartSchema, table(spark, d, "part"))


@query("SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 50 AND 2000")
def validate_str_length(spark, d):
    return valid(C.DocumentLengthSchema, table(spark, d, "documents"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(0 AS BIGINT) AS population, CAST(NULL AS VARCHAR) AS note FROM nation")
def validate_add_default(spark, d):
    return valid(C.NationSchema, table(spark, d, "nation"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(nullif(l_discount, 0), 0.01) AS discount FROM lineitem")
def validate_fill_nulls(spark, d):
    return valid(C.FilledSchema, table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))), fill_nulls=True)


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_tax AS tax FROM lineitem WHERE l_tax <> 0")
def validate_notnull_drop(spark, d):
    return valid(C.NotNullSchema, table(spark, d, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0))))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, nullif(l_discount, 0) AS discount FROM lineitem")
def validate_null_kept(spark, d):
    return valid(C.NullKeptSchema, table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount AS discount FROM lineitem WHERE nullif(l_discount, 0) <= 0.05")
def validate_null_dropped(spark, d):
    return valid(C.NullDroppedSchema, table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))))


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, CAST(NULL AS BIGINT) AS broken, CAST(trunc(o_totalprice) AS BIGINT) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def validate_cast_lenient(spark, d):
    df = table(spark, d, "orders")
    return valid(C.CastSchema, df.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("level"), F.col("o_orderpriority").alias("broken"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("day"), F.lit(1).alias("dropped")))


_CHAIN = "WITH a AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_discount, l_tax FROM lineitem), b AS (SELECT * FROM a WHERE l_quantity <= 40), c AS (SELECT * FROM b WHERE l_discount <= 0.07), e AS (SELECT * FROM c WHERE l_tax > 0.01) "


@query(_CHAIN + "SELECT * FROM e")
def validate_chain_order(spark, d):
    return valid(C.ChainSchema, table(spark, d, "lineitem"))


@query(_CHAIN + "SELECT 'l_quantity must be <= 40' AS violated, count(*) FILTER (WHERE NOT l_quantity <= 40) AS n FROM a UNION ALL SELECT 'l_discount must be <= 0.07', count(*) FILTER (WHERE NOT l_discount <= 0.07) FROM b UNION ALL SELECT 'l_tax must be > 0.01', count(*) FILTER (WHERE NOT l_tax > 0.01) FROM c")
def validate_violation_counts(spark, d):
    v = C.ChainSchema.to_spark_validator()
    v.validate(table(spark, d, "lineitem"), strict=False)
    return spark.createDataFrame([(x.constraint, x.count) for x in v.report.violations], "violated string, n long")


@query("SELECT CASE WHEN count(*) FILTER (WHERE NOT l_quantity <= 40) > 0 THEN 'Constraint violation: l_quantity must be <= 40' END AS said, count(*) FILTER (WHERE NOT l_quantity <= 40) AS n FROM lineitem")
def validate_strict_error(spark, d):
    v = C.ChainSchema.to_spark_validator()
    try:
        v.validate(table(spark, d, "lineitem"), strict=True)
        found = (None, 0)
    except ValueError as e:
        found = (str(e).splitlines()[0], v.report.violations[0].count)
    return spark.createDataFrame([found], "said string, n long")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_discount, l_tax, list_filter([CASE WHEN NOT l_quantity <= 40 THEN 'l_quantity must be <= 40' END, CASE WHEN NOT l_discount <= 0.07 THEN 'l_discount must be <= 0.07' END, CASE WHEN NOT l_tax > 0.01 THEN 'l_tax must be > 0.01' END], lambda x: x IS NOT NULL).array_to_string('; ') AS violations FROM lineitem")
def validate_flag(spark, d):
    return C.ChainSchema.to_spark_validator().flag(table(spark, d, "lineitem")).withColumn("violations", F.array_join("violations", "; "))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0) AS discount, l_tax FROM lineitem WHERE l_extendedprice * (1 - l_tax) <= l_extendedprice AND (nullif(l_discount, 0) IS NULL OR l_discount < 0.1) AND l_quantity % 2 = 0 AND l_tax < 0.08")
def model_cross_field(spark, d):
    return valid(C.CrossFieldSchema, table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice * l_quantity, 2) AS total FROM lineitem WHERE l_linenumber BETWEEN 1 AND 7 AND l_quantity BETWEEN 10 AND 50 AND l_extendedprice > 0 AND l_discount BETWEEN 0 AND 0.05 AND regexp_matches(l_returnflag, '^[AN]$')")
def etl_derive(spark, d):
    out = valid(C.LineitemSchema, table(spark, d, "lineitem"))
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * F.col("l_quantity"), 2).alias("total"))


@query("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE length(text) >= 20 AND length(lang) <= 2 AND n_chars >= 0 AND n_chars = length(text) AND lang IN ('en', 'de', 'fr')")
def quality_documents(spark, d):
    return valid(C.DocumentSchema, table(spark, d, "documents"))


@query("SELECT * FROM (VALUES ('n_nationkey', 'BIGINT', false, true), ('n_name', 'VARCHAR(25)', false, false), ('population', 'BIGINT', false, false), ('note', 'STRING', true, false)) t(name, type, nullable, primary_key)")
def ddl_columns(spark, d):
    made = C.NationSchema.to_table()
    return spark.createDataFrame([(c.name, c.type, c.nullable, c.primary_key) for c in made.columns.values()], "name string, type string, nullable boolean, primary_key boolean")


@query("SELECT * FROM (VALUES (1, 'l_quantity must be <= 40'), (2, 'l_discount must be <= 0.07'), (3, 'l_tax must be > 0.01')) t(place, message)")
def describe_constraints(spark, d):
    said = C.ChainSchema.to_spark_validator().describe_constraints()
    return spark.createDataFrame(list(enumerate(said, 1)), "place int, message string")


@query("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS key, count(*) AS rows FROM orders GROUP BY o_orderpriority HAVING count(*) > 1")
def duplicate_keys(spark, d):
    from .. import Field, Schema

    class KeySchema(Schema):
        o_orderkey: int = Field(primary_key=True)
        o_orderpriority: str = Field(unique=True)

    return KeySchema.to_spark_validator().duplicate_keys(table(spark, d, "orders"))


@query("SELECT event_id, user_id, value FROM events WHERE value > 20 AND user_id >= 100")
def stream_filter(spark, d):
    """Rows through a stream with the row-local filter, into files of the shared folder (a sink in memory would hold every row on the driver)."""
    from .. import Field, Schema
    from ..streaming import filter_stream

    class EventSchema(Schema):
        event_id: int
        user_id: int = Field(ge=100)
        value: float = Field(gt=20)

    batch = table(spark, d, "events")
    # A stream takes a path as a folder's, but a pattern matches a file as well as a folder of files.
    kept = filter_stream(spark.readStream.schema(batch.schema).parquet(f"{d}/events.parque[t]"), EventSchema)
    path = f"{shared_folder(spark)}/stream_filter_{uuid.uuid4().hex[:12]}"
    writer = kept.writeStream.format("parquet").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/rows").awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{path}/rows")


# -- rows, rules and messages -----------------------------------------------------------------


def messages(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    return spark.createDataFrame(rows, fields)


def raised(work: Callable[[], object]) -> str:
    """What kind of error it raises, and the first line of it."""
    try:
        work()
    except Exception as e:
        return f"{type(e).__name__}: {str(e).splitlines()[0]}"
    return "none"


@query("SELECT c_custkey, c_acctbal < 0 AS in_debt, c_mktsegment = 'BUILDING' AND c_acctbal < 100 AS refused, c_nationkey > 20 AS far, CAST((c_acctbal < 0)::INT + (c_nationkey > 20)::INT + (c_acctbal >= 0 AND c_nationkey <= 20 AND c_mktsegment = 'BUILDING' AND c_acctbal < 100)::INT AS INT) AS n_errors FROM customer")
def model_rows(spark, d):
    """The row model over a table: fields, then a rule that is a Python function (which only sees rows whose fields are valid)."""
    from ..operators import check_rows

    out = check_rows(table(spark, d, "customer"), C.AccountSchema)
    said = lambda text: F.exists("errors", lambda e: F.contains(e, F.lit(text)))
    refused = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)) & (F.col("c_acctbal") < 100)
    return out.select("c_custkey", said("c_acctbal:").alias("in_debt"), F.when(F.col("c_acctbal").between(0, 99.999999) & (F.col("c_nationkey") <= 20), said("too little to build")).otherwise(refused).alias("refused"), said("c_nationkey:").alias("far"), F.size("errors").alias("n_errors"))


@query("SELECT * FROM (VALUES ('AccountModel', 'c_custkey', true), ('AccountModel', 'c_nationkey', true), ('AccountModel', 'c_acctbal', true), ('AccountModel', 'c_mktsegment', false)) t(model, field, required)")
def model_fields(spark, d):
    model = C.AccountSchema.to_pydantic()
    return messages(spark, [(model.__name__, n, f.is_required()) for n, f in model.model_fields.items()], "model string, field string, required boolean")


@query("SELECT * FROM (VALUES ('strict', 'ValueError'), ('lenient', 'ValueError')) t(mode, error)")
def missing_columns(spark, d):
    v, df = C.OrdersSchema.to_spark_validator(), table(spark, d, "orders").drop("o_totalprice")
    return messages(spark, [(m, raised(lambda: v.validate(df, strict=s)).split(":")[0]) for m, s in (("strict", True), ("lenient", False))], "mode string, error string")  # noqa: B023


@query("SELECT 'Column ''tax'' has ' || count(*) || ' null values but is not nullable' AS error FROM lineitem WHERE l_tax = 0")
def strict_null_error(spark, d):
    df = table(spark, d, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return messages(spark, [(raised(lambda: C.NotNullSchema.to_spark_validator().validate(df)).partition(": ")[2],)], "error string")


@query("SELECT o_orderkey, o_totalprice, 3 AS skipped FROM orders WHERE o_totalprice > 50000")
def skipped_rules(spark, d):
    """Rules that can't be evaluated (a text against a number, a column that isn't there, a pattern with look-ahead) are left out with a warning."""
    v = C.OddSchema.to_spark_validator()
    out = v.validate(table(spark, d, "orders"), strict=False)
    return out.select("o_orderkey", "o_totalprice", F.lit(len(v.report.skipped)).alias("skipped"))


@query("SELECT 1 AS place, 'l_quantity must be <= 40' AS what, count(*)::INT AS n FROM lineitem WHERE l_quantity > 40")
def logged_violations(spark, d):
    """What ``show_violations`` logs for the first rule that is broken."""
    import logging

    found: list[str] = []

    class Keep(logging.Handler):
        def emit(self, record):
            found.append(record.getMessage())

    log, keep = logging.getLogger("tablepact.operators.validator"), Keep()
    log.addHandler(keep)
    try:
        C.ChainSchema.to_spark_validator().validate(table(spark, d, "lineitem"), strict=False, show_violations=True)
    finally:
        log.removeHandler(keep)
    rule, _, rest = found[0].partition(": ")
    return messages(spark, [(1, rule, int(rest.split()[0]))], "place int, what string, n int")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def violation_rows(spark, d):
    """The rows that break the first rule, from the report."""
    v = C.ChainSchema.to_spark_validator()
    v.validate(table(spark, d, "lineitem"), strict=False)
    return v.report.violations[0].rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint', false), ('o_totalprice', 'double', false), ('o_orderdate', 'timestamp_ntz', false), ('o_orderpriority', 'string', false)) t(name, type, nullable)")
def schema_property(spark, d):
    return messages(spark, [(f.name, f.dataType.simpleString(), f.nullable) for f in C.OrdersSchema.to_spark_validator().schema], "name string, type string, nullable boolean")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-02-01' AND CAST(o_orderdate AS DATE) < DATE '1998-06-30' AND month(o_orderdate) <> 12 AND o_orderkey % 2 = 0")
def validate_dates_and_own_rules(spark, d):
    """Bounds of a date, a rule added to a field, and a boolean column as a rule."""
    from .. import Field, Schema, model_validator

    class DaySchema(Schema):
        o_orderkey: int
        day: date = Field(ge=date(1997, 2, 1), lt=date(1998, 6, 30))
        even: bool

        @model_validator
        def only_even():
            return (col("even"), "even orders")

    DaySchema.fields()["day"].add_validator(lambda c: c.dt.month() != 12, "not in December")
    df = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("even", F.col("o_orderkey") % 2 == 0)
    return valid(DaySchema, df).drop("even")


@query("SELECT * FROM (VALUES ('bound of another type', 'TypeError'), ('closed by another word', 'ValueError'), ('field without a name', 'RuntimeError'), ('rule of another type', 'ValueError'), ('dict without a table form', 'ValueError')) t(what, error)")
def static_checks(spark, d):
    """What is refused before any table is read."""
    from .. import Field, Schema, model_validator
    from ..fields import Integer

    def rule(result):
        return lambda: type("BadSchema", (Schema,), {"__annotations__": {"a": int}, "rule": model_validator(lambda: result)}).to_spark_validator()

    cases = [
        ("bound of another type", lambda: type("BadSchema", (Schema,), {"__annotations__": {"a": int}, "a": Field(min_length=1)})),
        ("closed by another word", lambda: col("a").is_between(1, 2, closed="inside")),
        ("field without a name", lambda: Integer(ge=1).get_constraints()),
        ("rule of another type", rule("text")),
        ("dict without a table form", rule({"python": len})),
    ]
    return messages(spark, [(what, raised(work).split(":")[0]) for what, work in cases], "what string, error string")


@query("SELECT * FROM (VALUES ('tests', 'n_nationkey', NULL, true), ('tests', 'n_name', NULL, NULL), ('tests', 'population', '0', NULL), ('tests', 'note', NULL, NULL)) t(\"table\", name, \"default\", autoincrement)")
def ddl_full(spark, d):
    """Table name, defaults and keys that count up."""
    from ..fields import MISSING

    made = C.NationKeySchema.to_table("tests")
    return messages(spark, [(made.name, c.name, None if c.default is MISSING or c.default is None else str(c.default), c.autoincrement) for c in made.columns.values()], "table string, name string, default string, autoincrement boolean")


@query("SELECT * FROM (VALUES ('nationkeys', '`nationkeys`', 'n_nationkey'), ('lands', '`geo`.`lands`', 'n_nationkey')) t(name, full_name, keys)")
def ddl_names(spark, d):
    both = C.NationKeySchema.to_table(), C.NationKeySchema.to_table("lands", "geo")
    return messages(spark, [(t.name, t.full_name, ",".join(t.primary_key)) for t in both], "name string, full_name string, keys string")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; one of this machine only where there is no other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


PARTS_SQL = "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand FROM part WHERE p_size > 3 AND p_size < 49 AND p_size % 5 = 0"


@query(PARTS_SQL)
def csv_roundtrip(spark, d):
    """Written as text, read as text, and cast by validation."""
    from ..sources import read_csv

    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex[:12]}"
    table(spark, d, "part").write.csv(path, header=True)
    return valid(C.PartSchema, read_csv(spark, path, C.PartSchema))


@query(PARTS_SQL)
def json_roundtrip(spark, d):
    from ..sources import read_json

    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex[:12]}"
    table(spark, d, "part").write.json(path)
    return valid(C.PartSchema, read_json(spark, path, C.PartSchema))


@query(PARTS_SQL)
def parquet_roundtrip(spark, d):
    from ..sources import read_parquet, write_parquet

    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex[:12]}"
    write_parquet(valid(C.PartSchema, read_parquet(spark, f"{d}/part.parquet", schema=C.PartSchema)), path)
    return read_parquet(spark, path)


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(0 AS BIGINT) AS population, CAST(NULL AS VARCHAR) AS note FROM nation")
def table_roundtrip(spark, d):
    """A table made from a contract's definition, filled with valid rows, and read."""
    from ..sources import write_table

    name = f"nations_{uuid.uuid4().hex[:12]}"
    C.NationSchema.to_table(name).create(spark)
    write_table(valid(C.NationSchema, table(spark, d, "nation")), name)
    return spark.table(name)


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey * c_nationkey AS p13 FROM customer")
def math_pow_exact(spark, d):
    """Powers beyond what a double holds exactly."""
    return project(table(spark, d, "customer"), ["c_custkey"], p13=col("c_nationkey").pow(13))


# -- expressions ------------------------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber"]
LINE_SQL = "SELECT l_orderkey, l_linenumber, "


@query(LINE_SQL + "l_quantity > 25 AS gt, l_quantity >= 25 AS ge, l_quantity < 25 AS lt, l_quantity <= 25 AS le, l_returnflag = 'A' AS eq, l_returnflag <> 'A' AS ne, CAST(NULL AS BOOLEAN) AS ne_none FROM lineitem")
def cmp_all(spark, d):
    q, f = col("l_quantity"), col("l_returnflag")
    return project(table(spark, d, "lineitem"), LINE, gt=q > 25, ge=q >= 25, lt=q < 25, le=q <= 25, eq=f == "A", ne=f != "A", ne_none=f != None)  # noqa: E711


@query(LINE_SQL + "l_orderkey + l_partkey AS added, l_orderkey - l_partkey AS less, l_linenumber * l_suppkey AS times, l_extendedprice / l_quantity AS per, l_returnflag || l_linestatus AS flags FROM lineitem")
def arith_all(spark, d):
    return project(table(spark, d, "lineitem"), LINE, added=col("l_orderkey") + col("l_partkey"), less=col("l_orderkey") - col("l_partkey"), times=col("l_linenumber") * col("l_suppkey"), per=col("l_extendedprice") / col("l_quantity"), flags=col("l_returnflag") + col("l_linestatus"))


@query(LINE_SQL + "CASE WHEN l_quantity > 25 THEN 'inf' WHEN l_quantity < 25 THEN '-inf' ELSE 'nan' END AS by_zero FROM lineitem")
def div_by_zero(spark, d):
    x = F.col("by_zero")
    out = project(table(spark, d, "lineitem"), LINE, by_zero=(col("l_quantity") - 25) / (col("l_tax") * 0))
    return out.withColumn("by_zero", F.when(F.isnan(x), "nan").when(x > 0, "inf").when(x < 0, "-inf"))


@query(LINE_SQL + "(nullif(l_discount, 0) > 0.05) AND (l_tax > 0.04) AS both, (nullif(l_discount, 0) > 0.05) OR (l_tax > 0.04) AS either, NOT (nullif(l_discount, 0) > 0.05) AS neither FROM lineitem")
def logic_kleene(spark, d):
    a, b = col("discount") > 0.05, col("l_tax") > 0.04
    return project(table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))), LINE, both=a & b, either=a | b, neither=~a)


@query(LINE_SQL + "l_discount = 0 AS without, l_discount <> 0 AS has FROM lineitem")
def null_tests(spark, d):
    x = col("discount")
    return project(table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))), LINE, without=x.is_null(), has=x.is_not_null())


@query("SELECT c_custkey, round_even(c_acctbal, 1) AS tenths, round_even(c_acctbal, 0) AS ones FROM customer")
def math_round_even(spark, d):
    return project(table(spark, d, "customer"), ["c_custkey"], tenths=col("c_acctbal").round(1), ones=col("c_acctbal").round())


@query("SELECT c_custkey, floor(c_acctbal) AS down, ceil(c_acctbal) AS up FROM customer")
def math_floor_ceil(spark, d):
    return project(table(spark, d, "customer"), ["c_custkey"], down=col("c_acctbal").floor(), up=col("c_acctbal").ceil())


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) ELSE 'nan'::DOUBLE END AS root, round(c_acctbal * c_acctbal, 4) AS square, CAST(c_nationkey * c_nationkey * c_nationkey AS BIGINT) AS cube, abs(c_acctbal) AS size FROM customer")
def math_sqrt_pow_abs(spark, d):
    out = project(table(spark, d, "customer"), ["c_custkey"], root=col("c_acctbal").sqrt(), square=col("c_acctbal").pow(2), cube=col("c_nationkey").pow(3), size=col("c_acctbal").abs())
    return out.withColumn("root", F.round("root", 6)).withColumn("square", F.round("square", 4))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, c_nationkey IN (1, 2, 3) AS near, false AS nowhere FROM customer")
def in_list(spark, d):
    return project(table(spark, d, "customer"), ["c_custkey"], listed=col("c_mktsegment").is_in(["BUILDING", "MACHINERY", None]), near=col("c_nationkey").is_in({1, 2, 3}), nowhere=col("c_nationkey").is_in([]))


@query(LINE_SQL + "nullif(l_discount, 0) IN (0.01, 0.02) AS plain, coalesce(nullif(l_discount, 0) IN (0.01, 0.02), true) AS equal FROM lineitem")
def in_nulls_equal(spark, d):
    x = col("discount")
    return project(table(spark, d, "lineitem").withColumn("discount", F.nullif("l_discount", F.lit(0.0))), LINE, plain=x.is_in([0.01, 0.02, None]), equal=x.is_in([None, 0.01, 0.02], nulls_equal=True))


@query("SELECT s_suppkey, s_suppkey IN (SELECT s_nationkey FROM supplier) AS found FROM supplier")
def in_column(spark, d):
    return project(table(spark, d, "supplier"), ["s_suppkey"], found=col("s_suppkey").is_in(col("s_nationkey")))


@query(LINE_SQL + "l_quantity BETWEEN 10 AND 20 AS both, l_quantity >= 10 AND l_quantity < 20 AS \"left\", l_quantity > 10 AND l_quantity <= 20 AS \"right\", l_quantity > 10 AND l_quantity < 20 AS none FROM lineitem")
def between_closed(spark, d):
    q = col("l_quantity")
    return project(table(spark, d, "lineitem"), LINE, **{c: q.is_between(10, 20, closed=c) for c in ("both", "left", "right", "none")})


@query(LINE_SQL + "l_linenumber >= l_discount * 50 AND l_linenumber <= l_quantity AS inside, CASE WHEN l_quantity > 10 THEN false END AS open FROM lineitem")
def between_columns(spark, d):
    return project(table(spark, d, "lineitem"), LINE, inside=col("l_linenumber").is_between(col("l_discount") * 50, "l_quantity"), open=col("l_quantity").is_between(None, 10))


@query("SELECT p_partkey, regexp_matches(p_name, '^s.*[gl]$') AS found, regexp_matches(p_brand, '#[0-3]') AS low FROM part")
def str_contains(spark, d):
    return project(table(spark, d, "part"), ["p_partkey"], found=col("p_name").str.contains("^s.*[gl]$"), low=col("p_brand").str.contains("#[0-3]"))


@query("SELECT p_partkey, starts_with(p_name, 'small') AS small, ends_with(p_name, 'ring') AS ring FROM part")
def str_prefix_suffix(spark, d):
    return project(table(spark, d, "part"), ["p_partkey"], small=col("p_name").str.starts_with("small"), ring=col("p_name").str.ends_with("ring"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def str_len(spark, d):
    return project(table(spark, d, "documents"), ["doc_id"], n=col("text").str.len_chars())


@query("SELECT p_partkey, p_name AS stripped FROM part")
def str_strip(spark, d):
    padded = table(spark, d, "part").withColumn("p", F.concat(F.lit(" \t\n"), "p_name", F.lit("\r\n ")))
    return project(padded, ["p_partkey"], stripped=col("p").str.strip_chars())


@query("SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up FROM part")
def str_case(spark, d):
    return project(table(spark, d, "part"), ["p_partkey"], low=col("p_brand").str.to_lowercase(), up=col("p_name").str.to_uppercase())


@query("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, regexp_replace(c_name, '([a-z]+)', '<\\1>', 'g') AS marked FROM customer")
def str_replace_all(spark, d):
    return project(table(spark, d, "customer"), ["c_custkey"], digits=col("c_name").str.replace("[^0-9]", ""), marked=col("c_name").str.replace("([a-z]+)", "<$1>"))


@query("SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, nullif(regexp_extract(url, '[0-9]+[.]html$', 0), '') AS file FROM pages")
def str_extract(spark, d):
    return project(table(spark, d, "pages"), ["page_id"], host=col("url").str.extract("//([^/]+)/", 1), file=col("url").str.extract("[0-9]+[.]html$"))


@query("SELECT p_partkey, substr(p_name, 1, 3) AS first, substr(p_name, 3) AS rest FROM part")
def str_slice(spark, d):
    return project(table(spark, d, "part"), ["p_partkey"], first=col("p_name").str.slice(0, 3), rest=col("p_name").str.slice(2))


@query("SELECT p_partkey, right(p_name, 4) AS last, left(right(p_name, 4), 2) AS two FROM part")
def str_slice_negative(spark, d):
    return project(table(spark, d, "part"), ["p_partkey"], last=col("p_name").str.slice(-4), two=col("p_name").str.slice(-4, 2))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[aeiou]+')) AS n FROM conversations")
def str_count_matches(spark, d):
    return project(table(spark, d, "conversations"), ["conv_id", "turn"], n=col("text").str.count_matches("[aeiou]+"))


@query("SELECT p_partkey, length(replace(upper(p_name), ' ', '')) > 8 AS long FROM part")
def str_chain(spark, d):
    return project(table(spark, d, "part"), ["p_partkey"], long=col("p_name").str.to_uppercase().str.replace(" ", "").str.len_chars() > 8)


@query("SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")
def dt_components(spark, d):
    t = col("ts").dt
    return project(table(spark, d, "events"), ["event_id"], y=t.year(), mo=t.month(), d=t.day(), h=t.hour(), mi=t.minute(), s=t.second())


@query(LINE_SQL + "datesub('day', TIMESTAMP '1998-06-15 13:30:00', l_shipdate) AS days FROM lineitem")
def dt_total_days(spark, d):
    return project(table(spark, d, "lineitem"), LINE, days=col("l_shipdate").dt.total_days(datetime(1998, 6, 15, 13, 30)))
