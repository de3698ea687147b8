"""From raw documents to token shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's ``docs``. All but the last return the columns of ``documents``.
As a stage's result has been written when the next one begins, what it kept in the shared folder goes then; the token files stay.
Executors give the memory that it left unused back then too.

A row is told from others by its doc_id and its text's hash, so rows that share an id are each judged by their own text.

Cases, for every stage. A null, empty or wordless text isn't toxic, links with nothing, holds no item, has size 0 (the mix takes none of it)
and, where it gets to the tokens, is the end id alone. Of rows that are repeated whole, the near-duplicate stage keeps one if they have words. A null id or source
is a value of its own. An empty table gives empty tables. Columns beside those of ``documents`` are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablepact.llm import decontaminate, mixing, ngram_join, token_codes, toxicity
from tablepact.llm.store import Scratch, collecting

#: Rows of two numbers and two flags are broadcast up to this number (some 64 MB), and joined by a shuffle beyond it.
BROADCAST_ROWS = 1_000_000

#: What goes to a Python worker at once, in rows and in bytes (a longer row goes by itself). A batch is in memory on both sides, in buffers that the executor
#: keeps, so a session that has Spark's defaults, the keys' second values, gets these; any other value stays as it is set.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("4194304b", "67108864b")}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_open: list[Scratch] = []


def _compact(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their heaps shrink to what is in use.

    A heap grows with the busiest stage and keeps that size, while the next one's Python workers and buffers come beside it. A task for each core
    reaches the executors; collections that meet in one of them are done once.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def _stage(work: Stage, keep: bool = False) -> Stage:
    """A stage that first removes what the one before it kept in the shared folder, and lets the executors' heaps shrink."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _open:
            _open.pop().remove()
        _compact(spark)
        for key, (value, default) in ARROW.items():
            if spark.conf.get(key, None) == default:
                spark.conf.set(key, value)
        with collecting() as made:
            out = work(spark, docs, sf_dir)
        if not keep:
            _open.extend(made)
        return out

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


def _aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with columns that an operator would replace under other names."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in names})


def _back(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select([F.col(f"__own_{c}").alias(c) if f"__own_{c}" in docs.columns else F.col(c) for c in columns])


def _marked(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` with their hash, joined with rows (__id, __text, ...) that tell documents by id and hash."""
    few = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    return keyed.join(few, keyed["doc_id"].eqNullSafe(few["__id"]) & (keyed["__hash"] == few["__text"]), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is fitted on labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out("doc_id")))
    return _back(toxicity.score(_aside(docs, ("score", "predicted")), model).filter("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that of the smallest id, and of those the one of the smallest hash; of equal rows, one."""
    scratch = Scratch(spark, "near")
    near = ngram_join.join(docs, size=5, percent=75).filter("group_id IS NOT NULL")
    rows = scratch.table(near.groupBy("group_id", "doc_id", "text_hash").agg(F.count("*").alias("m")), "rows")
    this = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = rows.groupBy("group_id").agg(F.min(this).alias("first"))
    marks = rows.join(first, "group_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), (~this.eqNullSafe(F.col("first"))).alias("__gone"), (F.col("m") > 1).alias("__repeated"))
    kept = _marked(docs, scratch.table(marks.filter("__gone OR __repeated"), "marks"), "left").filter("__gone IS NULL OR NOT __gone")
    once = kept.filter("__repeated IS NULL OR NOT __repeated")
    return once.unionByName(kept.filter("__repeated").dropDuplicates(["doc_id", "__hash"])).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    places, _ = decontaminate.hits(docs, benchmark, window=10)
    bad = places.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct()
    return _marked(docs, Scratch(spark, "contaminated").table(bad, "bad"), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(_aside(docs, mixing.ADDED), weights=(5.0, 2.0, 1.0), share=1.5, limit=2)
    return _back(mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in directly addressable codes, and what the files hold of each."""
    import public_tokenizers

    return token_codes.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("ngram_jaccard", _stage(drop_near_duplicates)),
    ("decontamination", _stage(drop_contaminated)),
    ("mixing", _stage(mix_sources)),
    ("token_codes", _stage(write_tokens, keep=True)),
]

#: A fitted classifier and a rounding to copies aren't SQL; tests hold each stage's result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each of them written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = written = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        written = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = written
    return written
