"""The corpus pipeline: language ID, quality rules, near duplicates, decontamination, encoding.

A stage is a function of its input alone. It may be given the result of another stage that isn't written yet, and
stages of several runs may be mixed: none removes what another reads. Texts come out as they are read, with
bytes that aren't UTF-8 as U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.llm import decontaminate, encoding, jaccard, langid, rules
from costloom.llm.common import drop_tables, durable, fresh_path, table, valid_text, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Texts of fewer characters teach no bound. Bits that a text may need over its language's bound, whatever its length.
LONG, SLACK = 64, 64


def language_bounds(found: DataFrame, factor: float = 2.0, least: float = 4.0) -> dict[str, float]:
    """Bits per character that texts of each learnt language may need.

    ``factor`` times the 95th percentile of the long rows labelled with the language and identified as it,
    so that up to a twentieth of junk among them doesn't move the bound; ``least`` where they are few and
    parse their own sample. Languages without such rows have no bound.
    """
    rows = found.where((F.col("lang") == F.col("lang_pred")) & (F.length("text") >= LONG))
    high = rows.groupBy("lang_pred").agg(F.percentile_approx("bits_per_char", 0.95, 1000).alias("high"))
    return {r["lang_pred"]: max(least, factor * r["high"]) for r in high.collect()}  # one row a learnt language


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the identified language; documents without a letter, or too strange to all languages, go.

    So do null and empty texts. Repeated rows stay; rows without a ``lang`` or doc_id are identified like others.
    """
    found = langid.identify(docs.withColumn("text", valid_text(F.col("text"))), F.lit(True), COLUMNS)
    # identified twice, once for the bounds, rather than kept as another copy of all texts
    bounds = language_bounds(found)
    kept = F.col("lang_pred") != "und"
    if bounds:
        bound = F.try_element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang_pred"))
        over = (F.col("bits_per_char") - bound) * F.length("text") > SLACK
        kept = kept & ~F.coalesce(over, F.lit(False))
    return found.where(kept).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a fixed or learnt rule rejects go; a null or empty text fails the fixed rules; repeated rows are judged alike."""
    counts = durable(rules.measure(docs, ["doc_id", "lang"]), "stage-counts")
    thresholds = rules.learn_thresholds(counts, table(spark, sf_dir, "labels"), "lang", alpha=0.05, delta=0.05)
    # counted again where the texts are, rather than kept with another copy of them
    return rules.judge(rules.measure(docs, COLUMNS), thresholds).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id stays; of rows equal in doc_id and text one stays.

    Rows without a doc_id take part by a hash of their text and come after all doc_ids. Null and empty texts
    link with nothing, but their repeats go as well.
    """
    text = F.coalesce(valid_text(F.col("text")), F.lit(""))
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62))
    keyed = docs.select(*COLUMNS, own.alias("__id"), F.xxhash64(text, F.col("text").isNull()).alias("__hash"))
    groups = jaccard.near_duplicates(keyed.select(F.col("__id").alias("doc_id"), "text"), words=5, percent=80)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = keyed.join(gone, "__id", "left_anti")
    repeats = durable(keyed.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "stage-repeats")
    if not repeats.isEmpty():
        once = kept.join(repeats, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
        kept = kept.join(repeats, ["__id", "__hash"], "left_anti").unionByName(once)
    return kept.select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts have none and stay."""
    found = decontaminate.contaminated_spans(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.where("n_hit = 0").select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left; null and empty texts have none."""
    encoded = encoding.encode_texts(docs, ["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language identification and encoding can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and reread by the next.

    When a stage is written, what it wrote besides and its own input go; only the last result stays. Each run has
    lists of its own, so several runs at once don't meet.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with written() as own:
            stage(spark, docs, sf_dir).write.parquet(path)
        drop_tables(spark, [*own, *before])
        docs, before = spark.read.parquet(path), [path]
    return docs
