"""A corpus pipeline of five stages, each calling one operator: language ID, near-duplicate join, decontamination,
secret redaction, BPE tokens. Every stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.llm import bpe, decontaminate, language_id, ngram_jaccard, secret_scan
from undertow.llm.queries import table, tokenizer_path
from undertow.llm.shared import discard, few, materialise, scratch, spare_name


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no text or no letters, or a score below half of what chance gives (0.5
    over the number of languages: the best language of a text is hardly ever that unlikely, so clean texts stay). Where lang
    is null, the predicted language is written. The model learns from the rows with a lang; without any, only documents
    without letters go. Repeated rows and columns of any names stay as they are."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = spare_name(docs, "_lang"), spare_name(docs, "_score")
    told = language_id.predict(docs, model, "text", lang, score)
    least = 0.5 / sum(map(len, model.languages.values()))
    known = told.where((F.col(lang) != "und") & (F.col(score) >= least))
    return known.withColumn("lang", F.coalesce("lang", F.col(lang))).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked by 80 % of their word 5-grams, keeps one row: that of the smallest id, a null id
    last. Rows are told apart by a hash of id and text, so rows of a null or shared id go only as copies of another text;
    of rows equal in both one stays. Null and empty texts are no copies of anything and stay."""
    row = spare_name(docs, "_row")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    with scratch() as tables:
        members, _ = ngram_jaccard.link(rows, percent=80, width=5, id_col=row, passes=2)
        seen = members.where("n_shingles > 0").groupBy(row, "component_id").agg(F.count("*").alias("times"))
        found = seen.join(rows.groupBy(row).agg(F.min("doc_id").alias("doc_id")), row)
        found = materialise(found.select(row, "times", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("rank")))
        least = found.groupBy("component_id").agg(F.min("rank").alias("least"), F.count("*").alias("n")).where("n > 1")
        least = least.select("component_id", "least", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))  # a component may hold a third of all rows
        salted = found.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(32)).cast("int"))
        gone = tables.keep(materialise(salted.join(least, ["component_id", "salt"]).where("rank <> least").select(row)))
        twice = tables.keep(materialise(found.where("times > 1").select(row).join(gone, row, "left_anti")))
    kept = rows.join(few(gone), row, "left_anti")
    if not twice.isEmpty():
        kept = kept.join(few(twice), row, "left_anti").unionByName(kept.join(few(twice), row, "left_semi").dropDuplicates([row]))
    return kept.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item. The text decides, by its hash, and with it all its copies;
    ids may be null or shared. Null and empty texts stay."""
    text = spare_name(docs, "_text")
    known = docs.withColumn(text, F.xxhash64("text", F.lit(7)))
    leaks = decontaminate.find_leaks(known, table(spark, sf_dir, "benchmark"), id_col=text)
    leaking = materialise(leaks.select(F.col("doc").alias(text)).distinct())
    return known.join(few(leaking), text, "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced and n_chars counted anew (null for a null text). Repeated rows and
    columns of any names stay as they are; texts of any length are searched whole."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to; a null text counts as empty. Of the
    columns doc_id, lang, source and n_chars stay, others go; repeated rows stay."""
    out = bpe.encode_decode(docs.select("doc_id", "text", "lang", "source", "n_chars"), tokenizer_path(), by_words=True)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_known_language),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]

#: Trained models, hashing and BPE are beyond SQL; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way, and its input, are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch() as tables:
            before, docs = docs, tables.keep(materialise(stage(spark, docs, sf_dir)))
        discard(before)
    return docs
