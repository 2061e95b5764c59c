"""From documents to training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm import langid, linededup, mixing, packing, simhash, tokens
from plumbline.llm.common import free, scratch

#: Least mean probability of the predicted language; below it a text reads like none of the learned languages.
MIN_SCORE = 0.4


def _key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds what tells a row apart in joins, under names that are free: its identifier, null made plain, its text's hash
    and its number among the rows that agree in both, in the order of a hash of all columns."""
    k, h, n = free(docs, "doc_key"), free(docs, "doc_hash"), free(docs, "doc_nth")
    keyed = docs.withColumn(k, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn(h, F.xxhash64("text"))
    return keyed.withColumn(n, F.row_number().over(Window.partitionBy(k, h).orderBy(F.xxhash64(*docs.columns)))), [k, h, n]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; without letters, or unlike every learned language, they go."""
    net = langid.train(docs)
    if net is None:  # nothing is labelled: only texts without letters are known to be no language
        return docs.filter(F.col("text").rlike("\\p{L}"))
    guess = free(docs, "guess")
    out = langid.identify(docs, net, into=guess)
    return out.filter((F.col(f"{guess}.lang") != langid.UNKNOWN) & (F.col(f"{guess}.score") >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go but for their first occurrence; a document goes if nothing is left of it."""
    lost = free(docs, "lost")
    out = linededup.drop_recurring(docs, lost_col=lost)
    out = out.filter((F.col(lost) == 0) | F.col("text").rlike("\\S"))
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least doc_id, then text hash, then row hash."""
    keyed, (k, h, n) = _key(docs)
    first = simhash.near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    first = first.select(F.coalesce(F.col("one.doc_id").cast("string"), F.lit("null")).alias(k), F.col("one.text_hash").alias(h))
    return keyed.filter(F.col(n) == 1).join(first, [k, h], "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Rows that agree in every column are one row, taken as often as all."""
    k, h, n = free(docs, "doc_key"), free(docs, "doc_hash"), free(docs, "doc_copies")
    keyed = docs.withColumn(k, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))).withColumn(h, F.xxhash64(*docs.columns))
    taken = mixing.mix(keyed, keep=(k, h)).groupBy(k, h).agg(F.sum("copies").alias(n)).filter(F.col(n) > 0)
    out = keyed.join(taken, [k, h]).dropDuplicates([k, h])
    return out.withColumn(free(out, "copy"), F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack(docs, tokens.vocabulary(tokens.BYTE_BPE), 1)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("source mix", mixture), ("packing", sequences)]

#: The classifier, the template tree, XXH64 and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
