"""From raw documents to a training mix, in five stages that each call one operator."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from bandwise.llm import decontamination, langid, lines, mixing, shingles  # noqa: E402
from bandwise.llm.common import remainder_of_id, stored, table  # noqa: E402

#: Documents that look less like any learned language go: held-out documents of sf0.1 have 0.79 and more, but for one in
#: a thousand, random letters and unlearned languages 0.2 to 0.7 (without the allowance for short texts).
LEAST_FIT = 0.72


def row_key(doc_id: Column, body: Column) -> Column:
    """A text under its id; unlike a plain hash it tells a null id from none."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), body.cast("string"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters, or that are in no language the model knows.

    Null and empty texts have no letters, so they go. Long texts are judged whole. Each row is judged by its text alone:
    repeated rows, and rows of one id or none, stay or go by their own text. An empty table, or one without any language
    to learn from, gives the documents with letters. Other columns stay, but names that begin with an underscore are
    the stage's own.
    """
    model = langid.train(docs, remainder_of_id(F.col("doc_id"), 4) != 2, F.col("doc_id"))
    known = langid.identify(docs, model)
    if model is None:  # nothing to learn from: only texts without letters can be told
        return langid.with_letters(docs)
    good = (F.col("_lang_pred") != langid.UNDETERMINED) & (F.col("_fit") >= LEAST_FIT)
    return known.filter(good).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that another document has as well; null texts stay null.

    No row goes: a document that loses all its lines has an empty text, and `n_chars` counts what is left. The smallest
    id keeps a shared line; rows of one id are one document and lose nothing to each other, and null ids are one document
    that comes last. Long texts lose lines wherever they stand. An empty table stays empty; names of other columns
    matter only if they begin with an underscore.
    """
    done = lines.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    done = done.withColumns({"text": text, "n_chars": F.char_length(text).cast("long")})
    return done.select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, Jaccard 0.8 or more): the smallest id, then text.

    Texts without words, null and empty ones too, are one group, of which a row stays. Null ids come last. Among rows of
    one id the one with the smallest text hash stays; repeats of a row are one. Texts are compared whole, shorter ones
    than five words as one shingle. An empty table stays empty; names of other columns matter only if they begin with an
    underscore.
    """
    keyed = docs.withColumn("_row", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("body")))
    found = shingles.near_copies(keyed)
    order = F.struct(F.col("_row.id").isNull().alias("last"), "_row")
    first = found.groupBy("_group").agg(F.min(order).alias("_first"))
    keep = first.select(row_key(F.col("_first._row.id"), F.col("_first._row.body")).alias("_key"))
    mine = docs.withColumn("_key", row_key(F.col("doc_id"), F.xxhash64("text")))
    # Repeats of the row that stays have its key as well.
    return mine.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain an item of the benchmark; whatever other columns they have, also `_id` or `_body`.

    Null and empty texts, and texts or items of fewer than five words, contain nothing, so those documents stay. Long
    texts are searched whole. Repeated rows go or stay together, other rows of the same id by their own text. Without
    documents or without items nothing goes.
    """
    found = decontamination.contaminated_documents(docs, table(spark, sf_dir, "benchmark"))
    found = found.select("_id", "_body").alias("found")
    same = F.col("own.doc_id").eqNullSafe(F.col("found._id")) & (F.xxhash64("own.text") == F.col("found._body"))
    return docs.alias("own").join(found, same, "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, and how many.

    Null, empty and wordless texts have no words to take, so they go. Rows without a source are a source of their own.
    Rows of equal key, as repeated ones, share alike what is taken of them, rounded down. Long texts count all their
    words. An empty table stays empty. Columns named `size`, `source_size`, `target` or `taken` are replaced, others stay.
    """
    return mixing.mix(docs, keep_columns=True).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("source_mix", source_mix),
]

#: Fitted models, fingerprints and templates cannot be written in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
