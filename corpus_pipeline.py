"""A corpus pipeline of five stages: language, repeated lines, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before it kept, and returns the columns of ``documents``; the last returns the
packed pieces. ``run`` writes each result as Parquet and rereads it. An empty
table gives no rows in any stage; further columns are passed on, whatever their
names, but for ``text`` and ``n_chars`` of documents that are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmere.llm import chosen_path, compact_windows, language_crf, line_suffixes, packing
from glyphmere.llm._common import documents, stored, tokenizer_file

#: Least mean, over the words, of the greatest posterior of any language.
SURE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and in ``row`` the other columns, whose names can't clash there."""
    return docs.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row"))


def _back(docs: DataFrame, told: DataFrame, new: dict | None = None) -> DataFrame:
    """The columns of ``docs``, from rows made of ``_rows`` of it; ``new`` ones replaced."""
    return told.select([(new or {}).get(c, F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words have no letters, or are of no certain language (a mean below ``SURE``), go; mixed ones stay.

    Null and empty texts go. Repeated rows are judged one by one, and alike.
    Without labels all stay.
    """
    model = language_crf.train(docs)
    if model is None:
        return docs
    told = language_crf.predict(_rows(docs), model, word_score=True)
    return _back(docs, told.where((F.col("lang_pred") != "und") & (F.col("word_score") >= SURE)))


def _with_rest(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Documents with what is left of their text; those that were cut and of which nothing is left go."""
    cut = F.col("n_cut") > 0
    new = {"text": F.when(cut, F.col("rest")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("rest").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _back(docs, told.where(~cut | F.col("rest").rlike(r"[^ \t-\r]")), new)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies (by id, then line) of repeated line runs of 100 characters or more are deleted.

    Documents of which nothing is left go; those that were empty or null before
    stay. Repeated rows are one document and all stay; of one text under several
    ids the least one's stays.
    """
    return _with_rest(docs, line_suffixes.dedup(_rows(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the least by id, then by a hash of its text, then by its other columns.

    Null texts, and texts without words, are one class.
    """
    return chosen_path.deduplicated(docs).select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies (by id, then place) of repeated passages of 50 words or more are cut.

    Documents of which nothing is left go; those that were empty or null before
    stay. Rows that share an id are not compared at the same place, so repeated
    rows all stay.
    """
    return _with_rest(docs, compact_windows.find_repeats(_rows(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 1024 tokens. Null text is a document of its end alone; repeated rows are packed as separate documents."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packed)]

#: SQL can express neither the models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
