"""From raw documents to packed training sequences, as five stages over written tables.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlemart.llm import decontamination, language_id, line_dedup, minhash, packing
from titlemart.llm.common import by_ids, read, shared_table
from titlemart.llm.queries import END_ID, vocabulary


#: The columns that stages read or change.
READ = ("doc_id", "text", "lang", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """The columns that stages do not read under names of their own, so that none clashes with an operator's."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in READ else f"column_{i}") for i, c in enumerate(docs.columns)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a null lang becomes the predicted one.  Those without a letter (``und``) go.

    Null and empty texts have no letter and go.  Ties are the language that sorts first.  Repeated rows, null ids and columns of any
    name are carried through.  Without any labelled row every document is ``und`` and goes; an empty table stays empty.
    """
    own = _apart(docs)
    model = language_id.train(own.select("text", "lang"))
    done = language_id.predicted(own, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return done.select(*(F.coalesce("lang", "lang_pred") if c == "lang" else F.col(c) for c in own.columns)).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share; n_chars follows.

    Null texts stay null, and a text that loses all lines is empty.  Rows that repeat both id and text count as one document and all stay, as do
    null ids and columns of any name; an empty table stays empty.
    """
    done = line_dedup.decided(docs, at_least=10)
    lost = F.col("n_dropped") > 0
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return done.select(
        *((F.when(lost, changed[c]).otherwise(F.col(f"row.`{c}`")) if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Documents without words (null or empty texts) are nobody's duplicates and stay, as do those with a null id.  Rows of one id stay or go together;
    columns of any name are carried through; an empty table stays empty.
    """
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).filter("NOT kept").select("doc_id").distinct()
    return by_ids(docs, gone, "left_anti")


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do all documents where the benchmark is empty.  Each row is judged by itself; repeated rows, null ids
    and columns of any name are carried through; an empty table stays empty.
    """
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each token piece of the documents, with its place in a sequence of at most 4096.

    Null and empty texts are the end id alone.  Repeated rows are pieces of their own, equal lengths take places in any order, null ids are carried
    through, other columns are not; an empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary(), end_id=END_ID, capacity=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_documents),
    ("best_fit_packing", pack_sequences),
]

#: Language inference, near-duplicate groups and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; tables between stages go to the shared folder, and stay there: the result is read from the last of them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
