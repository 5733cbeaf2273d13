"""From documents to a mixed, tokenizable corpus: language ID, near duplicates, mixing, tokens.

Each stage gets the session, what the stage before it kept, and the folder of the tables; run()
writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm._shared import split_of, table, tokenizer_path, written
from corpuskit.llm.bpe import bpe
from corpuskit.llm.langid import UNDETERMINED, identify, train
from corpuskit.llm.mixing import mixed_documents
from corpuskit.llm.ngram_join import first_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without letters go; those between two languages stay, as do all with letters if no label trains a model."""
    model = train(docs.filter(split_of(F.col("doc_id"), 4) != 2))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return identify(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at 0.8 or more."""
    return first_of_each(docs.select(*COLUMNS), width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each text, with their number."""
    return bpe(docs.select("doc_id", "source", "text"), tokenizer_path("byte_bpe_50k.json"), outputs=("ids", "n_tokens"), keep_text=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: Language models and hash-random order have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
