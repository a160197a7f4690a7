"""Documents to packed sequences: quality rules, near copies, repeated passages, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievestone.llm._store import dropped, side_tables, table, unused, written
from sievestone.llm.best_fit_packing import pack_documents
from sievestone.llm.mix_sources import mix_sources
from sievestone.llm.ngram_jaccard import keep_first
from sievestone.llm.quality_rules import keep_good
from sievestone.llm.suffix_dedup import keep_unrepeated

#: A source may be passed so often at most in one epoch of the mix.
MOST_PASSES = 1.25


# A stage deletes what stages before it have made beside their results, once these are written and read again.
# All stages: null texts and texts of any length pass as wholes, an empty table gives none, and further columns pass
# through under any name.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null, empty and short texts among them.  Rows without an identifier, and rows that share one but not the text, are judged each by themselves."""
    with side_tables(docs):
        return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least identifier: five-word shingles, similarity of 0.8 or more.  Rows of one identifier stay or go together."""
    with side_tables(docs):
        return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller doc_id has go, and documents of which nothing is left.  Rows that share an identifier but not the text stay whole."""
    with side_tables(docs):
        return keep_unrepeated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources again as far as their weight asks for it; a null source is one of its own."""
    with side_tables(docs):
        (other,) = unused([*docs.columns, "mix"], "mix")
        mixed = mix_sources(docs.withColumnRenamed("mix", other), max_repeat=MOST_PASSES)
        return mixed.drop("mix").withColumnRenamed(other, "mix").select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    with side_tables(docs):
        return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix),
    ("best-fit packing", packing),
]
#: Tokenizing and hash orders have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if k:
                dropped(before)  # its successor is a table of its own
    return docs
