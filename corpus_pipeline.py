"""A training-data pipeline over the documents table: STAGES in order, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
columns beside doc_id, text, lang and source may have any names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, jaccard_join, line_dedup, packing, robust_quality, runtime


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier rule reject go.

    Null and empty texts go (they have under ten words); null lang or source is a group of its own; rows that repeat, and
    rows without a doc_id, are judged each on its own and alike.
    """
    return robust_quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of lines that an earlier document has go; n_chars follows; documents emptied by it go.

    Null texts stay null, empty ones empty, and empty lines stay; rows without a doc_id stay as they are; rows that repeat a
    doc_id aren't compared with each other.
    """
    out = line_dedup.dedup_lines(docs, drop_emptied=True, every=True)
    return out.selectExpr(*("length(text) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns)).to(docs.schema)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (5-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Null, empty and wordless texts link with nothing and stay, as does a row without a doc_id; rows that repeat a doc_id stay or
    go together.
    """
    comp = jaccard_join.jaccard_components(docs, k=5, percent=80).where("component_id < doc_id").selectExpr("doc_id AS __id").distinct()
    gone = runtime.cut(comp, "gone")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows go.

    Null and empty texts have no words and stay; rows that repeat are judged alike; an empty benchmark removes nothing.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences and places. Null and empty texts are one piece, the end id; rows that repeat are packed each on its own."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Quality rules, alignment and packing aren't expressible in SQL; tests/llm holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = runtime.cut(docs, "stage")
    return docs
