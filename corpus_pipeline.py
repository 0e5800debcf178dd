"""The training-data pipeline over ``documents``: five stages, each written out before the next.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.llm import decontamination, language_id, line_dedup, ngram_join, packing
from driftline.llm.common import broadcast_up_to, held_out, rows_a_batch, table, text_key, without_texts
from driftline.llm.queries import cut_documents
from driftline.staging import scratch_path, staged

#: The language models are trained, and tokens packed, outside SQL; tests hold the rows of ``run``
#: against a brute-force version.
ORACLE_SQL = None

#: Texts that a task sends to Python at a time to be cut into pieces.
PACKED_ROWS_AT_A_TIME = 1_000


def _apart(docs: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with own columns of these names renamed, for a step that uses the names, and the way back."""
    renamed = {n: f"__own_{i}" for i, n in enumerate(names) if n in docs.columns}
    return docs.withColumnsRenamed(renamed), {new: old for old, new in renamed.items()}


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that language identification rejects go.

    Null texts and texts without letters are among the rejected. Only the keys of rejected texts come back
    from Python; the documents are read once more and keep all columns.
    """
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    texts = docs.where("text is not null")
    given = texts.select(text_key(F.col("text")).alias("key"), "text")
    with rows_a_batch(spark, language_id.ROWS_AT_A_TIME):
        rejected = staged(language_id.identify(given, model).where("rejected").select("key"), "rejected-texts")
    return without_texts(texts, rejected)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; ``n_chars`` is counted again.

    Columns of any other name keep their values.
    """
    given, back = _apart(docs, ["n_lines", "n_removed", "__host", "__keys", "__kept"])
    clean = line_dedup.drop_boilerplate(given).drop("n_lines", "n_removed").withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, and of an id's rows one.

    Documents without words or without an id are no group and stay.
    """
    joined = staged(ngram_join.join_components(docs), "joined-documents")
    copies = staged(
        joined.where("doc_id <> component_id").select("doc_id").distinct(), "copies"
    )
    kept = docs.join(broadcast_up_to(copies, ngram_join.BROADCAST_ROWS), "doc_id", "left_anti")
    repeated = staged(
        joined.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("doc_id"), "repeated-ids",
    )
    if not repeated.isEmpty():
        small = broadcast_up_to(repeated, ngram_join.BROADCAST_ROWS)
        kept = kept.join(small, "doc_id", "left_anti").unionByName(
            kept.join(small, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        )
    return kept.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    with rows_a_batch(spark, PACKED_ROWS_AT_A_TIME):
        return packing.pack(cut_documents(docs))  # texts are cut, and the pieces written, within


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_boilerplate),
    ("ngram_join", deduplicated),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
