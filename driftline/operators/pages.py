"""URLs of the vocabulary, the text of their captured pages, and what came of each."""

from pyspark.sql import DataFrame, functions as F

from driftline.fields import NOTE_NO_CONTENT, NOTE_NO_TEXT, NOTE_OK, NOTE_RENDER_FAILED
from driftline.functions.text import (
    fetch_route, html_to_text, is_loose_url, is_real_url, is_strict_url,
)
from driftline.operators.vocabulary import VALUE, ranked_vocabulary

UID = "samplingProtocol_uid"


def url_candidates(vocab: DataFrame) -> DataFrame:
    """Values that look like an address; the uid is their 0-based rank in the whole vocabulary."""
    ranked = ranked_vocabulary(vocab)
    return ranked.filter(is_loose_url(F.col(VALUE))).select(
        (F.col("rank") - 1).alias(UID), VALUE, "n_count",
        is_strict_url(F.col(VALUE)).alias("is_strict"),
        is_real_url(F.col(VALUE)).alias("is_real_url"),
        fetch_route(F.col(VALUE)).alias("route"),
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """Main text of every captured page, with its length in characters and words."""
    text = pages.select("page_id", "url", html_to_text(F.col("html")).alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return text.select(
        "*", F.length("text").cast("long").alias("n_chars"), F.size(words).cast("long").alias("n_words")
    )


def first_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Address, text and emptiness (null without HTML) of the first captured page of each candidate.

    Captures are reduced to one id per address before any join, so an address that was captured a
    great many times is added up where it is read. Text is taken where the chosen pages are read;
    HTML is not shuffled on its own account. Copies of a page count once.
    """
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    chosen = first.join(candidates.select(F.col(VALUE).alias("url")), "url", "left_semi")
    texts = pages.join(chosen, ["url", "page_id"], "left_semi").select(
        F.col("url").alias(VALUE), html_to_text(F.col("html")).alias("text"),
        (F.col("html") == "").alias("empty"),
    )
    return texts.groupBy(VALUE).agg(F.min("text").alias("text"), F.min("empty").alias("empty"))


def url_outcomes(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per candidate: was text extracted, where is it, and if not, why.

    A page on the rendered route that was never captured could not be read; one that was captured
    empty counts as not downloaded, as on the static route.
    """
    outcome = candidates.join(first_pages(candidates, pages), VALUE, "left")
    missing = F.coalesce("empty", F.lit(True))
    rendered = F.col("route") == "rendered"
    note = (
        F.when(F.col("empty").isNull() & rendered, NOTE_RENDER_FAILED)
        .when(missing, NOTE_NO_CONTENT)
        .when(F.col("text").isNull(), NOTE_NO_TEXT)
        .otherwise(NOTE_OK)
    )
    ok = F.col("text").isNotNull() & ~missing
    return outcome.select(
        UID, VALUE, ok.alias("successful_extraction"), "is_real_url",
        F.when(ok, F.format_string("extracted_url_%05d.md", F.col(UID))).otherwise("")
        .alias("extracted_md_fpath"),
        note.alias("extraction_notes"), "text",
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("successful_extraction", "is_real_url", "extraction_notes").agg(
        F.count("*").alias("n")
    )


def text_size_stats(texts: DataFrame, by=()) -> DataFrame:
    """Number and size of the extracted texts."""
    return texts.groupBy(*by).agg(
        F.count("*").alias("n_pages"),
        F.count("text").alias("n_texts"),
        F.sum("n_chars").alias("sum_chars"), F.min("n_chars").alias("min_chars"),
        F.max("n_chars").alias("max_chars"), F.sum("n_words").alias("sum_words"),
    )
