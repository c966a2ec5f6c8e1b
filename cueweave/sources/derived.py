"""Transcript rows from a table of documents, shaped as the JSON reader gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.operators.ordered import KEY


def transcripts_from_documents(documents: DataFrame) -> DataFrame:
    """One transcript per document, narrow.

    Every third document has segments (its lines) and no words.  The others have
    words with closed-form times; some carry ``speaker_id``, some ``speaker``.  All
    have attachments taken from their own text.
    """
    tokens = F.filter(F.split("text", r"[ \t\r\n]+"), lambda t: t != "")
    lines = F.filter(F.split("text", r"\n"), lambda line: F.trim(line) != "")
    key = F.col("doc_id")
    nothing = F.lit(None).cast("string")

    def text_seconds(ms: Column) -> Column:
        return (ms / 1000.0).cast("string")

    def word(token: Column, pos: Column) -> Column:
        start = pos * 420 + F.floor(pos / 9) * 950
        closing = token.rlike(r"^[.,;:!?]+$")
        by_id = pos % 2 == 0
        name = F.concat(F.lit("s"), F.floor(pos / 14) % 3)
        return F.struct(
            F.when(closing, "punctuation").otherwise("word").alias("type"),
            token.alias("text"),
            text_seconds(start).alias("start"),
            text_seconds(start + 60 + 30 * F.length(token)).alias("end"),
            F.when(by_id, name).alias("speaker_id"),
            F.when(~by_id, name).alias("speaker"),
            F.lit(None).cast("array<struct<text:string,start:string,end:string>>").alias("characters"),
        )

    def segment(line: Column, at: Column) -> Column:
        return F.struct(
            line.alias("text"),
            text_seconds(at * 4000).alias("start"),
            text_seconds(at * 4000 + 3500).alias("end"),
        )

    def attachment(requested: str | None, extension: str | None, content: Column, encoded: bool) -> Column:
        return F.struct(
            F.lit(requested).cast("string").alias("requested_format"),
            F.lit(extension).cast("string").alias("file_extension"),
            content.alias("content"),
            F.lit(encoded).alias("is_base64_encoded"),
        )

    items = F.filter(
        F.array(
            attachment("SRT", ".srt", F.when(key % 4 == 0, F.col("text")), False),
            attachment("txt", None, F.when(key % 5 != 0, F.col("text")), False),
            attachment("segmented_json", "json", F.col("text"), False),
            attachment("docx", "docx", F.base64(F.encode("text", "UTF-8")), True),
            attachment("html", "json", F.when(key % 2 == 0, F.col("text")), False),
            attachment(None, "TXT", F.when(key % 7 == 0, F.col("text")), False),
            attachment(None, None, F.col("text"), False),
        ),
        lambda item: item["content"].isNotNull(),
    )
    return documents.select(
        F.concat(F.lit("doc-"), key.cast("string")).alias(KEY),
        F.concat("source", F.lit(" "), F.format_string("%09d", key)).alias("stem"),
        F.col("text"),
        F.when(key % 3 != 0, F.transform(tokens, word)).alias("words"),
        F.when(key % 3 == 0, F.transform(lines, segment)).alias("segments"),
        items.alias("additional_formats"),
        nothing.alias("_corrupt_record"),
    )
