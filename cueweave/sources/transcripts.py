"""Transcript JSON files, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueweave.operators.ordered import KEY
from cueweave.sources.files import choose_names, decoded, not_empty, resolve, stem
from cueweave.schemas import PAYLOAD

READ_SCHEMA = T.StructType([*PAYLOAD.fields, T.StructField("_corrupt_record", T.StringType())])


def read_transcripts(
    spark: SparkSession, path: str, glob: str = "*.json", keep_raw: bool = False
) -> DataFrame:
    """``transcript_id, stem, text, words, segments, additional_formats, _corrupt_record``.

    ``transcript_id`` is the file's full path.  With ``keep_raw`` the whole document
    also comes as a VARIANT column ``raw``, fields unknown to the schema included.
    """
    folder, wanted, pattern = resolve(spark, path, glob)
    source = spark.read.option("pathGlobFilter", wanted) if wanted else spark.read
    read = parsed(source.text(folder, wholetext=True))
    chosen = not_empty(choose_names(read, F.col("file_name"), (".json",), pattern), "JSON", path)
    return chosen.drop("file_name") if keep_raw else chosen.drop("file_name", "raw")


def parsed(files: DataFrame) -> DataFrame:
    """Transcripts from whole file texts (``value``); the same on a stream.

    A document that cannot be parsed keeps its text in ``_corrupt_record``.  Fields
    that nothing reads are not parsed.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    named = files.select(
        decoded(F.col("_metadata.file_path")).alias(KEY),
        decoded(F.col("_metadata.file_name")).alias("file_name"),
        "value",
        F.from_json("value", READ_SCHEMA, options).alias("_document"),
    )
    unread = F.col("_document").isNull() | (F.trim("value") == "")
    corrupt = F.when(unread, F.col("value")).otherwise(F.col("_document._corrupt_record"))
    return named.select(
        KEY,
        "file_name",
        stem(F.col("file_name")).alias("stem"),
        *[F.col("_document")[f.name].alias(f.name) for f in PAYLOAD.fields],
        corrupt.alias("_corrupt_record"),
        F.try_parse_json("value").alias("raw"),
    )


def readable(transcripts: DataFrame) -> DataFrame:
    """Transcripts that could be parsed."""
    return transcripts.filter(F.col("_corrupt_record").isNull())


def quarantine(transcripts: DataFrame) -> DataFrame:
    """Transcripts set aside, with the reason, so that the others go on."""
    return transcripts.filter(F.col("_corrupt_record").isNotNull()).select(
        KEY, "stem", F.lit("malformed JSON").alias("reason"), F.col("_corrupt_record").alias("content")
    )


def stem_clashes(transcripts: DataFrame) -> DataFrame:
    """Stems shared by several files: their outputs would carry the same name."""
    return (
        transcripts.groupBy("stem")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min(KEY).alias("first_path"), F.max(KEY).alias("last_path"))
        .filter("n_files > 1")
    )


def land_words(words: DataFrame, table: str, buckets: int) -> None:
    """Store words bucketed and sorted by recording.

    Cue and sentence jobs over the stored table need no exchange of words at all, and
    the JSON text is parsed once.  Words are dealt by bucket first, so that a bucket is
    one file.
    """
    (
        words.repartition(buckets, KEY)
        .write.mode("overwrite")
        .bucketBy(buckets, KEY)
        .sortBy(KEY, "idx")
        .format("parquet")
        .saveAsTable(table)
    )
