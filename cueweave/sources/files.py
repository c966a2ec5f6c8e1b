"""Choosing files, and the names found in their paths.

A path may be a file, a folder (with a glob), or a folder followed by a regular
expression for the file name.
"""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MEDIA_SUFFIXES = (
    ".wav",
    ".mp3",
    ".flac",
    ".m4a",
    ".aac",
    ".ogg",
    ".opus",
    ".mp4",
    ".wma",
    ".webm",
)
MIME_FALLBACKS = (
    (".wav", "audio/wav"),
    (".mp3", "audio/mpeg"),
    (".flac", "audio/flac"),
    (".m4a", "audio/mp4"),
    (".aac", "audio/aac"),
    (".ogg", "audio/ogg"),
    (".opus", "audio/opus"),
    (".mp4", "audio/mp4"),
    (".wma", "audio/x-ms-wma"),
    (".webm", "audio/webm"),
)
OTHER_MIME = "application/octet-stream"
REGEX_CHARACTERS = r"[.^$*+?{}\[\]|()]"


def file_name(path: Column) -> Column:
    """The path's last segment."""
    return F.substring_index(path, "/", -1)


def decoded(name: Column) -> Column:
    """A name as on disk; file metadata gives it URL-encoded."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def suffix(name: Column) -> Column:
    """The last ``.ext`` of a file name, empty for none or for a leading dot only."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    """A file name without its suffix."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


def choose_names(
    listing: DataFrame, name: Column, suffixes: tuple[str, ...], pattern: str | None = None
) -> DataFrame:
    """Rows of a listing whose file name has one of the suffixes and fits a regex."""
    wanted = F.lower(suffix(name)).isin(*suffixes)
    if pattern is not None:
        re.compile(pattern)
        wanted = wanted & name.rlike(pattern)
    return listing.filter(wanted)


def mime_type(name: Column) -> Column:
    """MIME type by suffix: the standard one, else a fallback, else ``octet-stream``.

    The standard table is the driver's, so that all executors agree.
    """
    found = F.lit(OTHER_MIME)
    for ending, fallback in MIME_FALLBACKS:
        mime = mimetypes.guess_type(f"x{ending}")[0] or fallback
        found = F.when(F.lower(suffix(name)) == ending, mime).otherwise(found)
    return found


def media_catalog(listing: DataFrame, path: str = "path", pattern: str | None = None) -> DataFrame:
    """Media files of any listing with a path column, with stem and MIME type."""
    named = listing.withColumn("file_name", file_name(F.col(path)))
    chosen = choose_names(named, F.col("file_name"), MEDIA_SUFFIXES, pattern)
    return chosen.withColumns(
        {"stem": stem(F.col("file_name")), "mime_type": mime_type(F.col("file_name"))}
    )


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Catalog of the media files under a path; contents are never read."""
    folder, _, pattern = resolve(spark, path)
    listing = (
        spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    )
    return not_empty(media_catalog(listing, "path", pattern), "media", path)


def resolve(spark: SparkSession, path: str, glob: str | None = None) -> tuple[str, str | None, str | None]:
    """What to read for a path: (file or folder, glob, name pattern).

    A missing path whose last segment looks like a regular expression means its
    parent folder and that expression.
    """
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(hadoop_path):
        if files.getFileStatus(hadoop_path).isFile():
            return path, None, None
        hidden = files.globStatus(jvm.org.apache.hadoop.fs.Path(hadoop_path, "[._]*.{json,JSON}"))
        if hidden:  # Spark passes such names over in silence
            raise ValueError(f"{path} holds names that Spark does not read, such as {hidden[0].getPath().getName()}")
        return path, glob, None
    parent, _, pattern = path.rpartition("/")
    if not parent or not files.exists(jvm.org.apache.hadoop.fs.Path(parent)):
        raise FileNotFoundError(path)
    if not re.search(REGEX_CHARACTERS, pattern):
        raise FileNotFoundError(path)
    try:
        re.compile(pattern)
    except re.error as problem:
        raise ValueError(f"Invalid regular expression '{pattern}': {problem}") from problem
    return parent, None, pattern


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input stored in fewer splits than there are cores.

    Larger inputs, which have splits enough, pass as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def not_empty(df: DataFrame, what: str, path: str) -> DataFrame:
    """Fail early when a path selects nothing."""
    if df.isEmpty():
        raise FileNotFoundError(f"No {what} files selected by {path}")
    return df
