"""Files from directories, archives and tables."""

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import col

MEMBERS = "archive string, path string, content binary, error string"


def read_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """One row per file below a directory: path, size_bytes, created_at, content.

    A test of size_bytes on the result prunes files before their bytes are read.
    """
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"), "content")
    )


def decode_text(content):
    """Text of a file's bytes: UTF-8, else Latin-1."""
    content = col(content)
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def corpus_from_table(df: DataFrame, path, text, language, job_id: str = "job") -> DataFrame:
    """Any table with a key and a text column becomes files."""
    language = F.lit(language) if isinstance(language, str) else language
    return df.select(
        F.lit(job_id).alias("job_id"), col(path).alias("path"), language.alias("language"), col(text).alias("text"))


#: Members leave a task in blocks: an Arrow batch for each member costs more than the member.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 8_000_000


def _opened(batches):
    """Rows (archive, path, content, error) of archives, one member unpacked at a time."""
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"]):
            try:
                packed = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile as problem:
                yield archive, None, None, str(problem)
                continue
            with packed:
                for member in packed.infolist():
                    if not member.is_dir():
                        yield archive, member.filename, packed.read(member), None


def _members(batches):
    import pandas as pd

    columns = ["archive", "path", "content", "error"]
    block, held = [], 0
    for row in _opened(batches):
        block.append(row)
        held += len(row[2] or b"")
        if len(block) >= BLOCK_ROWS or held >= BLOCK_BYTES:
            yield pd.DataFrame(block, columns=columns)
            block, held = [], 0
    if block:
        yield pd.DataFrame(block, columns=columns)


def expand_archives(archives: DataFrame) -> DataFrame:
    """Members of ZIP archives held as (path, content) rows, unsafe names dropped.

    An archive that can't be read gives one row without path and content, with the error.

    Archives are spread one per row over the tasks. Members are unpacked one by one and leave the task in blocks of at most
    1,000, cut at the member that passes 8 MB.
    """
    return safe_paths(archives.select("path", "content").mapInPandas(_members, MEMBERS))


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    return expand_archives(spark.read.format("binaryFile").load(glob))


def safe_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Drop absolute paths and paths with a `..` segment."""
    p = F.coalesce(F.col(path), F.lit(""))
    return df.where(~p.startswith("/") & ~F.array_contains(F.split(p, "/"), ".."))
