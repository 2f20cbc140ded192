"""Language detection and result filters."""

from pyspark.sql import DataFrame, functions as F

from ..functions.code import EXTENSIONS, file_ext, looks_like_mongo, looks_like_react
from ..plans.packs.javascript import MANIFESTS


def ext_language(df: DataFrame, extensions: dict[str, str] = EXTENSIONS) -> DataFrame:
    """Add ext and ext_language by a lookup of the extension; the map is a literal."""
    pairs = [F.lit(x) for item in extensions.items() for x in item]
    return df.withColumn("ext", file_ext("path")).withColumn(
        "ext_language", F.element_at(F.create_map(*pairs), F.col("ext")))


def detect_language(files: DataFrame, compat: bool = False) -> DataFrame:
    """Set language and drop files that have none.

    Extensions are tested before the text is looked at. By default manifests are a language of their own and
    `.tsx` is accepted; `compat` drops both.
    """
    known = ext_language(files.drop("language")).where(F.col("ext_language").isNotNull())
    name = F.lower(F.substring_index("path", "/", -1))
    language = (
        F.when(F.col("ext") == ".js",
               F.when(looks_like_react("text", compat), "react").otherwise("javascript"))
        .when(F.col("ext") == ".json", F.when(looks_like_mongo("text"), "mongodb"))
        .otherwise(F.col("ext_language"))
    )
    if compat:
        language = F.when(F.col("ext") != ".tsx", language)
    else:
        language = F.when(name.rlike(MANIFESTS), "manifest").otherwise(language)
    return known.withColumn("language", language).where(F.col("language").isNotNull()).drop("ext", "ext_language")


def filter_results(scores: DataFrame, language: str | None = None, low: int = 0, high: int = 100) -> DataFrame:
    """Scores of one language and score range; the language filter prunes partitions of written scores."""
    out = scores.where(F.col("score").between(low, high))
    return out if language is None else out.where(F.col("language") == language)
