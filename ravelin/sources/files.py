"""File trees and text tables as one ``files`` frame, read once for all packs.

Columns: path, ext (suffix as written), length (bytes), content (text), lossy
(bad bytes were replaced).  ``rel`` is the path relative to the scan root.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.schema import literal_map

# Language by suffix, folders that are never scanned, size cut.
LANGUAGE = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "javascript", ".tsx": "javascript",
    ".go": "go", ".java": "java",
    ".php": "php", ".php5": "php", ".phtml": "php",
    ".rb": "ruby", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".rs": "rust",
    ".c": "cpp", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".h": "cpp",
    ".hpp": "cpp", ".hh": "cpp",
}
SOURCE_SKIP_DIRS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist",
    "build", ".tox", ".mypy_cache", ".pytest_cache", "site-packages", "vendor",
    "target", "third_party",
]
# The usual size cut; nothing applies it unless asked to.
MAX_SOURCE_BYTES = 1_500_000
# Languages of the histogram, by suffix.
HISTOGRAM_LANGUAGE = {
    ".java": "java", ".go": "go", ".rb": "ruby", ".php": "php", ".kt": "kotlin",
    ".kts": "kotlin", ".cs": "csharp", ".scala": "scala", ".py": "python",
    ".js": "javascript", ".ts": "typescript", ".jsx": "javascript",
    ".tsx": "typescript", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".cc": "cpp",
}
HISTOGRAM_SKIP_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv"]


# What one row can hold; a file above it would end the job.
MAX_ROW_BYTES = 2_000_000_000


def list_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, rel, ext, length) of every file below ``root``; no content is read."""
    raw = _binary(spark, root, glob)
    path = F.regexp_replace("path", r"^file:/*", "/")
    return raw.select(path.alias("path"), relative(path, root).alias("rel"), T.extension(path).alias("ext"), "length")


def _binary(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def read_tree(
    spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_ROW_BYTES
) -> DataFrame:
    """Every file below ``root``, one row each.

    ``glob`` and ``max_bytes`` are applied while listing, before content is read.  Files above
    ``max_bytes`` have no row here but one in ``unread``.
    """
    raw = _binary(spark, root, glob).where(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", r"^file:/*", "/")
    return _decoded(raw, path, relative(path, root), F.col("length"), F.col("content"))


def unread(
    spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_ROW_BYTES
) -> DataFrame:
    """(path, engine, reason) of the files below ``root`` that ``read_tree`` leaves out, as
    ``plans.scan.errors`` tells the others."""
    big = list_tree(spark, root, glob).where(F.col("length") > max_bytes)
    return big.select("path", F.lit("all").alias("engine"), F.lit("oversize").alias("reason"))


def from_bytes(df: DataFrame, path: Column, raw: Column) -> DataFrame:
    """Any binary column as files."""
    return _decoded(df, path, path, F.octet_length(raw).cast("bigint"), raw)


def _decoded(df: DataFrame, path: Column, rel: Column, length: Column, raw: Column) -> DataFrame:
    return df.select(
        path.alias("path"),
        rel.alias("rel"),
        T.extension(path).alias("ext"),
        length.alias("length"),
        T.decode(raw).alias("content"),
        (~F.is_valid_utf8(raw.cast("string"))).alias("lossy"),
    )


def relative(path: Column, root: str) -> Column:
    """Path below the root; only the name when it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(
        path.startswith(base), F.substring(path, len(base) + 1, 2**31 - 1)
    ).otherwise(T.basename(path))


def from_table(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """Any text column as files; the suffix comes from the given path."""
    return df.select(
        path.alias("path"),
        path.alias("rel"),
        T.extension(path).alias("ext"),
        F.octet_length(text).cast("bigint").alias("length"),
        text.alias("content"),
        F.lit(False).alias("lossy"),
    )


def language(ext: Column) -> Column:
    return F.try_element_at(literal_map(LANGUAGE), F.lower(ext))


def path_parts(rel: Column) -> Column:
    return F.split(rel, "/")


def in_folder(rel: Column, folders: list) -> Column:
    """Any part of the path, the file name included, is one of the names."""
    return F.arrays_overlap(path_parts(rel), F.array(*[F.lit(d) for d in folders]))


def is_scannable(
    rel: Column, ext: Column, length: Column, max_bytes: int | None = None
) -> Column:
    """Source files outside the skipped folders, up to ``max_bytes`` if that is given."""
    small = F.lit(True) if max_bytes is None else length <= max_bytes
    return language(ext).isNotNull() & small & ~in_folder(rel, SOURCE_SKIP_DIRS)


def without_bad_bytes(content: Column, lossy: Column) -> Column:
    """The text as read with bad bytes dropped instead of replaced."""
    return F.when(lossy, F.translate(content, T.REPLACEMENT, "")).otherwise(content)


def explode_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), numbered from 1."""
    return files.select(
        "path", F.posexplode(T.splitlines(F.col("content"))).alias("i", "line")
    ).select("path", (F.col("i") + 1).alias("line_no"), "line")


def capped_files(files: DataFrame, limit: int) -> DataFrame:
    """The first files in path order, as a scan with a file cap sees them."""
    keep = is_scannable(F.col("rel"), F.col("ext"), F.lit(0))
    return files.where(keep).orderBy("path").limit(limit)


def language_histogram(files: DataFrame) -> DataFrame:
    lang = F.try_element_at(literal_map(HISTOGRAM_LANGUAGE), F.lower("ext"))
    return (
        files.where(~in_folder(F.col("rel"), HISTOGRAM_SKIP_DIRS))
        .select(lang.alias("language"))
        .where(F.col("language").isNotNull())
        .groupBy("language")
        .agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "language")
    )
