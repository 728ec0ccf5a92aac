"""The given tables as units, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_guard.sources.tables import units_from_table
from queries.planted import CODE_BLOCKS, PYTHON_LINES, SCRIPT_LINES, planted

# Directories and endings that give table rows a file-like path.
DIRECTORIES = [
    "src",
    "node_modules/lib",
    ".git/x",
    "pkg/build",
    "app/venv",
    "docs/tests",
    "a/__pycache__",
    "env.d/b",
    "dist",
    "my.egg-info",
    "docs/guide",
]
ENDINGS = [".py", ".TS", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", "", ".min.js", ".lock"]
ENDINGS += [".pyc", ".Py"]

PYTHON_TEXT = planted("text", "doc_id", PYTHON_LINES)
SCRIPT_TEXT = planted("html", "page_id", SCRIPT_LINES)
BLOCK_TEXT = planted("text", "doc_id", CODE_BLOCKS)
CHAT_TEXT = planted("text", "(conv_id * 7 + turn)", PYTHON_LINES)


def _pick(number: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


FILE_PATH = (
    f"concat({_pick('doc_id', DIRECTORIES)}, '/', source, '/f', doc_id, "
    f"{_pick('doc_id', ENDINGS)})"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return units_from_table(documents, "doc_id", "text", "source")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    # the rules on personal data leave out paths that look like examples
    pages = pages.withColumn("url", F.replace("url", F.lit("example"), F.lit("site")))
    return units_from_table(pages, "page_id", "html", "url", "typescript")


def python_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = documents.selectExpr("doc_id", "source", f"{PYTHON_TEXT} AS text")
    return units_from_table(rows, "doc_id", "text", "source")


def block_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = documents.selectExpr("doc_id", "source", f"{BLOCK_TEXT} AS text")
    return units_from_table(rows, "doc_id", "text", "source")


def script_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = pages.selectExpr("page_id", "url", f"{SCRIPT_TEXT} AS text")
    return units_from_table(rows, "page_id", "text", "url", "typescript")


def chat_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = turns.selectExpr("conv_id", "turn", "role", f"{CHAT_TEXT} AS text")
    return units_from_table(rows, ["conv_id", "turn"], "text", "role")


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, size_bytes): documents under file-like paths."""
    documents = table(spark, sf_dir, "documents")
    return documents.selectExpr(
        "doc_id", f"{FILE_PATH} AS path", "octet_length(text) AS size_bytes"
    )


# The same units for DuckDB, as the body of a common table expression.
RAW_DOCUMENTS = "SELECT doc_id::VARCHAR unit_id, source path, 'python' AS language, text FROM documents"
RAW_PAGES = (
    "SELECT page_id::VARCHAR unit_id, replace(url, 'example', 'site') path, "
    "'typescript' AS language, html AS text FROM pages"
)
PYTHON_UNITS = (
    f"SELECT doc_id::VARCHAR unit_id, source path, 'python' AS language, {PYTHON_TEXT} AS text "
    "FROM documents"
)
BLOCK_UNITS = (
    f"SELECT doc_id::VARCHAR unit_id, source path, 'python' AS language, {BLOCK_TEXT} AS text "
    "FROM documents"
)
SCRIPT_UNITS = (
    f"SELECT page_id::VARCHAR unit_id, url path, 'typescript' AS language, {SCRIPT_TEXT} AS text "
    "FROM pages"
)
CHAT_UNITS = (
    "SELECT conv_id || ':' || turn AS unit_id, role path, 'python' AS language, "
    f"{CHAT_TEXT} AS text FROM conversations"
)
FILE_PATHS = (
    f"SELECT doc_id, {FILE_PATH} AS path, strlen(text)::INTEGER AS size_bytes FROM documents"
)
