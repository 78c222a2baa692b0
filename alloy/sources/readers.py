"""Bronze sources: Parquet tables, multi-source specs and document folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


@dataclass(frozen=True)
class TableId:
    """3-part table identity, compared case-insensitively (``DB.SCHEMA.TABLE``)."""

    database: str
    schema: str
    table: str

    @classmethod
    def parse(cls, text: str, default_db: str = "", default_schema: str = "") -> TableId:
        parts = [p.strip() for p in text.split(".")]
        if len(parts) == 1:
            return cls(default_db, default_schema, parts[0])
        if len(parts) == 2:
            return cls(default_db, parts[0], parts[1])
        return cls(parts[0], parts[1], parts[2])

    def key(self) -> tuple[str, str, str]:
        return (self.database.upper(), self.schema.upper(), self.table.upper())

    def path(self, root: str) -> str:
        segs = [s for s in (self.database, self.schema) if s]
        return "/".join([root.rstrip("/"), *segs, f"{self.table}.parquet"])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def parse_spec(spec: str) -> list[str]:
    """``'A'``, ``'DB.S'`` or ``'A.S1,B.S2'`` -> list of entries, blanks dropped."""
    return [s.strip() for s in spec.split(",") if s.strip()]


def list_tables(spark: SparkSession, root: str, entry: str) -> list[str]:
    """The tables an entry stands for: itself if it is one, else those of the schema."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm_path(TableId.parse(entry).path(root))):
        return [entry]
    folder = jvm_path("/".join([root.rstrip("/"), *(p.strip() for p in entry.split("."))]))
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
    return [f"{entry}.{n.removesuffix('.parquet')}" for n in names if n.endswith(".parquet")]


def read_sources(spark: SparkSession, root: str, spec: str,
                 source_col: str = "source_table") -> tuple[DataFrame | None, list[str]]:
    """Read every listed source, tag rows with their table, skip unreachable ones.

    An entry names a table or a schema, of which every table is read. Returns ``(union,
    skipped)``; the union aligns columns by name and fills columns a source lacks with NULL.
    """
    frames, skipped = [], []
    for entry in parse_spec(spec):
        tables = list_tables(spark, root, entry)
        if not tables:
            skipped.append(entry)
        for name in tables:
            try:
                df = spark.read.parquet(TableId.parse(name).path(root))
            except AnalysisException:
                skipped.append(name)
                continue
            frames.append(df.select(F.lit(name).alias(source_col), "*"))
    if not frames:
        return None, skipped
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out, skipped


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder as rows ``(doc_name, doc_type, text)`` (one row per file)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("_path"), F.col("value").alias("text"))
    name = F.regexp_extract("_path", r"([^/]+)$", 1)
    return raw.select(
        name.alias("doc_name"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("doc_type"),
        "text")
