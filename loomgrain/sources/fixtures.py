"""The driver's tables seen as files, manifests, chunks, sessions and watch events, in Spark and as SQL text.

Each view uses every row of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES = """SELECT source AS "workspaceId", concat('/corpus/', source, '/', lang, '/doc_', cast(doc_id AS VARCHAR), '.txt') AS file_path,
  text AS content, cast(1704067200000 + doc_id * 3600000 AS DOUBLE) AS mtime, cast(strlen(text) AS BIGINT) AS size, doc_id FROM documents"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file a document."""
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("workspaceId"), path.alias("file_path"), F.col("text").alias("content"),
        (F.lit(1704067200000) + F.col("doc_id") * 3600000).cast("double").alias("mtime"), F.octet_length("text").cast("long").alias("size"), "doc_id",
    )


MANIFEST = """SELECT source AS workspace_id, concat('/corpus/', source, '/', lang, '/doc_', cast(doc_id AS VARCHAR), '.txt') AS file_path,
  cast(1704067200000 + doc_id * 3600000 - CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS DOUBLE) AS mtime, 1 AS chunk_count,
  CASE WHEN doc_id % 5 = 2 THEN 'old-model' ELSE 'm' END AS model FROM documents WHERE doc_id % 5 <> 0
  UNION ALL SELECT source, concat('/corpus/', source, '/gone/doc_', cast(doc_id AS VARCHAR), '.txt'), cast(1704067200000 AS DOUBLE), 1, 'm' FROM documents WHERE doc_id % 50 = 0"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier index run left: a fifth of the files is new, a fifth has changed, a fifth has another model; some entries are stale."""
    own = files(spark, sf_dir)
    n = F.col("doc_id") % 5
    known = own.where(n != 0).select(
        F.col("workspaceId").alias("workspace_id"), "file_path", (F.col("mtime") - F.when(n == 1, 1).otherwise(0)).alias("mtime"),
        F.lit(1).alias("chunk_count"), F.when(n == 2, "old-model").otherwise("m").alias("model"),
    )
    gone = own.where(F.col("doc_id") % 50 == 0).select(
        F.col("workspaceId").alias("workspace_id"), F.concat(F.lit("/corpus/"), "workspaceId", F.lit("/gone/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.lit(1704067200000.0).alias("mtime"), F.lit(1).alias("chunk_count"), F.lit("m").alias("model"),
    )
    return known.unionByName(gone)


PATHS = """SELECT doc_id, source AS "workspaceId", concat(source, '/', lang, '/', CASE doc_id % 8 WHEN 0 THEN 'Main_' WHEN 1 THEN 'node_modules/m_' WHEN 2 THEN '.hidden/h_'
  WHEN 3 THEN 'lib_' WHEN 4 THEN 'Makefile_' WHEN 5 THEN 'docs/D_' WHEN 6 THEN 'docs/d_' ELSE 'build/b_' END, cast(doc_id AS VARCHAR),
  CASE doc_id % 8 WHEN 0 THEN '.PY' WHEN 1 THEN '.js' WHEN 3 THEN '.min.js' WHEN 4 THEN '' WHEN 6 THEN '.docx' ELSE '.md' END) AS file_path,
  text AS content, cast(1704067200000 + doc_id * 3600000 AS DOUBLE) AS mtime, cast(strlen(text) AS BIGINT) AS size FROM documents"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a path of one of eight shapes: wanted, hidden, ignored and of foreign types."""
    n = (F.col("doc_id") % 8).cast("int")
    front = F.element_at(F.array(*map(F.lit, ("Main_", "node_modules/m_", ".hidden/h_", "lib_", "Makefile_", "docs/D_", "docs/d_", "build/b_"))), n + 1)
    back = F.element_at(F.array(*map(F.lit, (".PY", ".js", ".md", ".min.js", "", ".md", ".docx", ".md"))), n + 1)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), front, F.col("doc_id").cast("string"), back)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("workspaceId"), path.alias("file_path"), F.col("text").alias("content"),
        (F.lit(1704067200000) + F.col("doc_id") * 3600000).cast("double").alias("mtime"), F.octet_length("text").cast("long").alias("size"),
    )


CHUNKS = """SELECT d.doc_id AS id, d.text AS document, concat('/corpus/', d.source, '/', d.lang, '/doc_', cast(d.doc_id AS VARCHAR), '.txt') AS "filePath",
  d.source AS "workspaceId", e.embedding AS vector, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with the vector of the same number, if there is one."""
    own = files(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("content").alias("document"), F.col("file_path").alias("filePath"), "workspaceId")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return own.join(vectors, "id", "left")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document) of ``chunks``, without the shuffle of all texts that their vectors take: only a number that several vectors have repeats a text."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    several = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("times")).where("times > 1")
    if several.isEmpty():
        return own
    times = F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))
    return own.join(several, "id", "left").select("id", "document", F.explode(times)).select("id", "document")


LINES = """SELECT *, concat(cast(doc_id AS VARCHAR), ':', cast("chunkIndex" AS VARCHAR)) AS id FROM (SELECT source AS "workspaceId", doc_id, cast(doc_id AS VARCHAR) AS "filePath",
  cast(i - 1 AS INTEGER) AS "chunkIndex", p[i] AS document, regexp_extract(p[i], '[A-Za-z]{5,}') AS name,
  CASE lang WHEN 'en' THEN 'function_item' WHEN 'fr' THEN 'method_definition' ELSE 'class_definition' END AS kind
  FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents) t, range(1, len(p) + 1) r(i))"""


def named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks of their document, named by their first run of five letters."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("workspaceId"), "doc_id", F.col("doc_id").cast("string").alias("filePath"), "lang", F.posexplode(F.split("text", "\n")).alias("chunkIndex", "document"))
    kind = F.when(F.col("lang") == "en", "function_item").when(F.col("lang") == "fr", "method_definition").otherwise("class_definition")
    return rows.select(
        "workspaceId", "doc_id", "filePath", "chunkIndex", "document", F.regexp_extract("document", "[A-Za-z]{5,}", 0).alias("name"), kind.alias("kind"),
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("chunkIndex").cast("string")).alias("id"),
    )


SESSIONS = """SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN concat('Chat ', cast(conv_id AS VARCHAR)) ELSE 'New Chat' END AS title,
  cast(max(turn) * 1000 + conv_id AS BIGINT) AS "updatedAt" FROM conversations GROUP BY conv_id"""
MESSAGES = """SELECT conv_id AS session_id, turn AS idx, role, text AS content,
  CASE WHEN role = 'assistant' THEN [concat('/a/f', cast(turn % 4 AS VARCHAR), '.md'), concat('b\\g', cast(conv_id % 3 AS VARCHAR), '.py')] ELSE CAST([] AS VARCHAR[]) END AS citations FROM conversations"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("last"))
    title = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Chat "), F.col("id").cast("string"))).otherwise("New Chat")
    return rows.select("id", title.alias("title"), (F.col("last") * 1000 + F.col("id")).cast("long").alias("updatedAt"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.array(F.concat(F.lit("/a/f"), (F.col("turn") % 4).cast("string"), F.lit(".md")), F.concat(F.lit("b\\g"), (F.col("conv_id") % 3).cast("string"), F.lit(".py")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", cited).otherwise(F.array().cast("array<string>")).alias("citations"),
    )


CHANGES = """SELECT concat('user_', cast(user_id AS VARCHAR), '/', event_type, '_', cast(event_id AS VARCHAR), '.json') AS file_path,
  epoch_us(ts) / 1000.0 AS mtime, props AS content, cast(strlen(props) AS BIGINT) AS size, ts, cast(user_id AS VARCHAR) AS "workspaceId" FROM events"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes."""
    path = F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("_"), F.col("event_id").cast("string"), F.lit(".json"))
    return table(spark, sf_dir, "events").select(
        path.alias("file_path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("mtime"), F.col("props").alias("content"),
        F.octet_length("props").cast("long").alias("size"), "ts", F.col("user_id").cast("string").alias("workspaceId"),
    )
