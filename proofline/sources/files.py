"""Files in and out: folders of media, texts, archives, append logs, partitions and blobs."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions.text import normalise_text

IMAGES = ["jpg", "jpeg", "png", "webp", "gif", "bmp"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; a folder is made for local runs where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that later steps neither compute it again nor hang on one executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as scratch_table, in buckets of key, by which it is dealt: Spark knows that rows of a key are in one task, and does not shuffle them again."""
    path = shared_path(df.sparkSession, name)
    table = f"proofline_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def scan_media_folder(spark: SparkSession, root: str, suffixes: list[str] = IMAGES, sidecars: list[str] = ("json", "txt")) -> DataFrame:
    """(path, suffix, size, accepted) of the files below root without sidecars, in an order that does not hang on case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).filter(~F.col("suffix").isin(*sidecars))
    return files.select("path", "suffix", "size", F.col("suffix").isin(*suffixes).alias("accepted")).orderBy(F.lower("path"), "path")


def read_text_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(path, text, latin): UTF-8, else Latin-1 (latin tells which); newlines and blanks are made normal.

    With a separator, a character that is no blank, a file holds many documents, one behind the other, each with a row.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = raw.select("path", "content", F.try_validate_utf8(F.col("content").cast("string")).alias("_utf8"))
    read = told.select("path", F.coalesce("_utf8", F.decode("content", "ISO-8859-1")).alias("text"), F.col("_utf8").isNull().alias("latin"))
    if separator is not None:
        read = read.select("path", F.explode(F.split("text", re.escape(separator))).alias("text"), "latin")
    return read.select("path", normalise_text(F.col("text")).alias("text"), "latin")


def expand_archives(files: DataFrame) -> DataFrame:
    """(path, entry, content, error): the image entries of zip archives (path, content); an archive that does not open is an error row."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for name in archive.namelist():
                            if name.startswith("__MACOSX") or name.rpartition(".")[2].lower() not in IMAGES:
                                continue
                            try:
                                out.append((path, name, archive.read(name), None))
                            except (zipfile.BadZipFile, RuntimeError):
                                continue
                except zipfile.BadZipFile:
                    out.append((path, None, None, "BAD_ARCHIVE"))
            yield pd.DataFrame(out, columns=["path", "entry", "content", "error"])

    return files.select("path", "content").mapInPandas(expand, "path string, entry string, content binary, error string")


def read_checkpoint_log(spark: SparkSession, path: str, schema: str, scope: dict[str, str], keys: list[str], order: str) -> DataFrame:
    """The last record of each key of a JSON-lines log with the wanted scope; malformed lines are dropped."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for column, value in scope.items():
        log = log.filter(F.col(column) == value)
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.expr(order)).alias("_r")).select(*keys, "_r.*")


def read_job_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(status, error, schema...) of the JSON state lines below path; a malformed one is a FAILED row with a code."""
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = spark.read.text(path).select("value", parsed.alias("_s")).withColumn("_bad", F.col("_s").isNull() | F.col("_s._corrupt").isNotNull())
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    status, error = F.when(F.col("_bad"), "FAILED").otherwise("READY"), F.when(F.col("_bad"), "MALFORMED_STATE")
    return read.select("value", status.alias("status"), error.alias("error"), *[F.when(~F.col("_bad"), F.col(f"_s.{n}")).alias(n) for n in names])


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def append_audit(df: DataFrame, path: str, actor: str, action: str, entity: str, detail: list[str], secret: list[str]) -> None:
    """(actor, action, entity, detail as JSON) rows, without the secret columns."""
    kept = [c for c in detail if c not in secret]
    df.select(F.col(actor).alias("actor"), F.lit(action).alias("action"), F.col(entity).cast("string").alias("entity"), F.to_json(F.struct(*kept)).alias("detail")).write.mode("append").json(path)


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Writes df partitioned by key; the partitions that df has are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def snapshot_run(findings: DataFrame, path: str, run: int) -> None:
    """Adds the findings of one run to the history in path; a run that is told again replaces its own snapshot."""
    replace_partition(findings.withColumn("run", F.lit(run)), path, "run")


def put_content_addressed(df: DataFrame, path: str, content: str, suffix: str, prefix: str = "") -> DataFrame:
    """Appends the blobs whose key is not in the store yet, once each, and returns df with key: prefix, 16 digits of sha256, suffix."""
    spark = df.sparkSession
    keyed = df.withColumn("key", F.concat(F.lit(prefix), F.substring(F.sha2(F.col(content).cast("binary"), 256), 1, 16), F.lit(suffix)))
    fresh = keyed.select("key", F.col(content).alias("content")).dropDuplicates(["key"])
    try:
        fresh = fresh.join(spark.read.parquet(path).select("key"), "key", "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    fresh.write.mode("append").parquet(path)
    return keyed.drop(content)
