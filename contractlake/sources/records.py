"""Reading and writing contract files and records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.functions.ids import blob_sha1


def read_source_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path: path, content, byte_length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("byte_length"))


def file_manifest(files: DataFrame) -> DataFrame:
    """path, byte_length, sha256, blob_sha1 of files with content."""
    return files.select("path", F.octet_length("content").cast("long").alias("byte_length"), F.sha2("content", 256).alias("sha256"), blob_sha1(F.col("content")).alias("blob_sha1"))


def file_digests(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The manifest of files (path) without their content in a row: each is read block by block, so that a task holds one block and files may be over 2 GB.

    A digest follows from a file's first byte to its last, so a file is always one task's work; different files are different tasks'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, n in zip(batch.column("path").to_pylist(), batch.column("byte_length").to_pylist(), strict=True):
                scheme, rest = path.split(":", 1)
                # Spark writes paths without escapes
                fs, at = pyarrow.fs.FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest, safe='/:@')}")
                sha256, sha1, size = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % n), 0
                with fs.open_input_stream(at) as f:
                    while part := f.read(block):
                        sha256.update(part)
                        sha1.update(part)
                        size += len(part)
                if size != n:
                    raise OSError(f"{path} had {n} bytes when it was listed and {size} when it was read")
                rows.append({"path": path, "byte_length": size, "sha256": sha256.hexdigest(), "blob_sha1": sha1.hexdigest()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("byte_length", pa.int64()), ("sha256", pa.string()), ("blob_sha1", pa.string())]))

    return files.select("path", "byte_length").mapInArrow(run, "path string, byte_length long, sha256 string, blob_sha1 string")


def parse_records(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON lines to columns `record` (of the schema), code: null, MALFORMED_JSON, or ROOT_NOT_OBJECT. Blank lines give no row."""
    t = F.trim(text)
    value = F.try_parse_json(t)
    rows = lines.filter(t != "").withColumn("code", F.when(value.isNull(), F.lit("MALFORMED_JSON")).when(~t.startswith("{"), F.lit("ROOT_NOT_OBJECT")))
    return rows.withColumn("record", F.when(F.col("code").isNull(), F.from_json(t, schema)))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines, as parse_records."""
    return parse_records(spark.read.text(path), "value", schema)


def flatten_report(entities: DataFrame, edges: DataFrame, diagnostics: DataFrame, metadata: DataFrame) -> DataFrame:
    """One long table: record_type, entity_category, id, value (JSON). Each input has id and value; entities a category too."""
    kinds = {"edge": edges, "diagnostic": diagnostics, "report_metadata": metadata}
    rows = [entities.select(F.lit("entity").alias("record_type"), F.col("category").alias("entity_category"), "id", "value")]
    rows += [df.select(F.lit(k).alias("record_type"), F.lit(None).cast("string").alias("entity_category"), "id", "value") for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


def write_split(rows: DataFrame, path: str, by: str = "entity_category") -> DataFrame:
    """Write JSON lines, a folder for each category; returns the index: category and number of rows, read from what was written."""
    rows.write.mode("overwrite").partitionBy(by).json(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.sparkSession.read.schema(schema).json(path).groupBy(by).agg(F.count("*").alias("n"))
