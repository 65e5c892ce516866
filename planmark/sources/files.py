"""Corpus folders as tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Files above this many bytes are read in blocks; smaller ones travel as one row.
ROW_BYTES = 64 << 20
_BLOCK = 4 << 20


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[5:].lstrip("/"))
    found, inner = fs.FileSystem.from_uri(path)
    return found.open_input_stream(inner)


def _in_blocks(head: int):
    """Start and digest of every file of a batch, holding one block at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                digest, start = hashlib.sha256(), b""
                with _open(path) as stream:
                    while block := stream.read(_BLOCK):
                        start = start or block[:head]
                        digest.update(block)
                yield pd.DataFrame({"path": [path], "start": [start], "digest": [digest.hexdigest()]})

    return read


def file_manifest(
    spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True,
    max_size_mb: float = 100.0, header: str | None = "%PDF-", row_bytes: int = ROW_BYTES,
) -> DataFrame:
    """Path, size, header check, size verdict and content digest of every file.

    Sizes come from the listing. Files of up to ``row_bytes`` are read by Spark's binary source,
    which the filter on ``length`` keeps from opening the others; those are hashed in blocks, one
    file a task, so a file of any size is checked. Large files must lie where pyarrow can read.
    Spark's listing leaves out files without a byte.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    head = len(header.encode()) if header else 0
    facts = ("path", F.col("modificationTime").alias("modified"), "length")
    small = listed.where(F.col("length") <= row_bytes).select(
        *facts, F.substring("content", 1, head).alias("start"), F.sha2("content", 256).alias("digest")
    )
    sizes = listed.where(F.col("length") > row_bytes).select(*facts)
    read = sizes.select("path").repartition("path").mapInPandas(_in_blocks(head), "path string, start binary, digest string")
    files = small.unionByName(sizes.join(read, "path"))
    size_mb = F.col("length") / 1048576
    return files.select(
        "path", "modified", "length",
        size_mb.alias("size_mb"),
        (F.lit(True) if header is None else F.col("start") == F.lit(header.encode())).alias("header_ok"),
        (size_mb <= max_size_mb).alias("size_ok"),
        "digest",
    )


def pending_files(manifest: DataFrame, processed: DataFrame, key: str = "source_file") -> DataFrame:
    """Files of the manifest that are not done yet."""
    return manifest.join(processed.select(key).distinct(), key, "left_anti")
