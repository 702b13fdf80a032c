"""Token files: flat unsigned integers, 64-bit document offsets, read back through memory maps."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID
from .tokens import encoder_for

MANIFEST = "shard int, file string, n_docs long, n_tokens long, width int"


def _file_system(folder: str):
    """(file system, path) of a shared folder; local paths may be given with or without a scheme."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, vocabulary: int,
    id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False,
) -> DataFrame:
    """Encode every text and write the ids in ascending identifier order.

    Documents are range-partitioned and sorted by identifier (ties by text); partition k becomes shard k of
    three flat little-endian files: ``.ids`` (16-bit unsigned while the vocabulary allows, else
    32-bit), ``.off`` (64-bit unsigned offsets inside the shard, one more than documents) and
    ``.doc`` (64-bit identifiers; the largest value stands for null).  Each attempt writes files of its
    own name and only the names returned count, so a lost executor or a repeated task leaves no trace in
    the result.  ``folder`` must be reachable from all executors.

    Returns the manifest (shard, file, n_docs, n_tokens, width); the files are written when it runs, so
    write it before use.  A null text counts as empty and holds the end id only.  An empty table
    gives an empty manifest; other columns are ignored.  ``added_tokens``: see ``TextEncoder``.
    """
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out = TaskContext.get().partitionId(), None
        ids, sizes = [], [np.zeros(1, "<u8")]
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = encoder_for(tokenizer_path, end_id, added_tokens)
                system, base = _file_system(folder)
                system.create_dir(base, recursive=True)
                name = f"part-{shard:06d}-{uuid.uuid4().hex[:12]}"
                out = system.open_output_stream(f"{base}/{name}.ids")
            lengths = np.zeros(batch.num_rows, "<u8")
            for i, text in enumerate(batch.column(1)):
                data = encoder.document(text.as_py())
                lengths[i] = len(data) // 4
                out.write(data if width == 4 else np.frombuffer(data, "<u4").astype("<u2").tobytes())
            sizes.append(lengths)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.concatenate(sizes), dtype="<u8")
        for end, values in (("off", offsets), ("doc", np.concatenate(ids))):
            with system.open_output_stream(f"{base}/{name}.{end}") as f:
                f.write(values.tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(offsets) - 1], pa.int64()),
             pa.array([int(offsets[-1])], pa.int64()), pa.array([width], pa.int32())],
            names=["shard", "file", "n_docs", "n_tokens", "width"],
        )

    rows = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(encode, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's first position: exclusive prefix sums over the shards (one row
    per shard, never per document)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, batch_docs: int = 4096) -> DataFrame:
    """Read the files named by ``manifest`` (with its ``base``): doc_id, start, n_tokens, ids_crc32.

    One task maps a shard's files into memory and touches only the pages of the documents at hand; on
    stores without memory maps, the ranges are read.  ``start`` is the global position.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        local = system.type_name == "local"

        def opened(name: str, dtype: str):
            if local:
                return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
            return np.frombuffer(system.open_input_file(f"{path}/{name}").read(), dtype)

        for batch in batches:
            for row in batch.to_pylist():
                name, kind = row["file"], f"<u{row['width']}"
                offsets, docs, ids = opened(f"{name}.off", "<u8"), opened(f"{name}.doc", "<i8"), opened(f"{name}.ids", kind)
                for at in range(0, len(docs), batch_docs):
                    some = np.asarray(docs[at : at + batch_docs])
                    cut = np.asarray(offsets[at : at + len(some) + 1]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64(), mask=some == LAST_ID), pa.array(cut[:-1] + row["base"]),
                         pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = manifest.select("shard", "file", "n_docs", "n_tokens", "width", "base")
    # one row a shard: dealt out so that every core reads files
    spread = shards.repartition(max(1, shards.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
