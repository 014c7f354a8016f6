"""Token ids of documents as flat binary files with 64-bit document offsets, written and read by Spark's tasks.

A folder holds, for each range of the documents' order, one shard of two files:

- ``<name>.bin``: the ids of its documents one after the other, little-endian unsigned integers of 2 bytes where the
  vocabulary allows it, else of 4;
- ``<name>.idx``: a header of 40 bytes (the mark ``TOKENIDX``, then as little-endian 64-bit numbers: version, bytes an id, documents,
  first id's place), then documents + 1 offsets (64 bits, counted in ids from the start of the whole corpus), then the
  documents' ids (signed 64 bits) and one byte each that tells a null.

and ``manifest``, a Parquet table (shard, name, base, n_docs, n_tokens, width) that names the shards in order. The bases are
prefix sums of the shards' sizes. Files are written under names of their own by every attempt of a task, and the manifest names those
of the attempts that Spark took, so a lost executor or a task that runs twice leaves at most a file that nothing names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .packing import encoded

END_ID = 2
SHARD_BYTES = 32 << 20  # of texts in a shard, about
STEP = 1 << 20  # ids looked at in one go
HEAD = 40
_MARK, _VERSION = b"TOKENIDX", 1
_ROW = "shard int, name string, n_docs long, n_tokens long, width int"


def _store(folder: str):
    """(file system, path) of a folder by URI or local path."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


@contextmanager
def mapped(folder: str, name: str, dtype: str, offset: int = 0) -> Iterator[np.ndarray]:
    """The numbers of a file: mapped into memory where the folder is a mounted one, else read."""
    from pyarrow.fs import LocalFileSystem

    fs, path = _store(folder)
    if isinstance(fs, LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as f:
            yield np.frombuffer(f.read_buffer(), np.uint8)[offset:].view(dtype)
    else:
        with fs.open_input_file(f"{path}/{name}") as f:
            yield np.frombuffer(f.read_buffer(), np.uint8)[offset:].view(dtype)


def _write_index(fs, path: str, width: int, base: int, ends: np.ndarray, docs: np.ndarray, nulls: np.ndarray) -> None:
    with fs.open_output_stream(path) as f:
        f.write(_MARK + np.array([_VERSION, width, len(docs), base], "<u8").tobytes())
        for part in (ends.astype("<u8"), docs.astype("<i8"), nulls.astype(np.uint8)):
            f.write(part.tobytes())


def read_index(folder: str, name: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes an id, offsets, doc_ids, nulls) of a shard."""
    with mapped(folder, name + ".idx", "u1") as raw:
        if raw[:8].tobytes() != _MARK or raw[8:16].view("<u8")[0] != _VERSION:
            raise ValueError(f"{name}.idx is no index of version {_VERSION}")
        width, n = raw[16:32].view("<u8").tolist()
        body = raw[HEAD:]
        if len(body) != 17 * n + 8:
            raise ValueError(f"{name}.idx is cut off")
        offsets, docs = body[: 8 * n + 8].view("<u8"), body[8 * n + 8 : 16 * n + 8].view("<i8")
        return width, offsets.copy(), docs.copy(), body[16 * n + 8 :].astype(bool)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of each whole text, null as empty, and ``end_id`` behind them, in ascending order of doc_id (null first).

    Returns the manifest as a DataFrame. ``folder`` is new, and all executors reach it: a mounted path or a URI that
    pyarrow opens. Rows of one doc_id are all written, in the order of a hash of their texts, so none is too many for a
    shard; other columns are ignored; an empty table gives no shard with documents.

    Scale: texts are moved once, to their range of the order; a task writes its shard as it encodes and keeps eight bytes a document. Only
    a row a shard is summed up.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-size // shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 4
        fs, path = _store(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        fs.create_dir(path, recursive=True)
        counts, ids, nulls = [np.zeros(1, np.int64)], [], []
        with fs.open_output_stream(f"{path}/{name}.bin") as f:
            for doc, total, flat in encoded(batches, tokenizer, end_id):
                f.write(flat.astype(f"<u{width}").tobytes())
                counts.append(total)
                ids.append(doc.fill_null(0).to_numpy())
                nulls.append(doc.is_null().to_numpy(zero_copy_only=False))
        ends = np.cumsum(np.concatenate(counts))
        own = np.concatenate([np.zeros(0, np.int64), *ids])
        # places count from the shard's own start here, and from the corpus's once all sizes are known
        _write_index(fs, f"{path}/{name}.part", width, 0, ends, own, np.concatenate([np.zeros(0, bool), *nulls]))
        columns = [[shard], [name], [len(own)], [int(ends[-1])], [width]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["shard", "name", "n_docs", "n_tokens", "width"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with mapped(folder, row["name"] + ".part", "u1") as raw:
                    n, body = row["n_docs"], raw[HEAD:]
                    ends = body[: 8 * n + 8].view("<u8") + np.uint64(row["base"])
                    _write_index(fs, f"{path}/{row['name']}.idx", row["width"], row["base"], ends, body[8 * n + 8 : 16 * n + 8].view("<i8"), body[16 * n + 8 :])
            yield batch

    small_batches(spark)
    tie = F.xxhash64("text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = read.repartitionByRange(shards, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    done = materialize(ordered.select("doc_id", "text").mapInArrow(write, _ROW))
    # one row a shard: their prefix sums are small, however large the shards
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = done.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = bases.select("shard", "name", "base", "n_docs", "n_tokens", "width").repartition(shards)
    placed.mapInArrow(place, placed.schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(placed.schema).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``folder``, from the files alone.

    start counts all ids in front of the document; ids_crc32 is that of its ids as little-endian unsigned 32-bit numbers, the
    end mark included. A shard is mapped into memory by one task and gone through in bounded steps, so that even one
    very long document is never held whole. A manifest without documents gives no rows.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").where("n_docs > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width, offsets, docs, nulls = read_index(folder, row["name"])
                if (len(docs), int(offsets[0]), int(offsets[-1])) != (row["n_docs"], row["base"], row["base"] + row["n_tokens"]):
                    raise ValueError(f"{row['name']}.idx does not fit the manifest")
                with mapped(folder, row["name"] + ".bin", f"<u{width}") as ids:
                    if len(ids) != row["n_tokens"]:
                        raise ValueError(f"{row['name']}.bin is cut off")
                    crc, own = np.zeros(len(docs), np.int64), (offsets - offsets[0]).astype(np.int64)
                    for at in range(0, len(docs), 65_536):  # documents in groups of bounded steps
                        crc[at : at + 65_536] = _checksums(ids, own[at : at + 65_537])
                for at in range(0, len(docs), 65_536):
                    cut = slice(at, at + 65_536)
                    starts = offsets[:-1][cut].astype(np.int64)
                    yield pa.record_batch([pa.array(docs[cut], mask=nulls[cut]), pa.array(starts), pa.array(np.diff(own)[cut]), pa.array(crc[cut])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    cores = spark.sparkContext.defaultParallelism
    return manifest.repartition(max(cores, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checksums(ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """CRC-32 of the documents between ``ends``, widened to 32 bits a step of ids at a time."""
    found, at = [], 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, side="right")) - 1)
        if to == at + 1:
            crc = 0
            for i in range(int(ends[at]), int(ends[to]), STEP):
                crc = zlib.crc32(ids[i : min(i + STEP, int(ends[to]))].astype("<u4"), crc)
            found.append(crc)
        else:
            wide = memoryview(ids[ends[at] : ends[to]].astype("<u4")).cast("B")
            places = ((ends[at : to + 1] - ends[at]) * 4).tolist()
            found += [zlib.crc32(wide[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
        at = to
    return found
