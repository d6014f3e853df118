"""Token ids as Arrow files of equal-length sequences and masks.

Each file is an Arrow IPC file whose record batches have two fixed-size-list columns: `ids` (unsigned 16 or 32 bits) and
`mask` (bool, false in the padding of the file's last sequence). Buffers are neither compressed nor copied: with a
memory map, sequence i is a slice of batch i // rows_per_batch. Documents follow each other in ascending order of id; a
second file beside it (`.docs`) lists doc_id, first id within the file and number of ids.

A task writes under a name of its own attempt and returns a manifest row; only manifest rows of tasks that Spark
committed are read, so lost executors and repeated tasks leave at most unread files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_root, slices, stage
from .tokens import encoder

MANIFEST = "part long, seq int, path string, docs long, ids long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 1, length: int = 2048,
    rows_per_batch: int = 256, file_ids: int = 1 << 24, id_bits: int = 16,
) -> DataFrame:
    """Encode every whole text, append end_id, and write the files; returns the staged manifest with `start` per file.

    Null text is empty (end_id alone); rows of equal doc_id are ordered by text, null ids come first. folder: a URI that
    all executors reach, by default below spark.checkpoint.dir. A partition starts a new file after file_ids ids.
    id_bits 16 fits vocabularies up to 65,536 ids; encoding a larger id raises.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_root(spark)}/pixelweft/tokens-{uuid.uuid4().hex}").rstrip("/")
    kind = np.dtype(f"<u{id_bits // 8}")

    def write(batches):
        import pyarrow as pa
        from pyarrow import ipc

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, top = _filesystem(folder)
        store.create_dir(top, recursive=True)
        ids_of, end = encoder(vocabulary).many, np.array([end_id], "<u4").tobytes()
        id_type = pa.uint16() if id_bits == 16 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        block = length * rows_per_batch

        class File:
            def __init__(self, seq):
                self.seq, self.path = seq, f"{top}/part-{part:05d}-{seq:04d}-{attempt}.arrow"
                self.stream = store.open_output_stream(self.path)
                self.out = ipc.new_file(self.stream, schema)
                self.held, self.n, self.ids, self.doc, self.count = [], 0, 0, [], []

            def add(self, doc, ids):
                self.doc.append(doc)
                self.count.append(len(ids))
                self.held.append(ids)
                self.n += len(ids)
                self.ids += len(ids)
                if self.n >= block:
                    self.flush(self.n // block * block)

            def flush(self, n):
                flat = np.concatenate(self.held) if self.held else np.zeros(0, kind)
                now, self.held = flat[:n], [flat[n:]]
                self.n = len(flat) - n
                rows = -(-len(now) // length)
                padded = np.zeros(rows * length, kind)
                padded[: len(now)] = now
                mask = np.arange(rows * length) < len(now)
                for a in range(0, rows, rows_per_batch):
                    b = slice(a * length, (a + rows_per_batch) * length)
                    self.out.write_batch(pa.record_batch([
                        pa.FixedSizeListArray.from_arrays(pa.array(padded[b], id_type), length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask[b]), length)], schema=schema))

            def close(self):
                self.flush(self.n)
                self.out.close()
                self.stream.close()
                count = np.array(self.count, np.int64)
                table = pa.table({"doc_id": pa.array(self.doc, pa.int64()), "start": np.cumsum(count) - count, "n_tokens": count})
                with store.open_output_stream(self.path + ".docs") as stream, ipc.new_file(stream, table.schema) as out:
                    out.write_table(table)
                return part, self.seq, self.path, len(self.doc), self.ids

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                found, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "path", "docs", "ids"])

        now = None
        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()])):
                if now is None or now.ids >= file_ids:
                    if now is not None:
                        yield rows(now.close())
                    now = File(0 if now is None else now.seq + 1)
                ids = np.frombuffer(ids + end, "<u4")
                if id_bits == 16 and len(ids) and ids.max() > 65535:
                    raise ValueError("id_bits=16 is too few for this vocabulary")
                now.add(doc, ids.astype(kind))
        if now is not None:
            yield rows(now.close())

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(ordered.mapInArrow(write, MANIFEST), "manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("folder", F.lit(folder)).withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def open_sequences(uri: str):
    """(ids, mask) Arrow chunked columns of one file; memory-mapped, hence zero-copy, where the store is local."""
    import pyarrow as pa
    from pyarrow import fs, ipc

    store, path = _filesystem(uri)
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    table = ipc.open_file(source).read_all()
    return table.column("ids"), table.column("mask")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs, ipc

        for batch in batches:
            for path, folder, base in zip(*(batch.column(k).to_pylist() for k in ("path", "folder", "start"))):
                store, _ = _filesystem(folder)
                local = isinstance(store, fs.LocalFileSystem)
                book = ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
                docs = ipc.open_file(store.open_input_file(path + ".docs")).read_all()
                starts, counts = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                width = book.schema.field("ids").type.list_size
                block = (book.get_batch(0).num_rows if book.num_record_batches else 1) * width

                def span(a, n):
                    parts = []
                    while n:
                        flat = book.get_batch(a // block).column(0).values.to_numpy(zero_copy_only=True)
                        part = flat[a % block: a % block + n]
                        parts.append(part)
                        a, n = a + len(part), n - len(part)
                    return parts[0] if len(parts) == 1 else np.concatenate(parts)

                for at in range(0, len(starts), 10_000):
                    some = slice(at, at + 10_000)
                    crc = [zlib.crc32(span(int(a), int(n)).astype("<u4")) for a, n in zip(starts[some], counts[some])]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id").combine_chunks()[some], pa.array(starts[some] + base), pa.array(counts[some]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "folder", "start").repartition(partitions(spark)).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")
