"""Token ids in Arrow files of equal-length sequences.

A part file is an Arrow IPC file whose record batches have the columns `ids`
(fixed-size list of unsigned integers, 16 bits where the vocabulary allows) and `mask`
(fixed-size list of booleans, false on the padding at the end of the part). Sequence i is
row i % rows of batch i // rows, so a memory map gives it without copying. Beside it lies
the index of its documents. Parts hold ascending ranges of doc_id; a part is written under a
temporary name and renamed, and readers take only the parts that the manifest names.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.storage import open_output, partitions, sweep

#: The id that closes a document: 0, in 4 bytes.
CLOSE = bytes(4)
#: Sequences of a record batch.
ROWS = 256


class TokenFile:
    """Random access to one part: sequence(i) is (ids, mask) as views of the map."""

    def __init__(self, uri: str):
        import pyarrow as pa
        from pyarrow import fs

        system, path = open_output(uri)
        source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size

    def batch(self, k: int):
        b = self.file.get_batch(k)
        return b.column("ids").flatten().to_numpy(), b.column("mask")

    def sequence(self, i: int):
        b = self.file.get_batch(i // ROWS)
        return tuple(b.column(c)[i % ROWS].values for c in ("ids", "mask"))

    def documents(self, counts):
        """The ids of each document in turn, as unsigned 32-bit arrays."""
        k, held, at = 0, np.empty(0, "<u4"), 0
        for n in counts:
            parts, need = [], n
            while need:
                if at == len(held):
                    held, at, k = self.batch(k)[0], 0, k + 1
                take = held[at : at + need]
                parts.append(take)
                need -= len(take)
                at += len(take)
            yield np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")


def write_token_files(df: DataFrame, path: str, tokenizer: str, length: int = 2048, bits: int = 16) -> DataFrame:
    """Write df (doc_id, text) below path; returns the manifest, which is also written there.

    The manifest has part, file, index, n_docs, n_tokens, n_sequences and start (ids of all
    parts before it), one row a part. Ids come in ascending (doc_id, text) order, null ids
    first, each document closed by id 0; a null or empty text is that id alone. Repeated rows are
    repeated documents; other columns are ignored; an empty table has no parts.
    """
    spark = df.sparkSession
    ordered = df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    kind = f"<u{bits // 8}"

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from keyloom.llm.tokens import encoder

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        system, base = open_output(path)
        names = [f"{base}/part-{part:06d}.{x}" for x in ("arrow", "index.arrow")]
        temp = [f"{base}/.part-{uuid.uuid4().hex}.{x}" for x in ("a", "b")]
        item = pa.uint16() if bits == 16 else pa.uint32()
        schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        docs = total = sequences = 0
        writers, held, size = [], [], 0

        def put(last: bool):
            nonlocal held, size, sequences
            ids = np.concatenate(held) if held else np.empty(0, kind)
            whole = len(ids) // (length * ROWS) * length * ROWS
            todo = ids if last else ids[:whole]
            for at in range(0, len(todo), length * ROWS):
                x = todo[at : at + length * ROWS]
                pad = -len(x) % length
                mask = np.ones(len(x) + pad, bool)
                mask[len(x) :] = False
                rows = [pa.FixedSizeListArray.from_arrays(pa.array(v), length) for v in (np.concatenate([x, np.zeros(pad, kind)]), mask)]
                writers[0].write_batch(pa.record_batch(rows, schema=schema))
                sequences += len(rows[0])
            held, size = ([], 0) if last else ([ids[whole:]], len(ids) - whole)

        sinks = []
        for b in batches:
            if not b.num_rows:
                continue
            if not writers:
                system.create_dir(base, recursive=True)
                sinks = [system.open_output_stream(t) for t in temp]
                writers = [pa.ipc.new_file(s, t) for s, t in zip(sinks, (schema, index_schema), strict=True)]
            column, at = b.column("text"), 0
            while at < b.num_rows:
                texts = column.slice(at, 512).to_pylist()
                found = enc.encode(texts)
                counts = [len(x) // 4 + 1 for x in found]
                ids = np.frombuffer(b"".join([x + CLOSE for x in found]), "<u4")
                if bits == 16 and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than 16 bits")
                held.append(ids.astype(kind))
                size += len(ids)
                starts = total + np.concatenate([[0], np.cumsum(counts)[:-1]])
                writers[1].write_batch(pa.record_batch([b.column("doc_id").slice(at, len(texts)).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema))
                total, docs, at = total + sum(counts), docs + len(texts), at + len(texts)
                if size >= length * ROWS:
                    put(False)
        if writers:
            put(True)
            for w, s, t, name in zip(writers, sinks, temp, names, strict=True):
                w.close()
                s.close()
                system.move(t, name)
            root = path.rstrip("/")
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{root}/part-{part:06d}.arrow", "index": f"{root}/part-{part:06d}.index.arrow", "n_docs": docs, "n_tokens": total, "n_sequences": sequences}])

    parts = sorted(ordered.mapInArrow(write, "part long, file string, index string, n_docs long, n_tokens long, n_sequences long").collect())  # one row a partition
    sweep(spark, path)
    rows, start = [], 0
    for p in parts:
        rows.append((*p, start))
        start += p.n_tokens
    spark.createDataFrame(rows, "part long, file string, index string, n_docs long, n_tokens long, n_sequences long, start long").coalesce(1).write.json(f"{path.rstrip('/')}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, file string, index string, n_docs long, n_tokens long, n_sequences long, start long").json(f"{path.rstrip('/')}/manifest")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and token_ids (unsigned 32-bit, little-endian) from the files."""
    parts = read_manifest(spark, path)
    n = max(1, parts.count())

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                file = TokenFile(row["file"])
                system, name = open_output(row["index"])
                with system.open_input_file(name) as source:
                    index = pa.ipc.open_file(source)
                    tables = [index.get_batch(k) for k in range(index.num_record_batches)]
                ids = file.documents(c for t in tables for c in t.column("n_tokens").to_pylist())
                for t in tables:
                    yield pa.record_batch([t.column("doc_id"), pa.array(t.column("start").to_numpy() + row["start"]), t.column("n_tokens"), pa.array([next(ids).tobytes() for _ in range(t.num_rows)], pa.binary())], names=["doc_id", "start", "n_tokens", "token_ids"])

    return parts.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, token_ids binary")


