"""Op 2: token ids as Arrow files of equal-length sequences.

Texts are encoded in ascending key order into one stream of ids.  The stream
is written as Arrow IPC files (one per range of keys) whose record batches
hold two fixed-size-list columns: ``ids`` (16 or 32 bits, by vocabulary size)
and ``mask`` (which ids are real; only the last sequence of a file is padded).
An Arrow index file beside each one has key, start and length of every
document.  A reader maps the file into memory and takes any sequence, or any
run of ids, without a copy inside a batch.

Files go to a folder all executors share.  A task writes under a name of its
own attempt and the manifest, a Spark table, lists the names of the attempts
that counted, so a lost or repeated task leaves no doubt."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from partnerlens.llm.common import block_count, scratch
from partnerlens.llm.encoder import chunks, encoder

BATCH_ROWS = 256
PREFIX = 64  # characters of a text that may part rows of one key
MANIFEST = "part int, tokens_file string, index_file string, n_docs long, n_tokens long"


def sequence_schema(seq_len: int, vocab_size: int) -> pa.Schema:
    kind = pa.uint16() if vocab_size <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class SequenceWriter:
    """Appends ids to an Arrow file of sequences of ``seq_len``."""

    def __init__(self, fs, path: str, seq_len: int, vocab_size: int):
        self.schema, self.len = sequence_schema(seq_len, vocab_size), seq_len
        self.dtype = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.len * BATCH_ROWS:
            flat = np.concatenate(self.held)
            whole = len(flat) // (self.len * BATCH_ROWS) * self.len * BATCH_ROWS
            for i in range(0, whole, self.len * BATCH_ROWS):
                self._batch(flat[i:i + self.len * BATCH_ROWS], self.len * BATCH_ROWS)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), dtype=bool)
        mask[:real] = True
        ids, of = self.schema.field("ids").type, self.schema.field("mask").type
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), type=ids),
                                              pa.FixedSizeListArray.from_arrays(pa.array(mask), type=of)],
                                             schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            pad = -len(flat) % self.len
            self._batch(np.concatenate([flat, np.zeros(pad, dtype=self.dtype)]), len(flat))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to a file of sequences; local files are mapped, not read."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.len = self.file.schema.field("ids").type.list_size
        self._at: tuple[int, np.ndarray, np.ndarray] | None = None

    def _batch(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self._at is None or self._at[0] != b:
            batch = self.file.get_batch(b)
            self._at = (b, batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten().to_numpy(False))
        return self._at[1:]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the i-th sequence; the ids are a view."""
        ids, mask = self._batch(i // BATCH_ROWS)
        a = i % BATCH_ROWS * self.len
        return ids[a:a + self.len], mask[a:a + self.len]

    def run(self, start: int, n: int) -> np.ndarray:
        """n real ids from ``start``: a view if they lie in one batch."""
        per, parts = self.len * BATCH_ROWS, []
        while n > 0:
            b, a = divmod(start, per)
            ids, mask = self._batch(b)
            take = min(n, per - a)
            if not mask[a:a + take].all():
                raise ValueError("run beyond the end of the stream")
            parts.append(ids[a:a + take])
            start, n = start + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _writer(out_dir: str, tokenizer: str, seq_len: int, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, out, index, docs, total = encoder(tokenizer), TaskContext.get().partitionId(), None, [], 0, 0
        fs, folder = pa.fs.FileSystem.from_uri(out_dir)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        for batch in batches:
            for a, texts in chunks(batch.column(1)):
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = SequenceWriter(fs, f"{folder}/{name}.tokens.arrow", seq_len, enc.vocab_size)
                ids = enc.encode(texts, end_id)
                n = np.array([len(x) for x in ids], dtype=np.int64)
                for x in ids:
                    out.append(x)
                index.append(pa.record_batch([batch.column(0).slice(a, len(texts)).cast(pa.int64()), pa.array(total + np.cumsum(n) - n), pa.array(n)],
                                             names=["key", "start", "n"]))
                docs, total = docs + len(ids), total + int(n.sum())
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{folder}/{name}.index.arrow") as sink, \
                    pa.ipc.new_file(sink, index[0].schema) as w:
                for x in index:
                    w.write_batch(x)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"{out_dir}/{name}.tokens.arrow"]),
                                   pa.array([f"{out_dir}/{name}.index.arrow"]), pa.array([docs]), pa.array([total])],
                                  names=["part", "tokens_file", "index_file", "n_docs", "n_tokens"])
    return write


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 0, seq_len: int = 2048,
                      key: str = "doc_id", text: str = "text", file_bytes: int = 32 << 20) -> DataFrame:
    """Encodes every row and writes the files; returns the manifest (one row
    per file, ``part`` ascending with the keys).  A null text counts as empty;
    null keys come first; rows that repeat a key follow one another, by text,
    and may lie in several files, parted by the first ``PREFIX`` characters.
    Texts of any length are encoded whole and run over as many sequences as they
    need.  Special tokens written out in a text become what the tokenizer makes
    of them.  Other columns are not read.  An empty table writes nothing.
    ``out_dir`` must be on storage that all executors share."""
    n = block_count(docs, text, file_bytes)
    ordered = (docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
               .repartitionByRange(n, "key", F.substring("text", 1, PREFIX)).sortWithinPartitions("key", "text"))
    return scratch(ordered.mapInArrow(_writer(out_dir, tokenizer, seq_len, end_id), MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            tokens = SequenceFile(r["tokens_file"])
            fs, path = pa.fs.FileSystem.from_uri(r["index_file"])
            with fs.open_input_file(path) as f:
                index = pa.ipc.open_file(f)
                for b in range(index.num_record_batches):
                    x = index.get_batch(b)
                    start, n = x.column("start").to_numpy(), x.column("n").to_numpy()
                    crc = [zlib.crc32(tokens.run(s, k).astype("<u4").tobytes()) for s, k in zip(start.tolist(), n.tolist())]
                    yield pa.record_batch([x.column("key"), pa.array(start + r["base"]), x.column("n"),
                                           pa.array(crc, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_index(manifest: DataFrame) -> DataFrame:
    """Reads every file back: doc_id, start in the whole stream, n_tokens and
    ids_crc32 (of the ids as little-endian 32-bit numbers) per document.  The
    running total below is over files, not rows."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "tokens_file", "index_file",
                            F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    return files.repartition(n, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
