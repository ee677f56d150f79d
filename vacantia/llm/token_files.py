"""Token ids in Arrow files of equal-length sequences.

A folder holds one shard per range of document ids, ascending:

* ``ids-<shard>-<attempt>.arrow``: Arrow file format, record batches of ``BATCH`` sequences with the columns ``ids`` (fixed-size
  list of unsigned integers, 16 bits where the vocabulary allows) and ``mask`` (fixed-size list of bytes with a bit per
  id, least significant first, 0 on the padding of a shard's last sequence). Sequence ``i`` is row ``i % BATCH`` of batch ``i // BATCH``; a memory-mapped reader gets it
  without a copy.
* ``docs-<shard>-<attempt>.arrow``: doc_id, start in the shard, and number of ids of each document.
* ``manifest``: one row per shard, written by Spark after the files. Files of lost or repeated attempts are in no manifest row.

Documents follow each other without gaps inside a shard and end with the end id.

Defined results: a null text is empty and gives the end id alone; a null doc_id sorts first; documents with equal ids are
ordered by their text's hash; equal rows are all written; extra columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vacantia.llm.common import Ragged, binary_column, open_folder, split_words, text_slices

SEQUENCE_LENGTH = 2048
BATCH = 64

MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_tokens long"
READ = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"

#: Words whose characters every library folds and classes alike: printable ASCII and accented Latin letters but one, whose
#: lower case is two characters.
_PLAIN = "^[!-~À-įı-ɏ]+$"
#: Distinct pieces that a worker keeps at once.
MAX_PIECES = 600_000


class WordEncoder:
    """Ids of a text by a vocabulary whose tokens never cross white space.

    Where the vocabulary file splits words into runs of letters, single digits and runs of other characters, Arrow splits the
    texts into words, the distinct words into these pieces, and tells the distinct pieces apart; the library's model
    encodes each piece once per worker. Any other vocabulary and any word with unusual characters takes the library's
    whole path, once per distinct word. Both give the same ids. The rest is index arrays.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = (split[0].get("pattern") or {}).get("Regex")
        direct = normal == ["NFC", "Replace", "Lowercase"] and pattern and [s.get("type") for s in split] == ["Split", "ByteLevel"]
        #: Finds the pieces that the model sees in a word.
        self.pieces = pattern if direct else None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.numbers: dict[str, int] = {}
        self.ids = Ragged(self.dtype)

    def _keys(self, words: pa.Array) -> pa.ListArray:
        """Distinct words as lists of keys: the pieces of a plain word, or a space and the word itself."""
        whole = pc.binary_join_element_wise("", words, " ")
        if self.pieces is None:
            return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32), whole)
        plain = pc.match_substring_regex(words, _PLAIN)
        for mark in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, mark))
        cut = pc.utf8_rtrim(pc.replace_substring_regex(pc.utf8_lower(words), self.pieces, "\\0\n"), "\n")
        return pc.split_pattern(pc.if_else(plain, cut, whole), "\n")

    def _learn(self, key: str) -> list[int]:
        if key.startswith(" "):
            return self.tokenizer.encode(key[1:], add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize(key if key.isascii() else key.encode().decode("latin-1").translate(_BYTE_LETTERS))]

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of distinct keys; new ones are learned. The table is emptied when full."""
        numbers = self.numbers
        if len(numbers) > MAX_PIECES:
            numbers.clear()
            self.ids = Ragged(self.dtype)
        new = [k for k in keys if k not in numbers]
        if new:
            self.ids.extend(list(map(self._learn, new)))
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
        return np.fromiter(map(numbers.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has."""
        words, offsets = split_words(texts)
        keys = self._keys(words.dictionary)
        parts = keys.flatten().dictionary_encode()
        known = self._numbers(parts.dictionary.to_pylist())[parts.indices.to_numpy()]
        # Words as runs of keys, keys as runs of ids: first the ids of the distinct words, then those of all words.
        ends = np.concatenate([[0], np.cumsum(self.ids.counts(known))])[keys.offsets.to_numpy()]
        of_words = Ragged(self.dtype)
        of_words.values, of_words.starts = self.ids.take(known), ends
        at = words.indices.to_numpy()
        sizes = np.concatenate([[0], np.cumsum(of_words.counts(at))])[offsets]
        return np.insert(of_words.take(at), sizes[1:], self.dtype(end_id)), np.diff(sizes) + 1


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable bytes for themselves, the rest from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Writes a stream of ids as sequences; holds one record batch at most, besides the ids just given."""

    def __init__(self, sink, dtype, length: int):
        if length % 8:
            raise ValueError("the sequence length must be a multiple of 8")
        kind = pa.from_numpy_dtype(dtype)
        self.length, self.kind, self.dtype = length, kind, dtype
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * BATCH:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // (self.length * BATCH) * (self.length * BATCH)
            for at in range(0, whole, self.length * BATCH):
                self._write(flat[at:at + self.length * BATCH], self.length * BATCH)
            self.waiting, self.size = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(len(flat)) < real, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((flat, self.length), (mask, self.length // 8))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[:len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = SEQUENCE_LENGTH,
) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder`` and return the manifest.

    One shuffle orders the texts by ranges of doc_id; each task then encodes its range as a stream.
    """
    spark = docs.sparkSession
    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    system, inner = open_folder(folder)
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and first.num_rows == 0:
            first = next(batches, None)
        if first is None:
            return
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, base = open_folder(folder)
        names = [f"{kind}-{shard:06d}-{attempt}.arrow" for kind in ("ids", "docs")]
        words = encoder(tokenizer_path)
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        n_docs = 0
        with out.open_output_stream(f"{base}/{names[0]}") as ids_sink, out.open_output_stream(f"{base}/{names[1]}") as docs_sink:
            writer, docs_writer = SequenceWriter(ids_sink, words.dtype, length), pa.ipc.new_file(docs_sink, index)

            def chained():
                yield first
                yield from batches

            for batch in chained():
                texts = binary_column(batch, "text")
                for start, end in text_slices(texts):
                    ids, counts = words.encode(texts[start:end], end_id)
                    starts = writer.total + np.cumsum(counts) - counts
                    writer.add(ids)
                    doc_ids = batch.column(batch.schema.get_field_index("doc_id")).slice(start, end - start)
                    docs_writer.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index))
                    n_docs += end - start
            writer.close()
            docs_writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in ((shard, pa.int32()), (names[0], pa.string()), (names[1], pa.string()), (n_docs, pa.int64()), (writer.total, pa.int64()))],
            [c.split()[0] for c in MANIFEST.split(", ")])

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with the number of ids of all shards before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """Random access to the sequences of one file; a local file is memory-mapped."""

    def __init__(self, folder: str, name: str):
        system, inner = open_folder(folder)
        path = f"{inner}/{name}"
        source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size

    def column(self, batch: int, name: str) -> np.ndarray:
        """All values of a batch, one sequence after the other, without a copy."""
        return self.reader.get_batch(batch).column(name).values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int, name: str = "ids") -> np.ndarray:
        """The ids or the packed mask of one sequence."""
        width = self.length if name == "ids" else self.length // 8
        at = i % BATCH * width
        return self.column(i // BATCH, name)[at:at + width]

    def ids(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in pieces."""
        step = self.length * BATCH
        while count > 0:
            at = start % step
            piece = self.column(start // step, "ids")[at:at + count]
            yield piece
            start, count = start + len(piece), count - len(piece)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    shards = read_manifest(spark, folder)
    parallel = max(1, spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = Shard(folder, row["ids_path"])
                system, inner = open_folder(folder)
                with system.open_input_file(f"{inner}/{row['docs_path']}") as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        crcs = []
                        for start, count in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist()):
                            crc = 0
                            for piece in data.ids(start, count):
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        starts = pa.array(part.column("start").to_numpy() + row["shard_start"], pa.int64())
                        shard = pa.array([row["shard"]] * part.num_rows, pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [shard, part.column("doc_id"), starts, part.column("n_tokens"), pa.array(crcs, pa.int64())],
                            [c.split()[0] for c in READ.split(", ")])

    # One row per file: dealt out so that the files are read in parallel.
    return shards.repartition(4 * parallel, "shard").mapInArrow(read, READ)
