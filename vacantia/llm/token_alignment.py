"""Alignment of the tokens of two tokenizers over the same text, by diagonal run skipping.

A text is split by a byte-level vocabulary (A) and by a piece vocabulary (B). Both cover the same bytes, a space and the text. Places
where tokens of both end cut the tokens into groups. The ends are two ascending arrays; where tokens correspond one to one the arrays
are equal at a constant shift of the index. So the aligner compares whole stretches at the present shift, doubles the
stretch while it is equal and halves it when it is not; what is left is one irregular group, which is resolved by two
pointers and gives the next shift.

The tokens that end a group together are a link. Links are counted over all documents by pair of ids, pre-aggregated in each
batch; a document then gets the sum of the counts of its links, and how many of its links are the best of their B id. The counts are broadcast up to
``MAX_PAIRS`` pairs (16 bytes each, counted first) and joined beyond, with the documents' side dealt by salted pair.

Files: links lie in a written table as packed id pairs, so texts are tokenised once.

Defined results: null and empty texts, and texts whose joined token bytes differ from a space and the text, have no tokens, zeros,
and an empty string of groups; equal rows are all counted and all returned; any doc_id, null too, is returned as it is; extra columns
are ignored; an empty table gives no rows. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from vacantia.llm.common import text_slices, written

#: Pairs whose counts are broadcast (16 bytes each); beyond, they are joined.
MAX_PAIRS = 1_000_000
#: Ways in which a frequent pair is dealt in the join.
SALTS = 64

#: Characters that the splitting patterns of both byte-level libraries class alike; other texts take the vocabulary's own library.
_COMMON = re.compile("[\t\n\r -~¡-ɏͰ-ͳΆ-ώЀ-ҁ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]*")

ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids of a byte-level vocabulary, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes[k] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
        self.ranked = self._ranked(spec, special)

    def _ranked(self, spec: dict, special: set):
        """The same vocabulary as ranks, if its ids are in the order of its merges; it then gives the same ids faster."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if not plain or model.get("type") != "BPE" or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.bytes[k]: k for entry, k in model["vocab"].items() if entry not in special}
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranked is not None and _COMMON.fullmatch(text):
            try:
                return self.ranked.encode_ordinary(text)
            except ValueError:
                # The faster library gives up on some very long runs of white space.
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def joined(self, ids: list[int]) -> bytes:
        return self.ranked.decode_bytes(ids) if self.ranked is not None else b"".join(map(self.bytes.__getitem__, ids))


class Pieces:
    """Ids of a piece vocabulary, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in ((k, self.library.id_to_piece(k)) for k in range(size))]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


#: Items of the first comparison of a stretch.
PROBE = 4


def runs(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (i, next i, j, next j) of two ascending lists with the same last value: one-to-one stretches of equal length, whose
    every item is a group, and irregular groups, which begin with different items."""
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        first, from_b, step = i, j, PROBE
        # While the ends agree at this shift the stretch doubles ...
        while i + step <= n and j + step <= m and a[i:i + step] == b[j:j + step]:
            i += step
            j += step
            step *= 2
        # ... then it halves, and the last few items are compared one by one, to find where they part.
        while step > PROBE:
            step //= 2
            if a[i:i + step] == b[j:j + step] and i + step <= n and j + step <= m:
                i += step
                j += step
        while i < n and a[i] == b[j]:
            i += 1
            j += 1
        if i > first:
            yield first, i, from_b, j
        if i < n:
            p, q = i, j
            x, y = a[p], b[q]
            while x != y:
                if x < y:
                    p += 1
                    x = a[p]
                else:
                    q += 1
                    y = b[q]
            p += 1
            q += 1
            yield i, p, j, q
            i, j = p, q


def group_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the ends of both sides, which tokens end a group (1) and which do not (0)."""
    cut_a, cut_b = bytearray(len(a)), bytearray(len(b))
    for i, i_next, j, j_next in runs(a, b):
        if a[i] == b[j]:
            cut_a[i:i_next] = cut_b[j:j_next] = b"\x01" * (i_next - i)
        else:
            cut_a[i_next - 1] = cut_b[j_next - 1] = 1
    return np.frombuffer(cut_a, np.uint8), np.frombuffer(cut_b, np.uint8)


class Aligner:
    """Per-worker state: both tokenizers, and the sizes and names of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        #: Each id as text with what follows it inside a group, and with what follows it at the end of its side of a group.
        self.names_a = np.array([f"{k}{mark}" for k in range(len(self.sizes_a)) for mark in ",|"], object)
        self.names_b = np.array([f"{k}{mark}" for k in range(len(self.sizes_b)) for mark in ",;"], object)

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if a side does not cover the text."""
        if not text:
            return [], []
        spaced = " " + text
        whole = spaced.encode()
        a, b = self.a.encode(spaced), self.b.encode(text)
        if self.a.joined(a) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """Tokens of A, tokens of B, groups, hash of the groups, and the links as an array of two rows of ids."""
        a, b = (np.array(ids, np.int64) for ids in self.tokens(text))
        if not len(a):
            return 0, 0, 0, "", np.zeros((2, 0), np.uint32)
        cut_a, cut_b = group_ends(np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist())
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        # A token of A stands behind all tokens of B in earlier groups, one of B behind all tokens of A up to its own group.
        earlier = np.concatenate([[0], last_b + 1])
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + earlier[np.cumsum(cut_a) - cut_a]] = self.names_a[2 * a + cut_a]
        parts[np.arange(len(b)) + (last_a + 1)[np.cumsum(cut_b) - cut_b]] = self.names_b[2 * b + cut_b]
        digest = hashlib.sha256("".join(parts.tolist())[:-1].encode()).hexdigest()
        return len(a), len(b), len(last_a), digest, np.array([a[last_a], b[last_b]], np.uint32)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = path_a, path_b
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def pack(links: np.ndarray) -> bytes:
    """Two rows of ids as bytes: 16 bits each if all fit, which the first byte tells."""
    wide = links.size and int(links.max()) >= 1 << 16
    return (b"\x04" if wide else b"\x02") + links.astype("<u4" if wide else "<u2").tobytes()


def codes(packed: bytes) -> np.ndarray:
    """Links as numbers: the id of A, shifted, and the id of B."""
    flat = np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype(np.int64).reshape(2, -1)
    return flat[0] << 32 | flat[1]


def aligned_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``ALIGNED``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            rows, ids = batch.column(0), batch.column(1)
            texts = batch.column(2).to_pylist()
            for start, end in text_slices([t or "" for t in texts]):
                out = []
                for text in texts[start:end]:
                    n_a, n_b, n_groups, digest, links = both.align(text or "")
                    out.append((n_a, n_b, n_groups, links.shape[1], digest, pack(links)))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(start, end - start), ids.slice(start, end - start), *columns], [c.split()[0] for c in ALIGNED.split(", ")])

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked pair: code, n (links of the corpus) and best (n is the highest of its B id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for start, end in text_slices(packed, 8_000_000):
                found, n = np.unique(np.concatenate([codes(p) for p in packed[start:end]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["code", "n"])

    counted = aligned.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = written(counted, "pair-counts").withColumn("b", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = counted.groupBy("b").agg(F.max("n").alias("highest"))
    return counted.join(highest, "b").select("code", "n", (F.col("n") == F.col("highest")).alias("best"))


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _looked_up(aligned: DataFrame, shared: Broadcast) -> DataFrame:
    """Results with the counts in each worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            sums, bests = [], []
            for packed in batch.column(batch.schema.get_field_index("links")).to_pylist():
                at = np.searchsorted(known, codes(packed))
                sums.append(int(n[at].sum()))
                bests.append(int(best[at].sum()))
            own = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [own[c] if c in own else batch.column(batch.schema.get_field_index(c)) for c in _RESULT], _RESULT)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.mapInArrow(run, schema)


def _joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Results by a join on the pairs of each document; a pair of every document is dealt over ``SALTS`` keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, times = np.unique(codes(packed), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row)), pa.array(found), pa.array(times, pa.int64())], ["row", "code", "times"])

    pairs = aligned.select("row", "links").mapInArrow(run, "row long, code long, times long")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    every = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sums = salted.join(every, ["code", "salt"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("links").join(sums, "row", "left").select(*[zero(c) if c in ("n_best", "count_sum") else F.col(c) for c in _RESULT])


def align_documents(docs: DataFrame, path_a: str, path_b: str, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    aligned = written(aligned_texts(docs, path_a, path_b), "aligned", compression="zstd")
    counts = written(pair_counts(aligned), "best-pairs")
    if counts.count() > max_pairs:
        return _joined(aligned, counts)
    table = counts.orderBy("code").toArrow()
    columns = [table.column(c).to_numpy() for c in ("code", "n", "best")]
    return _looked_up(aligned, spark.sparkContext.broadcast(tuple(columns)))
