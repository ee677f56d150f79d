"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may occur in a document with ``e = rate * m`` edits. It is split into ``e + 1`` pieces; with at most
``e`` edits one piece is untouched, so exact hits of pieces (one Aho-Corasick automaton for all of them) find every
candidate. A hit is verified by Myers' bit-parallel distance, first on the pair of neighbouring pieces, then on larger
and larger runs of pieces up to the whole item: a run of ``p`` pieces may have ``p - 1`` edits, and of two halves of a run that
matches at least one matches within its own budget, so no match is lost on the way up.

Texts are compared in lower case with white space folded. The items are a query set: they are held against all documents
in blocks of ``BLOCK_CHARS``, each of which is broadcast.

An item below ``EXACT_CHARS`` characters has no budget for edits: it matches where it stands whole, not
inside a longer word. Every item is searched and reported. What counts as evidence against a document is a decision of its own:
``clean_documents`` drops a document for items of ``EVIDENCE_CHARS`` characters or more, since "yes" stands in most clean ones.

Defined results: null and empty texts and items match nothing; items with equal texts are all reported; one row per document row and item, with the best place (fewest edits, then
first); repeated rows give repeated results; extra columns are ignored or kept as they are; empty tables give no rows
and leave documents as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacantia.llm.common import text_slices

#: Edits per character of an item; below this length an item must stand as it is.
RATE, EXACT_CHARS = 0.1, 40
#: Items of this length and more are evidence that a document holds the benchmark.
EVIDENCE_CHARS = 40
BLOCK_CHARS = 1_000_000

MATCH = "doc_id long, item_id long, edits long, item_chars long, first_char long, last_char long"


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def pattern_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for k, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << k
    return bits


def myers(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Fewest edits of a pattern against any substring of ``text``, and the first end (exclusive) of such a substring."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = bits.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at
        ph = ph << 1 & full
        pv = mh << 1 & full | ~(xv | ph) & full
        mv = ph & xv
    return best, end


def in_word(c: str) -> bool:
    """A letter or digit of a script that sets words apart; from U+2E80 on scripts mostly do not."""
    return c.isalnum() and c < "\u2e80"


class Item:
    """One benchmark item with its pieces and the runs of pieces above each of them."""

    def __init__(self, text: str, rate: float = RATE, exact_below: int = 0):
        self.text, self.whole = text, len(text) < exact_below
        self.budget = 0 if self.whole else int(len(text) * rate)
        n = self.budget + 1
        self.cuts = [len(text) * k // n for k in range(n + 1)]
        self.runs: list[list[tuple[int, int]]] = []
        for leaf in range(n):
            path, low, high = [], 0, n
            while high - low > 1:
                path.append((low, high))
                middle = (low + high) // 2
                low, high = (low, middle) if leaf < middle else (middle, high)
            self.runs.append(path[::-1])
        self._bits: dict[tuple[int, int], dict[str, int]] = {}
        self.near = [self._beside(leaf) for leaf in range(n)]

    def _beside(self, leaf: int) -> list[tuple[str, int, int]]:
        """Parts of the pieces beside ``leaf`` in its smallest run, one more than the run's budget, with the range of places
        (relative to the item's start) where they may stand: one of them must be untouched too."""
        if not self.runs[leaf]:
            return []
        low, high = self.runs[leaf][0]
        allowed = high - low - 1
        a, b = (self.cuts[leaf + 1], self.cuts[high]) if leaf == low else (self.cuts[low], self.cuts[leaf])
        cuts = [a + (b - a) * k // (allowed + 1) for k in range(allowed + 2)]
        return [(self.text[x:y], x - allowed, y + allowed) for x, y in zip(cuts, cuts[1:])]

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.cuts, self.cuts[1:])]

    def _run(self, low: int, high: int) -> tuple[dict[str, int], int, int]:
        start, end = self.cuts[low], self.cuts[high]
        if (low, high) not in self._bits:
            self._bits[low, high] = pattern_bits(self.text[start:end])
        return self._bits[low, high], start, end

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(edits, first, last) of the best match of the item around a hit of ``piece`` that begins at ``at``."""
        if self.whole:
            # One piece, the item itself.
            end = at + len(self.text)
            inside = at > 0 and in_word(text[at - 1]) and in_word(text[at])
            inside = inside or end < len(text) and in_word(text[end]) and in_word(text[end - 1])
            return None if inside else (0, at, end - 1)
        offset = at - self.cuts[piece]
        near, find = self.near[piece], text.find
        if near and all(find(part, max(0, offset + a), max(0, offset + b)) < 0 for part, a, b in near):
            return None
        for low, high in self.runs[piece]:
            bits, start, end = self._run(low, high)
            allowed = high - low - 1
            window = text[max(0, offset + start - allowed):max(0, offset + end + allowed)]
            if myers(bits, end - start, window)[0] > allowed:
                return None
        bits, _, m = self._run(0, len(self.cuts) - 1)
        begin = max(0, offset - self.budget)
        edits, end = myers(bits, m, text[begin:offset + m + self.budget])
        if edits > self.budget:
            return None
        # The start is the end of the reversed item in the reversed text before the end.
        back = text[begin:begin + end][::-1][:m + self.budget]
        length = myers(pattern_bits(self.text[::-1]), m, back)[1]
        return edits, begin + end - length, begin + end - 1


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, exact_below: int = 0):
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            by_text.setdefault(text, []).append(item_id)
        self.items = [(ids, Item(text, rate, exact_below)) for text, ids in by_text.items()]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for p, piece in enumerate(item.pieces()):
                found.setdefault(piece, []).append((k, p))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def match(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, edits, item length, first, last) per item that the text holds."""
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            at = end - size + 1
            for k, piece in owners:
                item, known = self.items[k][1], best.get(k)
                # An exact match cannot be bettered by a later place; nor need other pieces of one place be tried.
                if known and (known[0] == 0 or known[1] - item.budget <= at - item.cuts[piece] <= known[1] + item.budget):
                    continue
                found = item.verify(text, piece, at)
                if found and (known is None or found < known):
                    best[k] = found
        return sorted((i, e, len(self.items[k][1].text), first, last) for k, (e, first, last) in best.items() for i in self.items[k][0])


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    """The block's matcher, built once per worker; a worker holds one block."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, EXACT_CHARS)
    return _MATCHERS[key]


def item_blocks(items: DataFrame, min_chars: int = 1, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Folded items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = folded(row[1] or "")
        if len(text) < max(min_chars, 1):
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[str]]]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
    raw = [b"" if x is None else x for x in column]
    for start, end in text_slices(raw):
        yield start, end, [folded(x.decode("utf-8", "replace")) for x in raw[start:end]]


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """``MATCH`` rows: which documents (doc_id, text) hold which items (item_id, text), items of any length. The documents are scanned once
    per block and not shuffled."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], MATCH)
    for k, block in enumerate(item_blocks(items)):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in MATCH.split(", ")]
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                for start, _, texts in _texts(batch, "text"):
                    matcher = _matcher(key, shared.value, rate)
                    rows = [(ids[start + n], *m) for n, t in enumerate(texts) for m in matcher.match(t)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        part = narrow.mapInArrow(run, MATCH)
        found = part if k == 0 else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, rate: float = RATE, min_chars: int = EVIDENCE_CHARS) -> DataFrame:
    """The documents that hold no item of ``min_chars`` folded characters or more, with all their columns."""
    spark = docs.sparkSession
    for block in item_blocks(items, min_chars):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher = _matcher(key, shared.value, rate)
                keep = [not matcher.match(t) for _, _, texts in _texts(batch, "text") for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
