"""Quality rules by tokeniser fertility.

Every word of a text is split by a public vocabulary. Characters per token, the share of byte-fallback tokens and the
entropy of the tokens are held against bands per language, or per script where the language has no band of its own.
Beside them stand plain rules on symbols, repeated lines and repeated five-word windows.

Words are tokenised one by one, each distinct word once per worker, so a text costs look-ups and array sums. Memory is
bounded by the word table and one batch of texts.

Defined results: a null text is empty (no words, no tokens, rejected); texts without a word have null ratios; a null or
unknown language takes the band of the script that most of its letters have; repeated rows give repeated results; extra
columns are ignored unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vacantia.llm.common import Ragged, WordTable, binary_column, text_slices

#: Words in a window that may repeat, the share of repeated words that fails, and the least number of words.
WINDOW, MAX_REPEATED_PCT, MIN_WORDS = 5, 20, 10
SYMBOLS = b"#*$%&|<>"
#: Distinct words that a worker keeps with their tokens.
WORDS_HELD = 250_000


@dataclass(frozen=True)
class Band:
    """What a text must lie in. ``min_entropy`` (bits per token) holds for texts of ``min_tokens`` and more."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    min_tokens: int = 64


#: By script; languages may have their own. Fitted by eye to public multilingual fertility figures, and wide on purpose.
SCRIPT_BANDS = {
    "latin": Band(1.2, 9.0, 0.25, 3.0),
    "other": Band(0.25, 6.0, 0.97, 2.5),
}
LANGUAGE_BANDS = {
    "en": Band(1.3, 9.0, 0.15, 3.0),
    "de": Band(1.2, 9.0, 0.20, 3.0),
    "fr": Band(1.2, 9.0, 0.20, 3.0),
    "es": Band(1.2, 9.0, 0.20, 3.0),
}

METRICS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_byte_tokens long, chars_per_token double, byte_share double, token_entropy double, script string")


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of numbered words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    base = int(words.max()) + 1
    if base ** window < 2 ** 62:
        codes = np.zeros(n, np.int64)
        for k in range(window):
            codes = codes * base + words[k:k + n]
    else:
        codes = words[:n]
        for k in range(1, window):
            codes = np.unique(codes * base + words[k:k + n], return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            repeats += 1
        elif line and not line.isspace():
            seen.add(line)
    return repeats


class Fertility:
    """Per-worker state: the vocabulary and what is known of the words seen so far."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.table = WordTable(self._learn, self._reset, WORDS_HELD)
        self._reset()

    def _reset(self) -> None:
        self.chars, self.ids = np.zeros(0, np.int64), Ragged(np.int32)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, texts), np.int64, len(texts))])
        self.ids.extend(self.model.encode(texts, num_threads=1))

    def measure_all(self, texts: list[bytes]) -> list[tuple]:
        """Metrics of each text, without the id."""
        out = []
        for start, end in text_slices(texts):
            part = texts[start:end]
            numbers = self.table.of([t.split() for t in part])
            out += [self._of(text, n) for text, n in zip(part, numbers)]
        return out

    def _of(self, text: bytes, numbers: np.ndarray) -> tuple:
        n = len(numbers)
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        if not n:
            return 0, 0, symbols, 0, 0, 0, 0, None, None, None, "latin"
        word_chars = int(self.chars[numbers].sum())
        ids = self.ids.take(numbers)
        total = len(ids)
        byte_tokens = int(self.is_byte[ids].sum())
        tally = np.unique(ids, return_counts=True)[1] if total < 4096 else np.bincount(ids)
        shares = tally[tally > 0] / total
        entropy = float(-(shares * np.log2(shares)).sum()) + 0.0
        local = np.unique(numbers, return_inverse=True)[1]
        lead = np.frombuffer(text, np.uint8)
        # Lead bytes from 0xCE on are those of scripts beyond Latin and its accents.
        script = "other" if 2 * int((lead >= 0xCE).sum()) > word_chars else "latin"
        return (n, word_chars, symbols, duplicate_lines(text), repeated_words(local), total, byte_tokens,
                word_chars / total if total else None, byte_tokens / total if total else None, entropy, script)


_STATE: dict[str, Fertility] = {}


def measure_batches(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    if model_path not in _STATE:
        _STATE[model_path] = Fertility(model_path)
    state = _STATE[model_path]
    kinds = [pa.int64()] * 7 + [pa.float64()] * 3 + [pa.string()]
    names = [c.split()[0] for c in METRICS.split(", ")]
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            rows = state.measure_all(binary_column(part, "text"))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), *columns], names)


def in_band(lang: str = "lang", languages: dict[str, Band] = LANGUAGE_BANDS, scripts: dict[str, Band] = SCRIPT_BANDS):
    """Whether a row of metrics lies in the band of its language, else of its script."""
    def test(b: Band):
        return (
            F.col("chars_per_token").between(b.min_chars_per_token, b.max_chars_per_token)
            & (F.col("byte_share") <= b.max_byte_share)
            & ((F.col("n_tokens") < b.min_tokens) | (F.col("token_entropy") >= b.min_entropy)))

    rule = F.lit(False)
    for script, b in scripts.items():
        rule = F.when(F.col("script") == script, test(b)).otherwise(rule)
    for name, b in languages.items():
        rule = F.when(F.col(lang) == name, test(b)).otherwise(rule)
    return F.coalesce(rule, F.lit(False))


def _judged(docs: DataFrame, model_path: str, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Metrics, ``base_failed`` and ``kept`` beside the columns ``keep`` of the documents, and the names that those have
    here: names of their own, so that they clash with nothing."""
    kinds = dict(docs.dtypes)
    wanted = [c for c in dict.fromkeys(["doc_id", "text", "lang", *keep]) if c in kinds]
    names = {c: f"_{i}" for i, c in enumerate(wanted)}
    carried = [c for c in wanted if c in keep or c == "lang"]
    schema = METRICS + "".join(f", {names[c]} {kinds[c]}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                column = lambda c, p=part: p.column(p.schema.get_field_index(names[c]))
                ids = column("doc_id").cast(pa.int64())
                narrow = pa.RecordBatch.from_arrays([ids, column("text")], ["doc_id", "text"])
                for measured in measure_batches(iter([narrow]), model_path):
                    more = [column(c) for c in carried]
                    yield pa.RecordBatch.from_arrays([*measured.columns, *more], [*measured.schema.names, *[names[c] for c in carried]])

    out = docs.select(*[F.col(c).alias(alias) for c, alias in names.items()]).mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    verdict = in_band(names["lang"]) if "lang" in names else in_band("script", languages={})
    return out.withColumn("kept", ~F.col("base_failed") & verdict), names


def judge(docs: DataFrame, model_path: str) -> DataFrame:
    """Metrics, ``base_failed`` and ``kept`` per document. The texts pass through one Arrow job and are not shuffled."""
    return _judged(docs, model_path, [])[0].select(*[c.split()[0] for c in METRICS.split(", ")], "base_failed", "kept")


def kept_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    judged, names = _judged(docs, model_path, docs.columns)
    return judged.where("kept").select(*[F.col(names[c]).alias(c) for c in docs.columns])
