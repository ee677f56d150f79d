"""Shared helpers of the training-data operators: written tables, word columns, files in shared folders, word tables."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia.session import scratch_path

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Distinct words that a worker keeps at once.
WORD_TABLE_SIZE = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it instead of repeating the work, and a lost
    executor costs no more than the tasks it ran."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name for ``df[...]``, also with dots or back quotes in it."""
    return f"`{name.replace('`', '``')}`"


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """Key of a text: equal texts have equal keys (128 bits of md5); null is the empty text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as URI or as absolute path."""
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else _as_uri(path))
    return system, inner.rstrip("/")


def _as_uri(path: str) -> str:
    scheme, _, rest = path.partition(":")
    return f"{scheme}://{rest}" if rest.startswith("/") else path


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def text_slices(texts: list[bytes], most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``most_bytes`` each, so that work on a batch is bounded however long texts are."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most_bytes:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def split_words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one text after the other, dictionary-encoded, and the places among them where texts begin."""
    try:
        whole = pa.array(texts, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        # Not all bytes are characters.
        whole = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
    lists = pc.ascii_split_whitespace(whole)
    offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.values
    # White space at the ends of a text gives empty words.
    real = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real).dictionary_encode(), before[offsets]


class WordTable:
    """Numbers for distinct words, with values that ``learn`` computes once per word.

    Holds at most ``limit`` words plus those of one slice of texts; it is emptied when full, so memory is bounded
    and results do not depend on what it holds.
    """

    def __init__(self, learn: Callable[[list], None], reset: Callable[[], None], limit: int = WORD_TABLE_SIZE):
        self.numbers: dict[Hashable, int] = {}
        self.learn, self.reset, self.limit = learn, reset, limit

    def of(self, texts: list[list]) -> list[np.ndarray]:
        """The numbers of the words of each text."""
        numbers = self.numbers
        if len(numbers) > self.limit:
            numbers.clear()
            self.reset()
        new = list(set().union(*texts).difference(numbers))
        if new:
            self.learn(new)
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
        return [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in texts]


class Ragged:
    """Lists of numbers, one per word, in one array."""

    def __init__(self, dtype):
        self.values, self.starts = np.zeros(0, dtype), np.zeros(1, np.int64)

    def extend(self, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter(chain.from_iterable(lists), self.values.dtype, int(counts.sum()))
        self.values = np.concatenate([self.values, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How long the lists of these words are."""
        return self.starts[numbers + 1] - self.starts[numbers]

    def take(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of these words, one after the other."""
        first = self.starts[numbers]
        counts = self.starts[numbers + 1] - first
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.repeat(first - (ends - counts), counts) + np.arange(total)]
