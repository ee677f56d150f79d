"""Repair of conversation structure over a suffix-shared automaton (DAWG).

A turn becomes a letter for its role and its fault, a conversation a word of such letters. What the cheapest repair of a
conversation costs from a turn on depends only on the rest of the word and on the state of the grammar ``(s?(ua)+)?``. So the words
of all conversations share one automaton that is minimised from the end: a node is a suffix, whatever conversations end in it. A node
holds, for each state of the grammar, the least cost to go and the first edits of the best audit. Words are sorted by their
reverse; so neighbours share the longest suffixes, and a stack of nodes from the end on computes each node once per sorted range.

Steps, all of them Spark jobs: turns get letters; sorted turns are packed into bounded chunks, so that a conversation of any
length is spread over tasks; a conversation's word is put together from its chunks; different words are repaired once; the
edits go back to the chunks, whose repaired text is hashed in order. A task holds one chunk of turns, and of a whole conversation
no more than a letter and an edit per turn, which is what its row of the result holds.

Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5. Blank and duplicate turns
must be deleted; a truncated turn that stays adds 5.

Defined results: one row per conv_id (null is one of them); a null role, text, or part of the damage key counts as one space; turns sort by
turn (null first), then role and text; rows with the same turn, role and text are alike, so the later ones are duplicates; any other
role than s, u or a by its first letter is no legal role and can only be reroled or deleted; a conversation that lost
all rows has zeros, an empty audit and the hash of the empty string; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacantia.llm.common import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: Turns and bytes of a chunk.
CHUNK_TURNS, CHUNK_BYTES = 2_048, 1_000_000

#: States of the grammar: at the start, after system, after user, after assistant. Per state: what follows each legal role, the
#: role that a reroled or inserted turn gets with its state, and whether a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ENDS = (True, False, False, True)
FAR = 1 << 60

#: A turn's letter: by role initial (s, u, a, other) and by fault (none, blank, duplicate, truncated).
ROLES, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
LETTERS = "abcdefghijklmnop"
LEGAL = {"su", "ua", "au"}


def letter(role: int, fault: int) -> str:
    return LETTERS[role * 4 + fault]


# --- the automaton -----------------------------------------------------------------------------------------------------------

#: Per state of the grammar: cost to go, the first edit, and the state after it.
Node = tuple[tuple[int, str, int], ...]


def _with_insert(options: list[tuple[int, str, int]]) -> Node:
    """The best per state, where an inserted turn leads to another state of the same node. Ties go to the smallest letter; each letter
    leads to one state, so the audit of the node is the least too."""
    best = list(options)
    # An insertion leads to the states after user and after assistant, from there only to the other one, at a cost each time.
    for _ in range(2):
        best = [min(options[s], (best[MADE[s][1]][0] + INSERT_COST, INSERT, MADE[s][1])) for s in range(4)]
    return tuple(best)


LAST: Node = _with_insert([(0 if ends else FAR, "", s) for s, ends in enumerate(ENDS)])


def node_before(turn: str, after: Node) -> Node:
    """The node of a turn in front of a suffix."""
    role, fault = divmod(LETTERS.index(turn), 4)
    stays = 0 if fault == 0 else TRUNCATED_COST if fault == 3 else FAR
    options = []
    for s in range(4):
        ways = [(DELETE_COST + after[s][0], DELETE, s)]
        if stays < FAR:
            if ROLES[role] in FOLLOWS[s]:
                to = FOLLOWS[s][ROLES[role]]
                ways.append((stays + after[to][0], KEEP, to))
            ways.append((stays + REROLE_COST + after[MADE[s][1]][0], REROLE, MADE[s][1]))
        options.append(min(ways))
    return _with_insert(options)


def best_audit(nodes: list[Node]) -> str:
    """The edits from the start state through the nodes of a word, first turn first; the last node is ``LAST``."""
    out, state = [], START
    for node in nodes:
        edit = INSERT
        while edit == INSERT:
            _, edit, state = node[state]
            out.append(edit)
    return "".join(out)


REPAIRED = "word string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repaired_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in the order of their reverse to ``REPAIRED``. The nodes of the suffix that a word shares with the one before it are
    on the stack already."""
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    before, stack = "", [LAST]
    for batch in batches:
        out = []
        for word in batch.column(0).to_pylist():
            backwards = word[::-1]
            shared = _common_prefix(before, backwards)
            del stack[shared + 1:]
            for turn in backwards[shared:]:
                stack.append(node_before(turn, stack[-1]))
            before = backwards
            out.append((word, *faults(word), stack[-1][START][0], best_audit(stack[::-1])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def faults(word: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours whose roles do not follow each other."""
    numbers = [LETTERS.index(c) for c in word]
    roles = "".join(ROLES[n // 4] for n in numbers)
    counts = [sum(n % 4 == k for n in numbers) for k in (1, 2, 3)]
    return *counts, sum(roles[i:i + 2] not in LEGAL for i in range(len(roles) - 1))


# --- turns -------------------------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage that the hash of conv_id and turn deals out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    full = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    changed = full.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return changed.drop("copy")


def turn_letters(rows: DataFrame) -> DataFrame:
    """The rows with ``letter``, the role and first fault of each, and ``uid``, which tells equal rows apart.

    A turn is a duplicate unless it is the first with its role and text in the conversation. The first ones are found by an
    aggregate that combines before its shuffle, and joined by uid, so a frequent text or a long conversation loads no task.
    """
    full = rows.withColumn("uid", F.monotonically_increasing_id())
    content = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    full = written(full.select("*", *content), "turns")
    first = full.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn", "uid")).alias("first")).select(F.col("first.uid").alias("first_uid"))
    joined = full.join(first, F.col("uid") == F.col("first_uid"), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, 1).when(F.col("first_uid").isNull(), 2).when(truncated, 3).otherwise(0)
    place = F.position(F.substring("role", 1, 1), F.lit(ROLES[:3]))
    role = F.when((F.col("role") != "") & (place > 0), place - 1).otherwise(3)
    return joined.select("conv_id", "turn", "role", "text", "uid", "h1", "h2", F.substring(F.lit(LETTERS), role * 4 + fault + 1, F.lit(1)).alias("letter"))


CHUNK = "conv_id long, chunk long, word string, low long, high long, n_turns long, roles array<string>, texts array<string>"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (part, conv_id, turn, role, text, letter) to ``CHUNK``: the turns of one conversation, bounded in number and bytes."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = [c.split()[0] for c in CHUNK.split(", ")]
    held: list[tuple] = []
    done: list[tuple] = []
    count = size = total = 0

    def close() -> None:
        nonlocal count, size, total
        part, conv_id = held[0][:2]
        turns = sorted({r[2] for r in held if r[2] is not None})
        done.append((
            conv_id, part << 32 | count, "".join(r[5] for r in held), turns[0] if turns else None, turns[-1] if turns else None, len(turns),
            [r[3] for r in held], [r[4] for r in held]))
        count, total, size = count + 1, total + size, 0
        held.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    for rows in batches:
        for row in zip(*(c.to_pylist() for c in rows.columns)):
            if held and (row[1] != held[0][1] or len(held) >= CHUNK_TURNS or size >= CHUNK_BYTES):
                close()
                if len(done) >= 4096 or total >= 8 * CHUNK_BYTES:
                    yield batch()
                    done, total = [], 0
            held.append(row)
            size += len(row[4]) + len(row[3])
    if held:
        close()
    if done:
        yield batch()


def chunks(letters: DataFrame) -> DataFrame:
    """The turns of all conversations in order, as rows of ``CHUNK`` that sort by ``chunk``. A range may end inside a conversation."""
    head = F.substring("text", 1, 64)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "h1", "h2", "uid"]
    ranged = letters.withColumn("head", head).repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id().cast("long").alias("part")
    return written(ranged.select(part, "conv_id", "turn", "role", "text", "letter").mapInArrow(chunked, CHUNK), "chunks")


# --- repair ------------------------------------------------------------------------------------------------------------------

def judged(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """Per conv_id of ``rows``: gaps, the counts, cost and audit."""
    part = F.struct("chunk", "word", "low", "high", "n_turns")
    every = packed.select("conv_id", part.alias("c")).unionByName(
        rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("c", F.lit(None)))
    whole = every.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    pick = lambda name: F.transform("c", lambda x: x[name])
    # A turn number that ends a chunk may begin the next one too.
    twice = F.when(F.size("c") > 1, F.size(F.filter(
        F.arrays_zip(F.slice(pick("high"), 1, F.size("c") - 1).alias("high"), F.slice(pick("low"), 2, F.size("c")).alias("low")),
        lambda x: x["high"] == x["low"]))).otherwise(0)
    n = F.aggregate(pick("n_turns"), F.lit(0).cast("long"), lambda a, x: a + x) - twice
    gaps = F.coalesce(F.array_max(pick("high")) - F.array_min(pick("low")) + 1 - n, F.lit(0).cast("long"))
    whole = written(whole.select("conv_id", gaps.alias("gaps"), F.array_join(pick("word"), "").alias("word")), "words")
    backwards = F.reverse("word")
    different = whole.select("word").distinct().repartitionByRange(backwards).sortWithinPartitions(backwards)
    return whole.join(written(different.mapInArrow(repaired_words, REPAIRED), "repaired"), "word").drop("word")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repair:
    """The edits of one conversation, applied to its turns in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, START, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def _insert(self) -> None:
        while self.audit[self.at:self.at + 1] == INSERT:
            role, self.state = MADE[self.state]
            self._put(role, "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = FOLLOWS[self.state][role[0]]
            self._put(role, text)
        elif edit == REROLE:
            role, self.state = MADE[self.state]
            self._put(role, text)

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and chunk, the judgement first (chunk -1), to ``RESULT``."""
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    judgement, repair, out = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for rows in batches:
        for start in range(0, rows.num_rows, 64):
            for r in rows.slice(start, 64).to_pylist():
                if r["chunk"] == -1:
                    if judgement is not None:
                        out.append((*judgement, repair.digest()))
                    judgement, repair = [r[c] for c in names[:-1]], Repair(r["audit"])
                else:
                    for role, text in zip(r["roles"], r["texts"]):
                        repair.turn(role, text)
        if len(out) >= 4096:
            yield batch()
            out = []
    if judgement is not None:
        out.append((*judgement, repair.digest()))
    if out:
        yield batch()


def repair_turns(rows: DataFrame) -> DataFrame:
    """Per conv_id of the turns ``rows`` (conv_id, turn, role, text), as they are: ``RESULT``."""
    typed = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return _repaired(typed, typed)


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``RESULT`` of the turns after the damage; a conversation that lost all of them has a row too."""
    return _repaired(rows, damaged(rows))


def _repaired(rows: DataFrame, turns: DataFrame) -> DataFrame:
    packed = chunks(turn_letters(turns))
    found = judged(rows, packed).withColumn("chunk", F.lit(-1).cast("long"))
    texts = packed.select("conv_id", "chunk", "roles", "texts")
    # Dealt by conversation, a row per chunk: the hash of a conversation's text can only be taken in order.
    both = found.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return both.mapInArrow(applied, RESULT)
