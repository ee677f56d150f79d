"""Nearest neighbours, token alignment and turn repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vacantia.llm import token_alignment, turn_repair, vector_search

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHES = ", uid long, h1 long, row long, chunk long, word string, `a.b` int, side int"
CLASH = (1, 2, 3, 4, "w", 5, 6)


# --- nearest neighbours ------------------------------------------------------------------------------------------------------

def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"vec_id long, embedding array<{kind}>" + CLASHES)


def plain_nearest(rows, every, k=5):
    ok = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows)
          if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for n, i, v in ok:
        if i is None or i % every:
            continue
        scored = []
        for m, j, w in ok:
            if m != n and len(w) == len(v):
                a, b = v / 2.0 ** np.frexp(np.abs(v).max())[1], w / 2.0 ** np.frexp(np.abs(w).max())[1]
                total = lambda z: float(np.cumsum(z)[-1])
                score = min(1.0, total(a * b) / np.sqrt(total(a * a) * total(b * b)))
                scored.append((-score, j is None, j or 0))
        for rank, (score, none, j) in enumerate(sorted(scored)[:k], 1):
            out[(i, rank, None if none else j, -score)] += 1
    return out


def found(df):
    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("query_block,column", [(16_384, 262_144), (7, 40)])
def test_neighbours_equal_brute_force(spark, query_block, column):
    rng = np.random.default_rng(5)
    def vector(n=16):
        return [float(np.float32(x)) for x in rng.normal(size=n)]
    hot = vector()
    near = [[float(np.float32(x + 1e-4 * rng.normal())) for x in hot] for _ in range(60)]
    rows = [(i, vector()) for i in range(200)] + [(i, hot) for i in range(200, 300)] + [(300 + i, v) for i, v in enumerate(near)]
    rows += [(i, vector(3)) for i in range(400, 404)] + [(5, hot), (5, hot), (None, hot), (None, vector()), (10, None), (15, []), (20, [0.0] * 16)]
    rows += [(25, [None, *vector(15)]), (30, [float("nan"), *vector(15)]), (35, [float("inf"), *vector(15)]), (405, vector(700))]
    rows += [(500, [2 * x for x in hot]), (505, [float(np.float32(1e-30))] * 16), (510, [float(np.float32(1e30))] * 16)]
    got = found(vector_search.nearest(vectors(spark, rows), vector_search.every_nth(5), 5, query_block, column))
    assert got == plain_nearest(rows, 5)


def test_no_vectors_no_neighbours_and_wide_numbers(spark):
    assert vector_search.nearest(vectors(spark, []), vector_search.every_nth()).count() == 0
    rows = [(0, [1e300, -1e300]), (1, [3e-300, 1e-300]), (2, [1e300, -2e300])]
    got = found(vector_search.nearest(vectors(spark, rows, "double"), vector_search.every_nth(), 5))
    assert got == plain_nearest(rows, 50)


def test_int8_products_are_exact_and_bounds_hold():
    rng = np.random.default_rng(1)
    codes = rng.integers(-127, 128, (40, 3000)).astype(np.int8)
    parts = vector_search.products(codes[:20], codes[20:])
    whole = codes[:20].astype(np.int64) @ codes[20:].astype(np.int64).T
    assert np.abs(parts - whole).max() <= np.abs(whole).max() * 1e-6
    small = vector_search.products(codes[:20, :1024], codes[20:, :1024])
    assert (small == codes[:20, :1024].astype(np.int64) @ codes[20:, :1024].astype(np.int64).T).all()
    a, b = (vector_search.Quantised(rng.normal(size=(50, 64))) for _ in range(2))
    near = vector_search.products(a.code, b.code) * a.scale[:, None] * b.scale
    true = np.array([[vector_search.cosines(x[None], y[None])[0] for y in b.vectors] for x in a.vectors])
    assert (np.abs(near - true) <= (1 + a.error)[:, None] * b.error + a.error[:, None] + vector_search.SLACK).all()


# --- token alignment ---------------------------------------------------------------------------------------------------------

def plain_alignment(texts):
    """Groups and counts by sets of ends, with the vocabularies' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    letters = token_alignment.byte_letters()
    names = {k: v for v, k in a.get_vocab().items()}
    rows, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        ba = [bytes(letters[c] for c in names[k]) for k in ia]
        bb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ib]
        if not text or b"".join(ba) != whole or b"".join(bb) != whole:
            rows.append((0, 0, ""))
            links.append([])
            continue
        ea, eb = list(itertools.accumulate(map(len, ba))), list(itertools.accumulate(map(len, bb)))
        shared = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for end in shared:
            groups.append(",".join(str(k) for k, e in zip(ia, ea) if low < e <= end) + "|" + ",".join(str(k) for k, e in zip(ib, eb) if low < e <= end))
            low = end
        rows.append((len(ia), len(ib), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append([(ia[ea.index(e)], ib[eb.index(e)]) for e in shared])
    counts = Counter(x for row in links for x in row)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    return [(n_a, n_b, len(row), len(row), sum(counts[x] == highest[x[1]] for x in row), sum(counts[x] for x in row), digest)
            for (n_a, n_b, digest), row in zip(rows, links)]


TEXTS = [
    None, "", " ", "  two  spaces ", "Hello, world!", "Hello, world!", "hello\n\n\tworld  ", "naïve façade — Ωmega 漢字かな 한국어 🙂🙂 é",
    "<|endoftext|> <s> </s> <0x41> <unk>", "literal ▁ mark", "\u0085​ x y", "0123456789" * 30, "a" * 5000, " " * 4000, "\n" * 300 + "x",
    "don't can't WE'LL I'd'", "x\x00y", "The quick brown fox jumps over the lazy dog. " * 40, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ﬁ ①", "ǅ ƒ ɐ"]


@pytest.mark.parametrize("max_pairs", [token_alignment.MAX_PAIRS, 0])
def test_alignment_equals_brute_force(spark, max_pairs):
    rng = random.Random(2)
    parts = ["the", "ing", "Zürich", " ", "  ", "\n", ".", "42", "ß", "漢", "thorough", "'s", "co", "-"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    docs = spark.createDataFrame(
        [(i if i % 9 else None, t, *CLASH) for i, t in enumerate(texts)], "doc_id long, text string" + CLASHES)
    got = token_alignment.align_documents(docs, BYTE_BPE, PIECE_BPE, max_pairs).collect()
    want = Counter((i if i % 9 else None, *row) for i, row in enumerate(plain_alignment(texts)))
    assert Counter(tuple(r) for r in got) == Counter(
        (r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in want.elements())
    assert token_alignment.align_documents(docs.limit(0), BYTE_BPE, PIECE_BPE).count() == 0


def test_runs_cut_at_all_shared_ends():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randrange(1, 60)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randrange(1, n + 1))}) for _ in range(2))
        if rng.random() < 0.4:
            b = sorted({*a[:rng.randrange(len(a) + 1)], n})
        ends, i, j = [], 0, 0
        for i0, i1, j0, j1 in token_alignment.runs(a, b):
            assert (i0, j0) == (i, j)
            ends += a[i0:i1] if a[i0] == b[j0] else [a[i1 - 1]]
            assert a[i1 - 1] == b[j1 - 1]
            i, j = i1, j1
        assert (i, j) == (len(a), len(b)) and ends == sorted(set(a) & set(b))


def test_links_keep_wide_ids():
    links = np.array([[1, 70_000], [2, 65_536]], np.uint32)
    assert token_alignment.codes(token_alignment.pack(links)).tolist() == [1 << 32 | 2, 70_000 << 32 | 65_536]


# --- turn repair -------------------------------------------------------------------------------------------------------------

def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(turns):
    """All edit sequences, cheapest first, then by letters: (cost, audit, repaired turns)."""
    ways = {"": (0, [])}
    best = None
    options = [[("D", None)], [("K", "keep")], [("R", "user")], [("R", "assistant")]]
    inserts = [[], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")], [("assistant", ""), ("user", "")]]
    for edits in itertools.product(range(4), repeat=len(turns)):
        base, kept = 0, []
        for e, (role, text, fault) in zip(edits, turns):
            if fault in ("blank", "duplicate") and e != 0:
                break
            base += 2 if e == 0 else (1 if e > 1 else 0) + (5 if fault == "truncated" else 0)
            kept.append(None if e == 0 else (role if e == 1 else ("user", "assistant")[e - 2], text))
        else:
            if best and base > best[0]:
                continue
            for before in itertools.product(inserts, repeat=len(turns) + 1):
                cost = base + 5 * sum(map(len, before))
                if best and cost > best[0]:
                    continue
                audit, rows = "", []
                for k, extra in enumerate(before):
                    audit += "I" * len(extra)
                    rows += extra
                    if k < len(turns):
                        audit += "DKRR"[edits[k]]
                        rows += [kept[k]] if kept[k] else []
                if re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] or "-" for r in rows)) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, rows
    return best or (0, "", [])


def plain_repair(rows):
    """One result per conv_id, by brute force."""
    out, after = {}, damage(rows)
    for conv_id in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text in mine:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[1] for r in mine if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = Counter(t[2] for t in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, repaired = brute_repair(turns)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv_id] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], "conv_id long, turn long, role string, text string" + CLASHES)


def test_repair_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "umpire"]
    texts = ["Yes.", "No!", "cut", None, "", " \n", "Why? ", "done.\t", "é…", "same.", "same."]
    rows = []
    for conv_id in range(120):
        for turn in range(rng.randrange(1, 5)):
            rows.append((conv_id if conv_id % 40 else None, rng.choice([turn, turn, turn, 2 * turn, None]), rng.choice(roles), rng.choice(texts)))
    rows = [r for r in rows if r[0] is not None][:320] + [(None, k, "user", f"n{k}.") for k in range(3)]
    dropped = next(k for k in itertools.count(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    monkeypatch.setattr(turn_repair, "CHUNK_TURNS", 2)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_damaged(conversations(spark, rows)).collect()}
    want = plain_repair(rows)
    assert {k: (got[k], want[k]) for k in want if got.get(k) != want[k]} == {} and len(got) == len(want)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_repair.repair_damaged(conversations(spark, [])).count() == 0


def test_long_conversation_spreads_over_chunks(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"turn {k}." if k % 11 else "turn") for k in range(6000)]
    rows += [(8, 0, "user", "Hi."), (8, 1, "assistant", "x" * 3_000_000 + ".")]
    rng = random.Random(1)
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in turn_repair.repair_turns(conversations(spark, rows)).collect()}
    # 'turn' alone stands twice a role as a duplicate; every first one is truncated.
    turns = [("u" if k % 2 == 0 else "a", k % 11 == 0) for k in range(6000)]
    seen, word = set(), ""
    for role, cut in turns:
        fault = 0 if not cut else 2 if role in seen else 3
        seen |= {role} if cut else set()
        word += turn_repair.letter("sua?".index(role), fault)
    nodes = [turn_repair.LAST]
    for turn in reversed(word):
        nodes.append(turn_repair.node_before(turn, nodes[-1]))
    assert (got[7]["cost"], got[7]["audit"]) == (nodes[-1][0][0], turn_repair.best_audit(nodes[::-1]))
    assert (got[7]["gaps"], got[7]["truncated"], got[7]["duplicate"], got[7]["blank"]) == (0, 2, 544, 0)
    assert got[8]["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:" + b"x" * 3_000_000 + b".").hexdigest()


def test_words_share_suffixes_across_conversations(monkeypatch):
    import pyarrow as pa

    made = []
    node_before = turn_repair.node_before
    monkeypatch.setattr(turn_repair, "node_before", lambda turn, after: made.append(turn) or node_before(turn, after))
    words = sorted({"".join(p) for n in range(5) for p in itertools.product("aeim", repeat=n)}, key=lambda w: w[::-1])
    batch = pa.RecordBatch.from_arrays([pa.array(words)], ["word"])
    assert sum(b.num_rows for b in turn_repair.repaired_words(iter([batch]))) == len(words)
    # One node per different suffix; the words hold all of them.
    assert len(made) == len(words) - 1
