"""Operators over whole tables: source mix, token files, near duplicates, shared passages, WARC bundles."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.llm import components, mixing, neardup, passages, shingles, token_files, warc_bundles

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, size int, h string, node int, b string, start int, seed string"


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source), with columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "h", 2, "b", 3, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, size=4000):
    return [f"{rng.choice('bcdfghklm')}{rng.randrange(size):x}" for _ in range(n)]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


# --- source mix --------------------------------------------------------------------------------------------------------------

def shares(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mix_meets_targets_and_equals_sorting(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 40, 400]))), rng.choice(["a", "b", "é", "Z", None, "tiny"] + ["hot"] * 6)) for i in range(700)]
    rows = [r for r in rows if r[2] != "tiny"] + [(9000, "one two", "tiny"), (9001, None, "empty"), (9002, "", "empty"), (None, "no id here", "a")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += size[r[0]]
    target = shares(total)
    source = {r[0]: r[2] for r in rows}
    taken, hashes = Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(target[s]) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows)
    for s in total:
        longest = max(size[i] for i in source if source[i] == s)
        assert abs(taken[s] - target[s]) <= longest
        # The copies are a function of the hash: the smallest hashes have the most.
        for i, text, src in rows:
            if src == s:
                key = f"{'' if i is None else i}:{text or ''}".encode()
                hashes[i] = int(hashlib.md5(key).hexdigest()[:15], 16)
        copies = [c for _, c in sorted((hashes[r["doc_id"]], r["copies"]) for r in got if source[r["doc_id"]] == s and r["size"])]
        assert copies == sorted(copies, reverse=True)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    assert Counter(r["doc_id"] for r in repeated.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_thresholds_are_nested_and_nearest(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.randrange(50), rng.randrange(1 << 60) if i % 9 else 77) for i in range(500)]
    sized = spark.createDataFrame(rows, "source string, size long, h long")
    budgets = [(s, k, b) for s in ("a", None) for k, b in enumerate([3.0, 100.0, 100.5, 2000.0])]
    got = {(r["source"], r["level"]): r["threshold"] for r in mixing.thresholds(sized, spark.createDataFrame(budgets, "source string, level int, budget double")).collect()}
    for s, k, budget in budgets:
        sums, best, total = Counter(), (budget, 0), 0
        for src, size, h in rows:
            if src == s:
                sums[h] += size
        for h in sorted(sums):
            total += sums[h]
            best = min(best, (abs(total - budget), total))
        assert sum(v for h, v in sums.items() if h <= got[s, k]) == best[1]
    assert all(got[s, k] <= got[s, k + 1] for s in ("a", None) for k in range(3))


def test_mix_of_nothing(spark):
    assert mixing.mix(documents(spark, []).limit(0)).count() == 0
    only_empty = mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r["size"], r["taken"]) for r in only_empty} == {(0, 0)}


# --- token files -------------------------------------------------------------------------------------------------------------

TOKEN_TEXTS = [
    None, "", "plain words here", "It's we're THE End. don't!! 3.14 a_b--c", "x<|endoftext|>y <|endoftext|>", "naïve Straße ÀÉ İstanbul ΣΊΣΥΦΟΣ Σ", "a\x1cb\x85c d e\x00f",
    "日本語 テキスト 한국어 ﬁ é 💥🏽", "tab\tline\nfeed\r\x0b\x0c", "w" * 3000, " ".join(f"word{i}" for i in range(20_000)), "x² ½ ٣ × ÷ ª", "\"quoted\" \"", "'s 'll a's",
]


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_round_trip(spark, folder):
    rows = [(100 - i, t) for i, t in enumerate(TOKEN_TEXTS)] + [(None, "no id"), (50, "same row"), (50, "same row"), (50, "other text")]
    docs = documents(spark, rows)
    out = f"{folder}/tokens"
    manifest = token_files.write_token_files(docs, out, WORD_BPE, end_id=1, length=64)
    got = token_files.read_documents(spark, out).collect()
    want = {r: ids + [1] for r, ids in zip([r[0] for r in rows], ids_of([r[1] for r in rows]))}
    assert len(got) == len(rows) and manifest.agg(F.sum("n_tokens")).first()[0] == sum(r["n_tokens"] for r in got)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] != 50:
            ids = want[r["doc_id"]]
            assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    # Sequences of one shard by random access: equal length, padding masked.
    for row in manifest.collect():
        shard = token_files.Shard(out, row["ids_path"])
        n = -(-row["n_tokens"] // 64)
        flat = np.concatenate([shard.sequence(i) for i in reversed(range(n))][::-1])
        mask = np.unpackbits(np.concatenate([shard.sequence(i, "mask") for i in range(n)]), bitorder="little")
        assert len(flat) == 64 * n and mask.sum() == row["n_tokens"] and mask[:row["n_tokens"]].all() and not flat[row["n_tokens"]:].any()


def test_token_files_of_nothing(spark, folder):
    assert token_files.write_token_files(documents(spark, []).limit(0), f"{folder}/none", WORD_BPE, 1).count() == 0
    assert token_files.read_documents(spark, f"{folder}/none").count() == 0


def test_word_encoder_equals_library_on_random_text(monkeypatch):
    rng = random.Random(5)
    letters = "abcXYZéßÑñÇ '’.,!?-_0123 \t\n ́İΣ字💥<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(600)]
    found = token_files.WordEncoder(WORD_BPE)
    monkeypatch.setattr(token_files, "MAX_PIECES", 50)
    encoded = [found.encode([t.encode()], 1)[0].tolist() for t in texts]
    assert encoded == [ids + [1] for ids in ids_of(texts)]
    ids, counts = found.encode([t.encode() for t in texts], 1)
    assert ids.tolist() == sum(encoded, []) and counts.tolist() == list(map(len, encoded))
    assert [x.tolist() for x in found.encode([b"a\xff b", b"", b" "], 1)] == [[*ids_of(["a\ufffd b"])[0], 1, 1, 1], [len(ids_of(["a\ufffd b"])[0]) + 1, 1, 1]]
    assert [x.tolist() for x in found.encode([b""], 1)] == [[1], [1]]


def test_other_vocabularies_take_the_whole_path():
    found = token_files.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert found.pieces is None and found.dtype == np.uint16
    words = ["don't", "naïve", "字", "Word"]
    assert found.encode([" ".join(words).encode()], 7)[0].tolist() == [
        *sum((found.tokenizer.encode(w, add_special_tokens=False).ids for w in words), []), 7]


# --- near duplicates ---------------------------------------------------------------------------------------------------------

def edited(rng, tokens, n):
    tokens = list(tokens)
    for _ in range(n):
        tokens[rng.randrange(len(tokens))] = f"new{rng.randrange(10 ** 6)}"
    return tokens


def plain_similarity(a, b):
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def near_corpus():
    rng = random.Random(11)
    rows, texts = [], {}

    def add(tokens, joiner=" "):
        texts[len(rows)] = tokens
        rows.append((len(rows), joiner.join(tokens)))

    for _ in range(60):
        base = words(rng, rng.choice([60, 150, 600]))
        add(base)
        for n in rng.choice([[], [1], [1, 2], [1, 1, 3, 8, 20]]):
            add(edited(rng, base, n))
    hot = words(rng, 200)
    for _ in range(60):
        add(edited(rng, hot, rng.randrange(3)))
    add(hot, "\n")
    for _ in range(5):
        add(hot)
    for _ in range(30):
        add(words(rng, 100))
    return rows, texts


def test_near_duplicates_equal_brute_force(spark):
    rows, texts = near_corpus()
    extra = [(9001, None), (9002, ""), (9003, "a b"), (9004, "A, b."), (9005, "!!"), (None, "a b"), (9006, "?"), (9003, "a b")]
    docs = documents(spark, rows + extra)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows) + len(extra)
    of = {r["doc_id"]: r["class_id"] for r in got}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            s = plain_similarity(texts[a], texts[b])
            if s >= 0.85:
                assert of[a] == of[b], (a, b, s)
    # Classes are no larger than what chains of fairly similar texts allow.
    near = defaultdict(set)
    for a in ids:
        for b in ids:
            if a < b and of[a] == of[b]:
                if plain_similarity(texts[a], texts[b]) >= 0.7:
                    near[a].add(b)
                    near[b].add(a)
    for a in ids:
        assert near[a] or sum(of[b] == of[a] for b in ids) == 1
    assert of[9001] == of[9002] == 9001 and of[9003] == of[9004] == 9003 and of[9005] == 9005 and of[9006] == 9006
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [9003]
    sizes = Counter(r["class_key"] for r in got)
    assert all(r["class_size"] == sizes[r["class_key"]] for r in got)


def test_near_copies_in_a_template_family_equal_brute_force(spark):
    rng = random.Random(17)
    template, rows = words(rng, 200), []
    for _ in range(120):
        own = words(rng, 36)
        rows += [(len(rows) + k, " ".join(template + own[:18] + words(rng, 18))) for k in range(2)]
    rows += [(len(rows) + k, " ".join(template + words(rng, 36))) for k in range(260)]
    docs = documents(spark, rows)
    weights = neardup.Weights(*neardup.shared_weights(docs).value)
    sets = []
    for _, text in rows:
        found, times, _ = shingles.shingle_sets([text.encode()])
        sets.append((found, np.exp(weights.logs(found, times))))
    of = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    near = [(a, b) for a in range(len(rows)) for b in range(a) if neardup.similarity(sets[a], sets[b]) >= neardup.THRESHOLD]
    assert len(near) >= 100 and [(a, b) for a, b in near if of[a] != of[b]] == []
    # No pair beside the planted ones is linked.
    assert len(set(of.values())) == len(rows) - len(near)


def test_recall_in_a_family_whose_template_is_nearly_similar(spark):
    # Members of the family are about 0.75 alike, the planted pairs 0.8 to 0.85 by weight: hardly more than the template.
    rng = random.Random(29)
    template, rows = words(rng, 300), []
    for _ in range(150):
        own = words(rng, 40)
        rows += [(len(rows) + k, " ".join(template + own[:18] + words(rng, 22))) for k in range(2)]
    rows += [(len(rows) + k, " ".join(template + words(rng, 40))) for k in range(500)]
    weights = neardup.Weights(*neardup.shared_weights(documents(spark, rows)).value)
    sets = []
    for _, text in rows:
        found, times, _ = shingles.shingle_sets([text.encode()])
        sets.append((found, np.exp(weights.logs(found, times))))
    near = [(a, b) for a in range(300) for b in range(a) if neardup.THRESHOLD <= neardup.similarity(sets[a], sets[b]) < 0.85]
    of = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, rows)).collect()}
    found = sum(of[a] == of[b] for a, b in near)
    assert len(near) >= 100 and found >= 0.95 * len(near), (found, len(near))


def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch):
    # A family whose members nearly look alike, in blocks smaller than its buckets: whichever text is a centre, no pair may be left out.
    monkeypatch.setattr(neardup, "BLOCK", 60, raising=False)
    rng = random.Random(31)
    template, rows = words(rng, 300), []
    for _ in range(2):
        own = words(rng, 28)
        rows += [(len(rows) + k, " ".join(template + own[:6] + words(rng, 25))) for k in range(2)]
    rows += [(len(rows) + k, " ".join(template + words(rng, 31))) for k in range(900)]
    docs = documents(spark, rows)
    weights = neardup.Weights(*neardup.shared_weights(docs).value)
    found, times, begins = shingles.shingle_sets([text.encode() for _, text in rows])
    logs = weights.logs(found, times)
    sets = [(found[a:b], np.exp(logs[a:b])) for a, b in zip(begins[:-1], begins[1:])]
    bands = neardup.band_keys(neardup.draw(found, logs, begins))
    near = [(a, b) for a in range(4) for b in range(a) if (bands[a] == bands[b]).any() and neardup.similarity(sets[a], sets[b]) >= neardup.THRESHOLD]
    of = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert near == [(k + 1, k) for k in range(0, 4, 2)] and [(a, b) for a, b in near if of[a] != of[b]] == []
    assert len(set(of.values())) == 2 + 900


def test_links_of_a_cell_equal_all_pairs():
    rng = random.Random(37)
    base = [words(rng, 20) * 3 + words(rng, size) for size in (40, 60)]
    texts = [" ".join(edited(rng, base[k % 2], rng.randrange(12))).encode() for k in range(60)]
    found, times, begins = shingles.shingle_sets(texts)
    values = np.exp(neardup.Weights(np.unique(found)[::7], np.full(len(np.unique(found)[::7]), 0.6)).logs(found, times))
    assert (times > 1).any()
    cell = [(found[a:b], times[a:b], values[a:b], k, k) for k, (a, b) in enumerate(zip(begins[:-1], begins[1:]))]
    pairs = lambda i, j: neardup.similarity((cell[i][0], cell[i][2]), (cell[j][0], cell[j][2]))
    shared = neardup.shared_weight(cell, 25)
    for i in range(25):
        for j in range(60):
            total = cell[i][2].sum() + cell[j][2].sum() - shared[i, j]
            assert i == j or abs(shared[i, j] / total - pairs(i, j)) < neardup.SLACK / 10
    for own in (True, False):
        near = [(i, j) for i in range(25) for j in range(60) if (j >= 25 or own and j > i) and pairs(i, j) >= neardup.THRESHOLD]
        root = list(range(60))
        for a, b, s in neardup.cell_links(cell, 25, own, neardup.THRESHOLD):
            assert s == pairs(b, a) or s == pairs(a, b)
            root = [root[a] if r == root[b] else r for r in root]
        assert near and all(root[i] == root[j] for i, j in near)
        # Texts of one group are not compared.
        assert neardup.cell_links([(*t[:4], 0) for t in cell], 25, own, neardup.THRESHOLD) == []


def test_stages_keep_columns_of_any_name(spark):
    names = ["_h", "_copy", "_copies", "_node", "stay_id", "stay_rows", "key_id", "doc", "h", "of", "levels", "n", "a.b", "x`y", "copy"]
    rows = [(1, "one two three four five six seven", "s"), (2, "one two three four five six seven", "s"), (3, None, None), (None, "", "t"), (3, None, None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", "source", *names])
    full = Counter((*r, *range(len(names))) for r in rows)
    for out in (neardup.one_per_class(docs), mixing.mixed_documents(docs)):
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and got and set(got) <= set(full)
    assert sorted(str(r["doc_id"]) for r in neardup.one_per_class(docs).collect()) == ["1", "3"]


def test_one_document_of_each_class_stays(spark):
    base = "the quick survey of coastal birds was repeated in each of the nine following winters by volunteers".split()
    rows = [(5, " ".join(base)), (3, " ".join(base)), (3, " ".join(base)), (4, " ".join(base).upper()), (None, "null id text"), (None, "null id text"), (None, "another"), (8, None), (9, ""), (10, "own text")]
    docs = documents(spark, rows)
    kept = neardup.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(3, " ".join(base)), (None, "null id text"), (None, "another"), (8, None), (10, "own text")], key=str)
    assert neardup.one_per_class(docs.limit(0)).count() == 0


def test_draws_agree_as_often_as_texts_are_similar():
    rng = random.Random(2)
    weights = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0))
    errors = []
    for n in (0, 2, 5, 10, 30):
        for _ in range(12):
            base = words(rng, 200) + ["again"] * 30
            pair = [" ".join(t).encode() for t in (base, edited(rng, base, n))]
            found, times, begins = shingles.shingle_sets(pair)
            logs = weights.logs(found, times)
            draws = neardup.draw(found, logs, begins)
            a, b = ((found[x:y], np.exp(logs[x:y])) for x, y in zip(begins, begins[1:]))
            errors.append((draws[0] == draws[1]).mean() - neardup.similarity(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_common_shingles_are_exact(spark):
    rng = random.Random(6)
    common = "this site uses cookies to give you the best experience".split()
    rows = [(i, " ".join(words(rng, 12) + (common if i % 3 == 0 else []) + words(rng, 9))) for i in range(900)]
    docs = documents(spark, rows).repartition(5)
    want = Counter()
    for _, text in rows:
        want.update(shingles.shingle_sets([text.encode()])[0].view(np.int64).tolist())
    want = {s: n for s, n in want.items() if n >= 9}
    assert len(want) == len(common) - 4
    for most in (10 ** 6, 0):
        got = {r["shingle"]: r["df"] for r in neardup.common_shingles(docs, 900, 0.01, max_candidates=most).collect()}
        assert got == want


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(9)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(500, k) for k in range(501, 700)] + [(1, 2), (2, 3), (3, 1), (7, 7), (2, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in path}, **{k: 500 for k in range(500, 700)}, 1: 1, 2: 1, 3: 1}


# --- shared passages ---------------------------------------------------------------------------------------------------------

def test_shared_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(21)
    passage, hot, long = words(rng, 60), words(rng, 55), words(rng, 400)
    rows, planted = [], defaultdict(list)

    def add(name, tokens):
        if name:
            planted[name].append(len(rows))
        rows.append((len(rows), " ".join(tokens)))

    for _ in range(3):
        add("exact", words(rng, rng.randrange(80)) + passage + words(rng, rng.randrange(80)))
    fuzzy = words(rng, 120)
    for n in (0, 3, 5):
        add("fuzzy", words(rng, 30) + edited(rng, fuzzy, n) + words(rng, 30))
    for _ in range(150):
        add("hot", words(rng, rng.randrange(30)) + hot + words(rng, rng.randrange(30)))
    add("parts", long)
    add("parts", words(rng, 20) + long[:200] + words(rng, 40) + long[250:] + words(rng, 20))
    add("order", a := words(rng, 70) + words(rng, 70))
    add("order", a[70:] + words(rng, 10) + a[:70])
    clean = len(rows)
    for _ in range(40):
        add(None, words(rng, 150))
    add(None, passage[:25] + words(rng, 60))
    copies = len(rows)
    for _ in range(4):
        add(None, rows[clean][1].split())
    rows += [(9000, None), (9001, ""), (9002, "short copy"), (9003, "short copy"), (0, rows[0][1]), (None, rows[clean + 1][1])]
    got = passages.shared_passages(documents(spark, rows)).collect()
    links = defaultdict(set)
    for r in got:
        links[r["doc_id"]].add(r["other_id"])
        links[r["other_id"]].add(r["doc_id"])

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        return seen

    for name, ids in planted.items():
        assert set(ids) <= reach(ids[0]), name
    # Links grow with the documents of a passage, not with their pairs.
    assert len([r for r in got if r["kind"] == "passage"]) < 2 * 160
    text = dict(rows[::-1])
    separate = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in got:
        a, b = (separate.findall(text[r[i]].lower()) for i in ("doc_id", "other_id") if r[i] is not None) if r["doc_id"] is not None else ([], [])
        if r["kind"] == "passage" and a:
            x, y = a[r["first_word"]:r["last_word"] + 1], b[r["other_first_word"]:r["other_last_word"] + 1]
            assert min(len(x), len(y)) >= 50 and len(set(x) & set(y)) >= 0.75 * len(set(x))
    for r in got:
        if r["doc_id"] in planted["exact"] and r["other_id"] in planted["exact"]:
            assert r["last_word"] - r["first_word"] + 1 == 60 and r["identity"] == 1.0
    assert sum(r["n_same"] for r in got if {r["doc_id"], r["other_id"]} == set(planted["order"])) == 140
    parts = [r for r in got if {r["doc_id"], r["other_id"]} == set(planted["parts"])]
    assert sum(r["n_same"] for r in parts) == 350
    touched = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert {k for k in touched if k is not None and clean <= k < copies} == {clean, clean + 1} and not touched & {9000, 9001, 9002, 9003}
    assert sorted(r["doc_id"] for r in got if r["kind"] == "copy" and r["other_id"] == clean) == list(range(copies, copies + 4))
    assert [r["other_id"] for r in got if r["doc_id"] is None] == [clean + 1]
    assert passages.shared_passages(documents(spark, []).limit(0)).count() == 0


def passage_cover(got, a, b):
    """Words of the longest passage row of two documents."""
    return max((min(r["last_word"] - r["first_word"], r["other_last_word"] - r["other_first_word"]) + 1 for r in got if {r["doc_id"], r["other_id"]} == {a, b}), default=0)


def test_passages_of_frequent_parts(spark):
    rng = random.Random(31)
    rows, parts = [], []
    for sizes in [(30, 30), (40, 10), (25, 25), (20, 20, 20), (49, 30)] * 3:
        pieces = [words(rng, n) for n in sizes]
        parts.append((len(rows), sum(sizes)))
        rows += [(len(rows) + k, " ".join(words(rng, 40) + sum(pieces, []) + words(rng, 40))) for k in range(2)]
        for piece in pieces:
            rows += [(len(rows) + k, " ".join(words(rng, 30) + piece + words(rng, 30))) for k in range(12)]
    got = passages.shared_passages(documents(spark, rows)).collect()
    assert {a: (n, passage_cover(got, a, a + 1)) for a, n in parts if passage_cover(got, a, a + 1) != n} == {}


def test_passages_of_repeated_lines(spark):
    rng = random.Random(37)
    rows, lines = [], []
    for period in range(2, 21, 3):
        line = words(rng, period)
        for size in (60, 200):
            times = -(-size // period)
            lines.append((len(rows), times * period))
            rows += [(len(rows) + k, " ".join(words(rng, 40) + line * times + words(rng, 40))) for k in range(2)]
            line = words(rng, period)
    got = passages.shared_passages(documents(spark, rows)).collect()
    assert {a: (n, passage_cover(got, a, a + 1)) for a, n in lines if passage_cover(got, a, a + 1) < n} == {}


def test_rows_of_repeated_runs_do_not_grow_with_the_repeats(spark, monkeypatch):
    rng = random.Random(43)
    line = words(rng, 2)
    rows = [(k, " ".join(words(rng, 20) + line * (150 + 10 * k) + words(rng, 20))) for k in range(6)]
    counts, run_matches = [], passages._run_matches

    def counted(*given):
        matches = run_matches(*given)
        counts.append(matches.count())
        return matches

    monkeypatch.setattr(passages, "_run_matches", counted)
    got = passages.shared_passages(documents(spark, rows)).collect()
    # Two runs of at most four blocks in each of five texts, and not one row a place.
    assert 10 <= counts[0] <= 40
    holder = {r["other_id"] for r in got}
    assert len(holder) == 1 and {r["doc_id"] for r in got} == set(range(6)) - holder
    assert all(passage_cover(got, k, *holder) >= 300 + 20 * k for k in range(6) if k not in holder)


def test_whole_idf_tells_texts_that_share_a_template_apart(spark):
    shares, n = np.array([0.001, 0.01, 0.03, 0.1, 0.3, 0.7]), 100_000
    got = neardup.idf(shares * n, n, least=neardup.WHOLE_IDF)
    assert got[0] == got[1] == 1 and (np.diff(got[1:]) < 0).all() and got[-1] < 0.1
    rng = random.Random(53)
    template = words(rng, 400)
    rows = [(k, " ".join(template + words(rng, 20))) for k in range(120)] + [(200 + k, " ".join(words(rng, 60))) for k in range(60)]
    rows += [(300, rows[0][1] + " end"), (301, rows[130][1] + " end")]
    classes = lambda least: {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, rows), least_idf=least).collect()}
    plain, whole = classes(neardup.LEAST_IDF), classes(neardup.WHOLE_IDF)
    assert len({plain[k] for k in range(120)}) == 1 and len({whole[k] for k in range(120)}) == 120
    assert whole[300] == whole[0] and whole[301] == whole[rows[130][0]]


def test_passages_with_a_single_seed_are_aligned(spark):
    rng = random.Random(47)
    rows = []
    for size, edits in ((60, 6), (100, 15)) * 25:
        passage = words(rng, size)
        other = passage[:]
        for at in rng.sample(range(5, size - 5), edits):
            other[at] = words(rng, 1)[0]
        rows += [(len(rows) + k, " ".join(words(rng, 60) + p + words(rng, 60))) for k, p in enumerate((passage, other))]
    # Texts that share a seed's words only.
    seed = words(rng, 12)
    rows += [(len(rows) + k, " ".join(words(rng, 60) + seed + words(rng, 60))) for k in range(20)]
    got = passages.shared_passages(documents(spark, rows)).collect()
    assert all(r["identity"] >= passages.MIN_IDENTITY and {r["doc_id"] // 2, r["other_id"] // 2} == {r["doc_id"] // 2} for r in got)
    found = {r["doc_id"] // 2 for r in got}
    assert not any(k >= 50 for k in found) and len(found) >= 43, len(found)


def test_runs_of_many_texts_are_found_together():
    rng = random.Random(59)
    line = words(rng, 3)
    texts = [words(rng, rng.choice([1, 5, 49, 50, 51, 120, 300])) for _ in range(200)]
    texts += [line * 60, words(rng, 20) + line * 30 + words(rng, 70), line[:1] * 90, texts[7] + texts[8], ["\u00e9\u4e2d"] * 3 + words(rng, 80)]
    seeds, places, begins, _ = passages.text_seeds([" ".join(t).encode() for t in texts])
    rows = []
    for k, text in enumerate(texts):
        at = [p & 0xFFFFFFFF for p in places[begins[k]:begins[k + 1]].tolist() if k % 2 or rng.random() < 0.9]
        rows.append((k, " ".join(text), rng.sample(at, len(at)) + at[:1]))
    rows = [r for r in rows if r[2]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.list_(pa.int64())))], ["node", "text", "covers"])
    found = lambda b: [x.to_pylist() for x in passages._run_batches(iter([b]))]
    together = found(batch)
    # One batch a slice of texts, not one a text.
    assert len(together) == 1
    assert together[0] == [r for k in range(len(rows)) for r in found(batch.slice(k, 1))[0]]
    for got, (k, text, covers) in zip(together[0], rows):
        length, windows = len(texts[k]), passages.MIN_WORDS - passages.K - passages.WINDOW + 2
        bare = [not any(a <= c < a + passages.WINDOW for c in covers) for a in range(length)]
        expected = [a for a in range(length - passages.MIN_WORDS + 1) if not any(bare[a:a + windows]) and len(set(texts[k][a:a + passages.MIN_WORDS])) > 1]
        again = [i["place"] for r in got["again"] for i in r["items"]]
        assert sorted(p & 0xFFFFFFFF for p in got["places"] + again) == expected
        assert all(len(text.encode()[:p >> 32].split()) == p & 0xFFFFFFFF for p in got["places"] + again)
        assert all(len(r["items"]) > 1 and r["items"] == sorted(r["items"], key=lambda i: i["place"]) for r in got["again"])
        assert [s["place"] & 0xFFFFFFFF for s in got["seeds"]] == sorted(set(covers))


def test_chains_of_many_pairs_are_those_of_each_pair():
    rng = random.Random(61)
    rows, expected = [], []
    for node in range(300):
        n, step = rng.choice([1, 1, 2, 5, 12]), rng.choice([3, 20, 50, 90])
        x, y = (np.cumsum([rng.randint(1, step) for _ in range(n)]) for _ in range(2))
        if node % 3 == 0:
            y = np.array(rng.sample(y.tolist(), n))
        alike = [rng.random() < 0.2 for _ in range(n)]
        pair = [(node, node // 2 - 500, int(a) << 32 | int(a), int(b) << 32 | int(b), 0, 0, c, []) for a, b, c in zip(x, y, alike)]
        rows += rng.sample(pair, n)
        expected += [
            (node, x[c].tolist(), y[c].tolist()) for c in passages.chains(x, y)
            if len(c) >= passages.MIN_SEEDS and x[c[-1]] - x[c[0]] + passages.K >= passages.MIN_CHAIN or any(alike[k] for k in c)]
    repeat = pa.struct([("place", pa.int64()), ("other_place", pa.int64()), ("width", pa.int32()), ("other_width", pa.int32())])
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.list_(repeat)]
    names = [c.split()[0] for c in passages.MATCH.split(", ")] + ["repeats"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    got = [r for size in (7, len(rows)) for b in passages._chain_batches(iter(pa.Table.from_batches([batch]).to_batches(max_chunksize=size))) for r in b.to_pylist()]
    assert len(expected) > 100
    assert [(r["node"], r["x"], r["y"]) for r in got] == expected * 2
    assert all((r["x_first"], r["x_last"], r["y_first"], r["y_last"]) == (r["x"][0], r["x"][-1], r["y"][0], r["y"][-1]) for r in got)


def test_sides_of_a_seed():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    bits = lambda part: int(np.bitwise_or.reduce(np.uint64(1) << (part & np.uint64(63)))) if len(part) else 0
    at = np.array([0, 5, 100, 194])
    before, behind = passages.sides(values, at)
    for k, word in enumerate(at.tolist()):
        assert int(before[k]) == bits(values[max(0, word - passages.SIDE):word])
        assert int(behind[k]) == bits(values[word + passages.K:word + passages.K + passages.SIDE])


def test_passages_of_long_words(spark):
    rng = random.Random(41)
    clause = lambda n: ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(33)) for _ in range(n)]
    rows, planted = [], []
    for size in (50, 55, 60, 80) * 4:
        passage = clause(size)
        planted.append((len(rows), size))
        rows += [(len(rows) + k, " ".join(clause(40) + passage + clause(40))) for k in range(2)]
    got = passages.shared_passages(documents(spark, rows)).collect()
    assert {a: (n, passage_cover(got, a, a + 1)) for a, n in planted if passage_cover(got, a, a + 1) != n} == {}
    text = " ".join(clause(300)).encode()
    first, last = 100 * 100, 150 * 100
    a, b = passages.sliced_around(text, first, last)
    assert len(text[a:first].split()) >= passages.REACH and len(text[last:b].split()) >= passages.REACH + passages.K


def test_common_runs_share_a_seed():
    rng = random.Random(1)
    for _ in range(200):
        run = words(rng, passages.K + passages.WINDOW - 1)
        texts = [" ".join(words(rng, rng.randrange(40)) + run + words(rng, rng.randrange(40))).encode() for _ in range(2)]
        seeds, places, begins, lengths = passages.text_seeds(texts)
        assert set(seeds[:begins[1]]) & set(seeds[begins[1]:]) and list(lengths) == [len(t.split()) for t in texts]
        for k, text in enumerate(texts):
            assert all(len(text[:p >> 32].split()) == p & 0xFFFFFFFF for p in places[begins[k]:begins[k + 1]].tolist())


def test_chains_have_the_best_score():
    rng = random.Random(4)

    def score(chain, x, y):
        return sum(passages.GAIN for _ in chain) - sum(passages.GAP_COST * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(chain, chain[1:]))

    for _ in range(60):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(2, 9))})
        x, y = (np.array(v) for v in zip(*points))
        best = 0
        for bits in range(1, 1 << len(points)):
            chain = [i for i in range(len(points)) if bits >> i & 1]
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:])):
                best = max(best, score(chain, x, y))
        found = passages.chains(x, y)
        assert score(found[0], x, y) == pytest.approx(best) and sorted(i for c in found for i in c) == list(range(len(points)))


def test_common_subsequences():
    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
        assert passages.agreeing(a, b) == table[-1][-1]


# --- WARC bundles ------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, salt int, frame int, bundle string"


def test_warc_round_trip(spark, folder, monkeypatch):
    big, other = "<p>ü</p>" * 200, "x" * 1000
    rows = [
        (1, "http://a/", big), (7, None, big), (3, "http://b/\r\nX: y ü%20", big), (4, "u", other), (5, "u", "x" * 999), (6, "u", "x" * 999), (8, "u", None), (9, "u", ""),
        (10, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "n", big), (None, "m", None), (11, "l", "long " * 400_000), (12, "r", other), (12, "r", other), (2, "u", "A" * 1200),
    ] + [(100 + k, "hot", "hot" * 400) for k in range(80)]
    pages = spark.createDataFrame([(*r, "d", 1, 2, "b") for r in rows], PAGES)
    monkeypatch.setattr(warc_bundles, "FRAME_BYTES", 3000)
    out = f"{folder}/warc"
    index = warc_bundles.write_bundles(pages, out)
    got = warc_bundles.read_records(index, out).collect()
    last = {}
    for page_id, _, html in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, page_id), page_id)
    want = Counter()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        top = last.get(html) if len(raw) >= 1000 else None
        revisit = top is not None and top != page_id
        want[page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["url"] for r in got if r["page_id"] in (3, 7)} == {"http://b/%0D%0AX:%20y%20%C3%BC%20".replace("%20y", "%20y"), None}
    one = warc_bundles.read_records(warc_bundles.read_index(spark, out).where("page_id = 11"), out).collect()
    assert [r["payload_bytes"] for r in one] == [2_000_000]
    # Any Zstandard reader unpacks a bundle: the seek table is a skippable frame.
    import io

    import zstandard
    system, base = warc_bundles.open_folder(out)
    name = one[0]["bundle"]
    with system.open_input_file(f"{base}/{name}") as f:
        raw = f.read()
        frames = warc_bundles.BundleReader(f).frames
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert len(whole) == sum(u for _, _, u in frames) and whole.count(b"WARC-Record-ID") == sum(r["bundle"] == name for r in got)


def test_warc_of_nothing(spark, folder):
    pages = spark.createDataFrame([(1, "u", "x", "d", 1, 2, "b")], PAGES).limit(0)
    assert warc_bundles.read_records(warc_bundles.write_bundles(pages, f"{folder}/w"), f"{folder}/w").count() == 0
