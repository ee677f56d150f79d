"""Operators that judge each row by itself or by small rules: fertility, licences, URL trie, preferences, edit matches."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest

from vacantia.llm import decontaminate, fertility, licenses, preferences, url_trie

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words int, kept string, spans string, _0 int"

TEXTS = [
    None, "", " \t\n", "a", "one two three four five six seven eight nine ten eleven",
    "rep eat ed wo rds " * 4, "x\u00a0y z\x1c\x85w \u2003 ünï ñ 日本語 💥", "# * $ % & | < > same\nsame\n same\n\nsame\nother line",
    "A longer line of plain words that nobody repeats here at all, with 12 numbers and MIT License text.\n" * 2, "q" * 5000,
    " ".join(f"w{i % 977}" for i in range(30_000)),
]


def documents(spark, texts, langs=("en", None, "xx")):
    rows = [(i, t, langs[i % len(langs)], "s", 7, "mine", "own", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- fertility ---------------------------------------------------------------------------------------------------------------

def plain_metrics(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, duplicates = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), duplicates, len(covered)


def test_fertility_counts_equal_the_definition(spark):
    docs = documents(spark, TEXTS + TEXTS[4:6])
    got = {r["doc_id"]: r for r in fertility.judge(docs, PIECE_BPE).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, text in enumerate(TEXTS + TEXTS[4:6]):
        r, want = got[i], plain_metrics(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_fertility_tokens_equal_those_of_each_word(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for r in fertility.judge(documents(spark, TEXTS), PIECE_BPE).collect():
        ids = [i for w in WORD.findall(TEXTS[r["doc_id"]] or "") for i in model.encode(w)]
        assert r["n_tokens"] == len(ids) and r["n_byte_tokens"] == sum(model.is_byte(i) for i in ids)
        if ids:
            shares = [n / len(ids) for n in Counter(ids).values()]
            assert r["token_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in shares))
            assert r["chars_per_token"] == pytest.approx(r["word_chars"] / len(ids))
        else:
            assert r["chars_per_token"] is None and not r["kept"]


def test_fertility_is_the_same_however_small_the_word_table(spark, monkeypatch):
    state = fertility.Fertility(PIECE_BPE)
    texts = [(t or "").encode() for t in TEXTS]
    want = state.measure_all(texts)
    small = fertility.Fertility(PIECE_BPE)
    small.table.limit = 3
    assert [small.measure_all([t])[0] for t in texts] == want


def test_fertility_keeps_clean_texts_and_all_columns(spark):
    good = "The committee will publish its annual report on regional water quality and explain how each figure was measured."
    bytes_only = "".join(chr(0x13000 + i) for i in range(60))
    docs = documents(spark, [good, " ".join([bytes_only] * 12), None])
    kept = fertility.kept_documents(docs, PIECE_BPE)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert fertility.judge(docs.limit(0), PIECE_BPE).count() == 0


def test_repeated_words_with_many_distinct_words():
    import numpy as np

    rng = random.Random(4)
    words = [rng.randrange(40_000) for _ in range(9_000)]
    words += words[100:140] + [40_001] + words[100:104]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    assert fertility.repeated_words(np.array(words)) == len(covered)


# --- licences ----------------------------------------------------------------------------------------------------------------

LICENSE_TEXTS = [
    None, "", "...", "mit license mit license", "Released under the MIT License.", "the gnu general public license gnu general public LICENSE",
    "cc by cc BY-NC 4.0", "ÄPACHE license apache-license Apache\u00a0license", "mit\u0130 license", "gnu gnu general public license",
    "x " * 50_000 + "apache license",
    "Permission is hereby granted, free of charge, to any fine person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute",
]


def test_base_places_equal_brute_force(spark):
    separate = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in licenses.scan_documents(documents(spark, LICENSE_TEXTS)).collect()}
    for i, text in enumerate(LICENSE_TEXTS):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = separate.findall(lowered)
        places = [(k, p) for label, phrase in licenses.BASE_PHRASES for k in [label] for p in range(len(words))
                  if words[p:p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((p for _, p in places), default=None)
        assert r["last_word"] == max((p for _, p in places), default=None)
        base = sorted({k for k, _ in places})
        assert r["base_labels"] == ",".join(base)
        assert set(base) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[11]["labels"] == "mit" and got[11]["n_base"] == 0 and 0.6 <= got[11]["score"] < 1
    assert got[6]["labels"] == "cc-by,cc-by-nc" and got[4]["labels"] == "mit"
    assert licenses.scan_documents(documents(spark, LICENSE_TEXTS).limit(0)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        templates = [[rng.choice(b"abc") for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = licenses.Automaton(templates)
        text = [rng.choice(b"abcd") for _ in range(30)]
        got = {place: length for place, _, length in automaton.stream(text)}
        held = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for end in range(len(text)):
            want = max((k for k in range(1, end + 2) if tuple(text[end + 1 - k:end + 1]) in held), default=0)
            assert got.get(end, 0) == want


# --- URL trie ----------------------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.net", "https://a.Example.NET/en/x?y#z", "x://example.net/enx", "ftp://example.com/de/", "http://org/fr/",
    "http://forg/fr/", "http://example.net:80/en/", "http://a.org/fr?x=/fr/", "http://b.net#/en/", "a://b://c.net/q", "http://.net/", "http://x.net./", "http://ÄB.net/\n/en/",
]
PAGES = "page_id long, url string, html string, rule string, host int, path int, verdict string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "r", 1, 2, "v") for i, u in enumerate(urls)], PAGES)


def by_definition(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
        if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


MORE_RULES = [
    *url_trie.RULES, ("net", "/en", "allow"), ("example.net", "/en", "block"), ("net", "", "block"), ("c.net", "/q", "allow"),
    ("c.net", "/q", "block"), (None, "/", "block"), ("", "/x", "block"), ("example.com", "/d", "allow"),
]


@pytest.mark.parametrize("rules", [list(url_trie.RULES), MORE_RULES, []])
@pytest.mark.parametrize("most", [10_000, -1])
def test_longest_rule_wins_by_trie_and_by_join(spark, rules, most):
    urls = URLS + URLS[4:8]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_trie.judge(pages(spark, urls), frame, max_rule_bytes=most).collect()}
    assert got == {i: by_definition(u, rules) for i, u in enumerate(urls)}
    assert url_trie.judge(pages(spark, urls).limit(0), frame, max_rule_bytes=most).count() == 0


# --- preferences -------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, turns string, pair_id int"


def plain_pairs(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {k: [t[2:] for t in sorted(v)] for k, v in convs.items()}
    place = {k: max((i for i, t in enumerate(v) if t[0] == "assistant"), default=None) for k, v in convs.items()}
    show = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    def spans(turns):
        at, out = 0, []
        for role, text in turns:
            head = len(f"<|{role}|>\n")
            if role == "assistant":
                out.append(f"{at + head}:{at + head + len(text) + 8}")
            at += head + len(text) + 8
        return ",".join(out)

    want = {}
    for k, turns in convs.items():
        p = place[k]
        chosen = turns if p is None else turns[:p + 1]
        other = None if k is None else k ^ 1
        rejected = turns if p is None else turns[:p]
        if p is not None and other is not None and other in convs and place[other] is not None:
            rejected = rejected + [convs[other][place[other]]]
        n = next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
        want[k] = (n, show(chosen[:n]), show(chosen[n:]), spans(chosen[n:]), show(rejected[n:]), spans(rejected[n:]))
    return want


def test_preference_pairs_equal_brute_force(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes 💥"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (0, 4, "user", "end"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (3, 0, "assistant", None), (4, None, None, None), (4, 1, "assistant", "x"),
        (5, 0, "user", "q"), (6, 0, "user", "same"), (6, 1, "assistant", "same"), (7, 0, "user", "z"), (7, 1, "assistant", "same"),
        (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "assistant", "tie"), (None, 0, "user", "n"), (None, 1, "assistant", "long " * 30_000),
    ]
    turns = spark.createDataFrame([(*r, "mine", 5) for r in rows], TURNS)
    got = {r["pair_id"]: tuple(r)[1:] for r in preferences.preference_rows(preferences.swapped_replies(turns)).collect()}
    assert got == plain_pairs(rows)
    assert preferences.preference_rows(preferences.swapped_replies(turns.limit(0))).count() == 0


def test_given_pairs_share_their_prompt_once(spark):
    u, a, b = ("user", "q"), ("assistant", "a"), ("assistant", "b")
    pairs = spark.createDataFrame(
        [(1, [u, a, u, a], [u, a, u, b]), (2, [u, a], [u, a]), (3, [u, a], [u, a, u]), (4, [], [u])],
        "pair_id int, chosen array<struct<role: string, text: string>>, rejected array<struct<role: string, text: string>>")
    rows = {r["pair_id"]: r for r in preferences.preference_rows(pairs).collect()}
    assert [rows[k]["n_common"] for k in (1, 2, 3, 4)] == [3, 2, 2, 0]
    assert rows[2]["chosen"] == rows[2]["rejected"] == "" and rows[3]["rejected"] == "<|user|>\nq<|end|>\n" and rows[3]["rejected_mask"] == ""


def test_preferences_run_no_python(spark):
    turns = spark.createDataFrame([(0, 0, "user", "hi", "", 1)], TURNS)
    plan = preferences.preference_rows(preferences.swapped_replies(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- edit matches ------------------------------------------------------------------------------------------------------------

def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_matches_equal_brute_force():
    rng = random.Random(7)
    letters = "ab c"
    for turn in range(250):
        item = decontaminate.folded("".join(rng.choice(letters) for _ in range(rng.randint(1, 70)))) or "a"
        rate = rng.choice([0.0, 0.1, 0.2])
        changed = list(item)
        for _ in range(rng.randint(0, int(len(item) * rate) + 2)):
            at = rng.randrange(len(changed) + 1)
            changed[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        text = decontaminate.folded("".join(rng.choice(letters) for _ in range(40)) + "".join(changed) + "".join(rng.choice(letters) for _ in range(40)))
        found = decontaminate.Matcher([(1, item)], rate).match(text)
        want = least_edits(item, text)
        assert bool(found) == (want <= int(len(item) * rate)), (turn, item, text)
        if found:
            _, edits, size, first, last = found[0]
            assert edits == want and size == len(item) and least_edits(item, text[first:last + 1]) == want


def test_leaks_go_and_clean_documents_stay(spark):
    item = "Which river flows through the old harbour town, and in what year was its stone bridge finished by the guild of masons?"
    near = item.replace("river", "rivr").replace("stone", "stome").upper()
    half = item[:60]
    texts = [f"before {item} after", f"x {near}\n\ny", f"only {half}", None, "", item, "w " * 60_000 + item, "nothing"]
    docs = documents(spark, texts)
    items = spark.createDataFrame([(1, item, 0), (2, item.lower(), 0), (3, "short", 0), (4, None, 0), (5, "", 0), (None, "n" * 50, 0)], "item_id long, text string, doc_id int")
    rows = decontaminate.find_items(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(d, i) for d in (0, 1, 5, 6) for i in (1, 2)]
    assert {r["edits"] for r in rows if r["doc_id"] == 1} == {2}
    assert (rows[0]["first_char"], rows[0]["last_char"]) == (7, 6 + len(item))
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 7]
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0 and decontaminate.clean_documents(docs, items.limit(0)).count() == len(texts)
    assert decontaminate.find_items(docs.limit(0), items).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} asks about the {i * i} apples and {i + 7} pears of the market") for i in range(30)], "item_id long, text string")
    docs = documents(spark, [r["text"] for r in items.collect()])
    whole = sorted(map(tuple, decontaminate.find_items(docs, items, rate=0.05).collect()))
    blocks = list(decontaminate.item_blocks(items, block_chars=150))
    assert len(blocks) > 5 and sum(map(len, blocks)) == 30
    monkeypatch.setattr(decontaminate, "item_blocks", lambda *_: iter(blocks))
    assert sorted(map(tuple, decontaminate.find_items(docs, items, rate=0.05).collect())) == whole


def test_short_items_match_whole_words_only(spark):
    items = spark.createDataFrame([(1, "Oslo"), (2, "two  and two?"), (3, "\u6771\u4eac"), (4, "Oslo"), (5, ""), (6, None)], "item_id long, text string")
    texts = ["In OSLO it rains", "oslofjord and Oslos", "Say: two and\ntwo? Four", "ltwo and two?", "\u5927\u6771\u4eac\u90fd", "", None]
    docs = documents(spark, texts)
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    found = sorted((r["doc_id"], r["item_id"], r["edits"], r["first_char"], r["last_char"]) for r in decontaminate.find_items(docs, items).collect())
    assert found == [(ids[0], 1, 0, 3, 6), (ids[0], 4, 0, 3, 6), (ids[2], 2, 0, 5, 16), (ids[4], 3, 0, 1, 2)]
    # Short items are reported, but no document goes for them unless the caller says so.
    assert decontaminate.clean_documents(docs, items).count() == len(texts)
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, items, min_chars=1).collect()) == [ids[k] for k in (1, 3, 5, 6)]
