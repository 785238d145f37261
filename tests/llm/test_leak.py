import random

import numpy as np
import pandas as pd
import pytest

from pitchweave.llm.leak import SEED, SHARD, Evaluation, FMIndex, Words, _shards, find_leaks, leaks, same_word

WORDS = [a + b + c for a in ("kel", "mor", "tan", "vis", "dru", "pel") for b in ("ba", "nor", "sit", "ul") for c in ("ene", "ic", "ose", "stead", "ing")]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def lines(text, width=30):
    out, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            room = width - len(line) - 2
            if room > 2 and len(word) > room + 2:
                out.append(f"{line} {word[:room]}-")
                word = word[room:]
            else:
                out.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return out + [line]


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 3000).astype(np.uint8)
    patterns = np.array([text[i : i + SEED] for i in range(0, 500, 37)] + [[30] * SEED], np.uint8)
    at, position = FMIndex(text).search(patterns)
    for p, pattern in enumerate(patterns):
        want = [i for i in range(len(text) - SEED + 1) if (text[i : i + SEED] == pattern).all()]
        assert sorted(position[at == p].tolist()) == want


def test_words_keep_lines_and_texts():
    w = Words.of(["The old—mill\nhouse auc- \ntion. ¬", "", "Z1"])
    s = w.strings()
    assert [s[a:b] for a, b in zip(w.first, w.first[1:])] == ["the", "old", "mlll", "house", "auc", "tlon", "zl"]
    assert w.text.tolist() == [0, 0, 0, 0, 0, 0, 2] and w.broken.tolist() == [False] * 4 + [True, False, False]


def test_misread_words():
    assert same_word("roacl", "road") and same_word("modem", "modern") and same_word("vvlll", "wlll") and same_word("presented", "presenfed")
    assert not same_word("sald", "provlded") and not same_word("the", "of") and same_word("a", "4") and not same_word("formen", "horlzontal")


def evaluation(items, least=12):
    return Evaluation(items, least)


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_quotes_over_breaks_columns_and_adverts(columns):
    rnd = random.Random(columns)
    items = [(i, sentence(rnd, 60)) for i in range(30)]
    texts, want = [], set()
    for d in range(60):
        item, passage = rnd.choice(items)
        n = rnd.choice([8, 10, 13, 20, 40])
        start = rnd.randrange(0, 60 - n)
        quote = " ".join(passage.split()[start : start + n])
        if d % 4 == 1:
            quote = quote.upper()
        if n > 12 and d % 4 == 2:
            quote = quote.replace("m", "rn", 1)
        stories = [lines(sentence(rnd, 20) + " " + (quote if c == 0 else sentence(rnd, n)) + " " + sentence(rnd, 25)) for c in range(columns)]
        page = []
        for row in range(max(map(len, stories))):
            page += [s[row] for s in stories if row < len(s)]
            if rnd.random() < 0.1:
                page.append("WANTED, a strong lad. Apply within.")
        texts.append("\n".join(page))
        if n >= 12:
            want.add((d, item))
    found = {(t, i) for t, i, *_ in leaks(texts, evaluation(items))}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 1


def test_shorter_exchanged_and_reordered_words_are_no_case():
    rnd = random.Random(9)
    words = sentence(rnd, 60).split()
    e = evaluation([(7, " ".join(words))])
    exchanged = [w if i % 9 else "certain" for i, w in enumerate(words)]
    shuffled = words[:]
    rnd.shuffle(shuffled)
    texts = [" ".join(words[5:16]), " ".join(words[5:17]), " ".join(exchanged), " ".join(shuffled), " ".join(words[20:30] + words[:10]), ""]
    out = leaks(texts, e)
    assert [(t, i, n) for t, i, n, *_ in out] == [(1, 7, 12)]


def test_a_table_with_nulls_repeats_and_long_texts(spark):
    rnd = random.Random(3)
    passage = sentence(rnd, 40)
    filler = "\n".join(sentence(rnd, 6) for _ in range(400))
    docs = [(1, f"{filler}\n{passage}\n{filler}", "x"), (1, f"{filler}\n{passage}\n{filler}", "x"), (2, None, "x"), (3, "", "x"), (4, " \n ", "x"), (5, filler, "x")]
    items = [(10, passage, None, 1), (11, None, None, 1), (12, "too short", "", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, words string")
    e = spark.createDataFrame(items, "item_id long, passage string, question string, i int")
    out = find_leaks(d, e).collect()
    assert [(r.doc_id, r.item_id, r.words) for r in out] == [(1, 10, 40)] and out[0].first_line == out[0].last_line == 400
    assert find_leaks(d, e, items_at_once=1).count() == 1
    assert find_leaks(d.limit(0), e).count() == 0 and find_leaks(d, e.limit(0)).count() == 0


def test_a_long_text_after_a_nearly_full_shard_loses_nothing():
    rng, rnd = np.random.default_rng(5), random.Random(5)

    def filler(n):
        out = rng.integers(97, 123, n).astype(np.uint8)
        out[7::8], out[79::80] = 32, 10
        return out.tobytes().decode()

    items = [(i, sentence(rnd, 20)) for i in range(3)]
    n = SHARD // 4 - 100
    pages = [filler(n) + "\n" + items[0][1], filler(n), filler(n), filler(n - 1000) + "\n" + items[1][1], filler(2_000_000) + "\n" + items[2][1]]
    shards = list(_shards(iter([pd.DataFrame({"d": range(5), "t": pages})])))
    assert [d for ids, *_ in shards for d in ids] == list(range(5)) and all(len("\n".join(p)) < SHARD for *_, p in shards)
    found = [(ids[t], i) for ids, _, p in shards for t, i, *_ in leaks(p, evaluation(items))]
    assert sorted(found) == [(0, 0), (3, 1), (4, 2)]


@pytest.mark.parametrize("size", [SHARD - 2, SHARD - 1, SHARD, SHARD + 1])
def test_shards_stay_below_their_size(size):
    shards = list(_shards(iter([pd.DataFrame({"d": [1, 2, 3, 4], "t": ["", "a" * size, "b", ""]})])))
    assert all(len("\n".join(p)) < SHARD for *_, p in shards)
    assert [d for ids, *_ in shards for d in dict.fromkeys(ids)] in ([1, 2, 3, 4], [1, 2, 2, 3, 4])
    FMIndex(Words.of(["a" * (SHARD - 1)]).letters)
    with pytest.raises(AssertionError):
        FMIndex(np.ones(SHARD, np.uint8))


def test_long_texts_of_one_partition_and_lines_far_down(spark):
    rng, rnd = np.random.default_rng(6), random.Random(6)

    def filler(n, width=70):
        out = rng.integers(97, 123, n).astype(np.uint8)
        out[7::8], out[width - 1 :: width] = 32, 10
        return out.tobytes().decode()

    passage = sentence(rnd, 20)
    body = filler(7_000_000)
    split = body.split("\n")
    deep = "\n".join(["", *split[:99_999], passage, *split[99_999:]])
    docs = [(1, filler(2_800_000) + passage), (2, passage + "\n" + filler(3_500_000)), (3, deep)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    e = spark.createDataFrame([(10, passage, "")], "item_id long, passage string, question string")
    out = {r.doc_id: r for r in find_leaks(d, e).collect()}
    assert set(out) == {1, 2, 3} and out[2].first_line == 0
    assert deep.split("\n")[out[3].first_line : out[3].last_line + 1] == [passage] and out[3].first_line == 100_000


def test_short_words_of_the_items_are_themselves():
    words = frozenset(["on", "ln", "he", "hls", "has", "the", "corbalte", "clabalte"])
    assert not same_word("corbalte", "clabalte", words) and not same_word("lorulene", "brllmene")
    assert not same_word("on", "ln", words) and not same_word("has", "hls", words) and same_word("tbe", "the", words) and same_word("lm", "ln", words)
    rnd = random.Random(12)
    passage = sentence(rnd, 5) + " in " + sentence(rnd, 8) + " on " + sentence(rnd, 6)
    assert leaks([passage.replace(" in ", " on ", 1).replace(sentence(rnd, 1), "")], evaluation([(1, passage)])) != []
    words = passage.split()
    other = words[:5] + ["on"] + words[6:13]  # eleven words at most in a row
    assert leaks([" ".join(other)], evaluation([(1, passage)])) == []


def test_parts_of_the_items_share_an_index(spark, monkeypatch):
    from pitchweave.llm import leak

    rnd = random.Random(13)
    items = [(i, sentence(rnd, 14), None) for i in range(12)]
    docs = [(i, f"{sentence(rnd, 9)}\n{p}") for i, p, _ in items]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string")
    monkeypatch.setattr(leak, "PARTS", 3)
    out = find_leaks(d, e, items_at_once=2)
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(i, i) for i in range(12)]
