import pytest

from pitchweave.llm.mojibake import Letters, find_garbled, garbling_cost, is_garbled, letter_pairs, letter_statistics, repair_encoding, repair_text

CLEAN = [
    "“It’s a scandal,” cried a voice — the sum of £284 5s. 4½d. was collected.",
    "Das Königliche Amt vergaß den Getreidespeicher zum größten Bedauern",
    "DIE MÜLLERIN.\nA IRMÃ partiram para SÃO GIL. O ARMAZÉM SÃO BRÁS. D. ÂNIA",
    "LE THÉÂTRE MUNICIPAL. PÂTE Holzol, « n’a guère apprécié » l’été",
    "Вдова купца принял пароход несмотря на метель, в среду утром.",
    "Rada gminy żąda łąki, różany ogród w środę późno. Łódź",
    "ÅKAREN. Ångbåten övertog världshuset före påsk",
    "near the sta¬\ntion grö¬\nßer snö¬\nfallet Straß¬\n» ~ « ·\n. ,: ° ‘ ■ wiſhes ﬂour café",
    "",
    "plain",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert repair_text(text) == (False, text, True)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251", "mac-roman", "cp437", "cp850"])
def test_utf8_read_as_legacy_comes_back(wrong):
    for text in CLEAN[:2] + CLEAN[3:4]:
        try:
            bad = text.encode().decode(wrong)
        except UnicodeDecodeError:
            bad = text.encode().decode("latin-1")
        assert repair_text(f"The first line.\n{bad}") == (True, f"The first line.\n{text}", True), bad


def test_two_layers_and_parts_of_a_page():
    text = CLEAN[1]
    once = text.encode().decode("latin-1")
    assert repair_text(once.encode().decode("latin-1"))[1] == text
    assert repair_text(f"{CLEAN[0]}\n{once}\n{CLEAN[0]}")[1] == f"{CLEAN[0]}\n{text}\n{CLEAN[0]}"


def test_single_byte_mixups():
    for right, wrong, text in (("cp1251", "latin-1", CLEAN[4]), ("cp1252", "cp437", CLEAN[1]), ("cp1250", "latin-1", CLEAN[5])):
        bad = text.encode(right, "ignore").decode(wrong)
        garbled, fixed, _ = repair_text(bad)
        assert garbled and sum(a == b for a, b in zip(fixed, text)) > 0.9 * len(text), fixed
    assert garbling_cost("Иванов") < 1 < garbling_cost("Ðâàíîâ")


def test_lost_characters_are_found_but_not_restored():
    assert repair_text("caf� near the station")[::2] == (True, False)
    garbled, fixed, whole = repair_text("faÃ§ade and 4Â�d.")
    assert garbled and "façade" in fixed and not whole


@pytest.mark.parametrize("text", ["et voilÃ le soir", "voilÃ", "le prix, dejÃ , est de 10", "a\x80b", "�"])
def test_what_no_trip_restores_is_garbled(text):
    garbled, _, whole = repair_text(text)
    assert garbled and not whole


@pytest.mark.parametrize("text", ["A IRMÃ e A MANHÃ, DE Â", "Ã, Â", "SÃO irmã", "déjà-vu à Âge"])
def test_true_capitals_are_not_garbled(text):
    assert repair_text(text) == (False, text, True)


def test_a_table_with_nulls_and_long_words(spark):
    rows = [(1, "cafÃ©", "x"), (2, None, "x"), (3, "", "x"), (4, "é" * 5000, "x"), (None, "Â£7", "x"), (1, "cafÃ©", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, garbled string")
    out = repair_encoding(df).collect()
    got = sorted((r.doc_id or 0, r.garbled, r.repaired) for r in out if r.doc_id != 4)
    assert got == [(0, True, "£7"), (1, True, "café"), (1, True, "café"), (2, False, None), (3, False, "")]
    assert all(r.whole for r in out if not r.garbled)
    assert sorted(r.doc_id or 0 for r in find_garbled(df).collect()) == sorted(r.doc_id or 0 for r in out if r.garbled)
    assert repair_encoding(df.limit(0)).count() == find_garbled(df.limit(0)).count() == 0


WORDS = "Пароход отошёл вечером полночь среда купец метель город новый совет праздник"


@pytest.mark.parametrize("word", [WORDS.replace(" ", ""), WORDS.replace(" ", "") * 60, "größeüberträgt" * 700, "日本語新聞記事", "שלוםעיתוןחדש"])
def test_words_of_any_length_and_script(word):
    letters = Letters(dict(sum((letter_pairs(t) for t in [*CLEAN, WORDS, word[:60]]), letter_pairs(""))))
    for wrong in ("latin-1", "cp1251"):
        try:
            bad = word.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        assert repair_text(f"a {bad} b", letters)[:2] == (True, f"a {word} b")


@pytest.mark.parametrize("layers", [1, 2, 3, 5, 6])
def test_layers_are_undone_to_the_last(layers):
    bad = CLEAN[1]
    for _ in range(layers):
        bad = bad.encode().decode("latin-1")
    letters = Letters(dict(sum((letter_pairs(t) for t in CLEAN), letter_pairs(""))))
    assert repair_text(bad, letters) == (True, CLEAN[1], True)


def test_what_is_still_suspicious_is_not_whole():
    letters = Letters(dict(letter_pairs(CLEAN[1])))
    garbled, fixed, whole = repair_text("cafÃ© prÃ¨s".replace("¨", "¨"), letters)  # letters this corpus never had
    assert garbled and fixed == "café près" and not whole


def test_statistics_leave_garbled_texts_out(spark):
    rows = [(i, CLEAN[1]) for i in range(20)] + [(50, CLEAN[1].encode().decode("latin-1")), (51, None), (52, "")]
    letters = letter_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "ö" in letters.single and "Ã" not in letters.single
    assert not letter_statistics(spark.createDataFrame([], "doc_id long, text string")).pair


def test_statistics_are_those_of_all_texts(spark):
    texts = [f"{CLEAN[i % 4]} {i}" for i in range(9_000)] + ["różany ogród"]
    letters = letter_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    counts = sum(map(letter_pairs, CLEAN[:4]), letter_pairs(""))
    assert letters.pair == Letters({p: 2_250 * n for p, n in counts.items()} | letter_pairs("różany ogród")).pair


#: Share of pages found, and of these restored exactly, that is asked for; what a single-byte mix-up leaves is often true text.
ASKED = {
    ("utf-8", "cp1252"): (0.99, 0.99), ("utf-8", "latin-1"): (0.99, 0.99), ("utf-8", "cp437"): (0.99, 0.99), ("cp1252", "latin-1"): (0.99, 0.97),
    ("cp1252", "cp850"): (0.5, 0.95), ("cp1252", "cp437"): (0.8, 0.95), ("cp1252", "mac-roman"): (0.5, 0.95), ("cp1252", "cp1250"): (0.3, 0.95), ("cp1252", "cp1251"): (0.8, 0.95),
}


@pytest.fixture(scope="module")
def pages(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables here")
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").distinct().collect()]
    clean = sorted(t for t in texts if not t.isascii() and not is_garbled(t))
    taught, asked = clean[::2], clean[1::2]  # held out
    return Letters(dict(sum((letter_pairs(t) for t in taught), letter_pairs("")))), asked


@pytest.mark.parametrize("right, wrong", list(ASKED))
def test_pages_come_back_exactly(pages, right, wrong):
    letters, texts = pages
    n = found = exact = wrong_whole = 0
    for text in texts:
        try:
            raw = text.encode(right)
        except UnicodeEncodeError:
            continue
        try:
            bad = raw.decode(wrong)
        except UnicodeDecodeError:  # decoders let undefined bytes through as controls
            bad = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
        if bad == text:
            continue
        garbled, fixed, whole = repair_text(bad, letters)
        n, found, exact, wrong_whole = n + 1, found + garbled, exact + (garbled and fixed == text), wrong_whole + (garbled and whole and fixed != text)
    assert n > 100 and found >= ASKED[right, wrong][0] * n and exact >= ASKED[right, wrong][1] * found and wrong_whole <= 0.005 * n, (n, found, exact, wrong_whole)
