import random

import numpy as np
import pytest

from shelfmark.llm.leaks import BITMAP, WordForms, fingerprints, leaks, winnow
from shelfmark.llm.lookalikes import Looks
from test_lookalikes import disguise

WORDS = [f"w{n}" for n in range(60)]


def brute(docs, items, span):
    def grams(text):
        words = text.split()
        return {tuple(words[n : n + span]) for n in range(len(words) - span + 1)}

    held = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs if t for i, g in held.items() if g & grams(t)}


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc long, text string, item string, words int")
    e = spark.createDataFrame(items, "item long, text string")
    return {tuple(r) for r in leaks(d, "doc", "text", e, "item", "text", **kw).collect()}


@pytest.fixture(scope="module")
def table(spark):
    return Looks.of(spark)


@pytest.mark.parametrize("few, most_bits", [(50_000, 1 << 28), (0, BITMAP), (0, 1 << 20)])
def test_against_brute_force(spark, few, most_bits):
    rng = random.Random(8)
    items = [(n, " ".join(rng.choices(WORDS, k=50))) for n in range(12)]
    docs = []
    for n in range(150):
        words = rng.choices(WORDS, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            k, at = rng.randint(9, 15), rng.randint(0, 30)
            place = rng.randint(0, len(words))
            words[place:place] = own[at : at + k]
        docs.append((n, " ".join(words)))
    assert found(spark, docs, items, few=few, most_bits=most_bits) == brute(docs, items, 12)


def test_more_fingerprints_of_items_than_bits(spark):
    rng = random.Random(3)
    words = [f"v{n}" for n in range(400)]
    items = [(n, " ".join(rng.choices(words, k=70))) for n in range(500)]
    docs = [(n, " ".join(rng.choices(words, k=30) + rng.choice(items)[1].split()[20 : 20 + rng.choice([11, 12, 30])] + rng.choices(words, k=30))) for n in range(60)]
    got = found(spark, docs, items, few=0, most_bits=BITMAP)
    assert got == brute(docs, items, 12) and 20 < len(got) < 60
    forms = WordForms(Looks.of(spark))
    df = spark.createDataFrame(items, "item long, text string")
    assert fingerprints(df, "item", "text", forms, 12, 8).count() * 4 > BITMAP
    alone = {r.fingerprint for r in fingerprints(df, "item", "text", forms, 12, 8, alone=True).collect()}
    assert alone == {r.fingerprint for r in fingerprints(df, "item", "text", forms, 12, 8).collect()}


def test_span_at_the_ends_and_one_word_short(spark):
    item = " ".join(WORDS[:40])
    docs = [(1, " ".join(WORDS[:12])), (2, " ".join(WORDS[:11])), (3, " ".join(["x", *WORDS[28:40]])), (4, " ".join([*WORDS[5:10], "x", *WORDS[10:17]])), (5, " ".join(WORDS[5:17]) * 1)]
    assert found(spark, docs, [(7, item)]) == {(1, 7), (3, 7), (5, 7)}


PASSAGES = [
    "the museum porter opened a velvet crate and found two loose covers on leaf seven of the book",
    "он не знал что в папке на сервере нет той копии которую он всё ещё видел в старом каталоге",
    "Die Straße war so groß, daß man über Jahre hinweg keinen Weißen Fluß mehr daneben sah, hieß es",
    "le café était fermé à midi et personne ne voyait où la clé du dépôt avait été laissée hier",
]


def test_disguises_case_and_punctuation_do_not_matter(spark, table):
    rng = random.Random(4)
    docs, wanted = [], set()
    for n, text in enumerate(PASSAGES):
        forms = [text.upper(), text.lower(), text.title(), text.replace(" ", " — ", 3).replace(" ", ",\n", 2)]
        forms += [disguise(f, rng, table) for f in forms for _ in range(3)]
        for f in forms:
            docs.append((len(docs), f))
            wanted.add((docs[-1][0], n))
    for n, text in enumerate(PASSAGES):
        words = text.split()
        docs.append((len(docs), " ".join("other" if at % 9 == 4 else w for at, w in enumerate(words))))
    assert found(spark, docs, list(enumerate(PASSAGES))) == wanted
    assert found(spark, docs, [(n, disguise(t.upper(), rng, table)) for n, t in enumerate(PASSAGES)]) == wanted


def test_words(table):
    forms = WordForms(table)
    for a, b in [("НЕТ", "нет"), ("HET", "нет"), ("в", "B"), ("Straße", "STRASSE"), ("ΛΟΓΟΣ", "λογος"), ("naı", "NAI"), ("Ⲟ", "o"), ("ꓪay", "way")]:
        assert forms.key(a) == forms.key(b) and forms.same(a, b), (a, b)
    for a, b in [("vote", "note"), ("bay", "bar"), ("cafe", "cafe\u0301"), ("l", "1"), ("o", "0"), ("an", "ann")]:
        assert not forms.same(a, b), (a, b)
    assert forms.words("a_b, c3 e\u0301té\u200b! x") == [b"a", b"b", b"c3", "e\u0301te\u0301", b"x"]
    assert forms.words("It's 2 words") == [b"It", b"s", b"2", b"words"]


def test_words_that_only_share_a_key_are_no_leak(spark):
    text = " ".join(["vote", *WORDS[:12], "van"])
    docs = [(1, text), (2, text.replace(" van", "").replace(WORDS[5], "nine")), (3, " ".join(["vine"] * 13))]
    assert found(spark, docs, [(1, text), (2, " ".join(["nine"] * 13))]) == {(1, 1)}


@pytest.mark.parametrize("few", [50_000, 0])
def test_a_passage_in_most_documents(spark, few):
    docs = [(n, f"{n} " + " ".join(WORDS[:20]) + f" {n}" if n % 3 else f"{n}") for n in range(3000)]
    got = found(spark, docs, [(1, " ".join(WORDS[:20])), (2, " ".join(WORDS[5:40]))], few=few)
    assert got == {(n, i) for n in range(3000) if n % 3 for i in (1, 2)}


def test_nulls_empty_copies_and_long_texts(spark):
    item = " ".join(WORDS[:20])
    docs = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, " ".join(["z"] * 30_000 + WORDS[:14] + ["z"] * 30_000))]
    assert found(spark, docs, [(1, item), (2, None), (3, ""), (None, item), (4, item)]) == {(3, 1), (3, 4), (4, 1), (4, 4)}
    assert found(spark, [], [(1, item)]) == set() and found(spark, docs, []) == set()


def test_winnow_keeps_the_least_of_each_window():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 200).astype(np.uint64)
    places, prints = winnow(hashes, 8, 5)
    assert (np.diff(places) <= 5).all() and places[0] < 5 and places[-1] >= 193 - 5
    assert len(winnow(hashes[:11], 8, 5)[0]) == 0 and len(winnow(hashes[:12], 8, 5)[0]) == 1
    assert 1 < len(winnow(np.zeros(40, np.uint64), 8, 5)[0]) <= 33
