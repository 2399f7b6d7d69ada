import itertools
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.lookalikes import TOKEN, Looks, Spelling, canonical_texts, counted_pairs, look_classes, look_pairs, looks, script_of, searched
from shelfmark.operators import skew

ENGLISH = "the folder of the server was copied once more and then nobody could open its hidden pages so we had to choose a copy"
RUSSIAN = "зеркало отстаёт и удалённый файл всё ещё виден сначала сравните оба каталога потом удаляйте старую копию"
GERMAN = "Der Ordner wurde größer, während niemand für die Übertragung über das Netz zuständig war, und die Straße hieß anders"


@pytest.fixture(scope="module")
def table(spark):
    return Looks.of(spark)


@pytest.fixture(scope="module")
def model(table):
    return Spelling(dict(counted_pairs([ENGLISH, RUSSIAN, GERMAN] * 3, table)), table)


def others(table):
    """Letters by the letter they look like."""
    out = defaultdict(list)
    for ch, name in table.classes.items():
        out[name].append(ch)
    return out


def disguise(text, rng, table):
    """The same look by other characters."""
    out, like = [], others(table)
    for ch in text:
        pick = rng.random()
        if pick < 0.4 and (name := table.classes.get(ch, ch)) in like:
            ch = rng.choice([*like[name], name])
        elif "!" <= ch <= "~" and pick < 0.6:
            ch = chr(ord(ch) + 0xFEE0)
        elif ch == " " and pick < 0.7:
            ch = rng.choice("\u00a0\u2009\u202f\u3000")
        elif pick < 0.8:
            ch = unicodedata.normalize("NFD", ch)
        out.append(ch + (rng.choice("\u200b\u00ad\u2060\ufeff") if rng.random() < 0.1 else ""))
    return "".join(out)


def test_one_form_for_one_look(model, table):
    rng = random.Random(2)
    for text in (ENGLISH, RUSSIAN, "Café crème, 12 fi\nА naïve Möwe", "COPY of А", "", "abc ОС"):
        form = model.canonical(text)
        for _ in range(20):
            assert model.canonical(disguise(text, rng, table)) == form
        assert model.canonical(form) == form


def test_words_keep_their_script(model):
    assert model.canonical("ѕhоw thе сору ﬁle ｃｏｄｅ") == "show the copy file code"
    assert model.canonical(RUSSIAN) == RUSSIAN
    assert model.canonical("перeноса") == "переноса"


def test_what_is_seen_stays_different(model):
    forms = [model.canonical(t) for t in ("cafe", "café", "Cafe", "cafe.", "cafe\n", "cafe1", "ca fe", "c0fe", "x²", "x2")]
    assert len(set(forms)) == len(forms)


def test_normalise(table):
    assert table.normalise("a\tb\r\nc\rd\u2028e") == "a b\nc\nd\ne"
    assert table.normalise("ﬀ ½ ² Ｋ \u212a non\u2011breaking") == "ff ½ ² K K non-breaking"


def test_letters_that_look_alike_are_one_class_and_others_are_not(table):
    same = [("\u0261", "g"), ("\u0251", "a"), ("\u04cf", "l"), ("\u04c0", "I"), ("\u03c5", "u"), ("\u03b9", "\u0131"), ("\u0581", "g"), ("\u13aa", "A"), ("\u13b3", "W"), ("\u2c9e", "O"), ("\u2ca5", "c"), ("\u03f2", "c"), ("\u04ae", "Y"), ("\u03a0", "\u041f")]
    for a, b in same:
        assert table.classed(a) == table.classed(b), (a, b)
    seen = ["l", "I", "1", "O", "0", "o", "m", "rn", "i", "\u0131", "g", "q", "e", "\u00e9", "-", "\u2014", "\u0431", "6"]
    assert len({table.classed(x) for x in seen}) == len(seen)


def exhaustive(model, classes):
    """The score of the best path by trying all."""
    best = None
    for letters in itertools.product(*[model.looks.letters(c) for c in classes]):
        score, was, before = 0.0, None, "^"
        for script, letter in letters:
            score += model.score(script, before if was in (None, script) else "^", letter) - (model.CHANGE if was not in (None, script) else 0)
            was, before = script, letter
        score += model.score(was, before, "$")
        best = score if best is None else max(best, score)
    return best


def test_best_paths_against_all_paths(model):
    for classes in ("copy", "co", "a", "epose", "pacoф", "tфe", "SCOPE", "иco"):
        classes = model.looks.classed(classes)
        score, form = model.path(classes)
        assert score == pytest.approx(exhaustive(model, classes))
        assert model.looks.classed(form) == classes


def test_letters_without_a_sure_script_follow_their_neighbours(model):
    for text in ("В начале а потом с ним", "и с ним", "НЕТ ВСЁ НА ВО"):
        assert model.canonical(text) == text
        assert model.canonical(model.looks.classed(text)) == text
    assert model.canonical("then а copy of А page") == "then a copy of A page"


def test_clean_texts_stay_and_disguised_ones_come_back(model, table):
    rng = random.Random(5)
    restored = tokens = 0
    for text in (ENGLISH, RUSSIAN, GERMAN):
        assert model.canonical(text) == text
        for _ in range(20):
            odd = disguise(text, rng, table)
            a, b = TOKEN.findall(text), TOKEN.findall(model.canonical(odd))
            tokens, restored = tokens + len(a), restored + sum(x == y for x, y in zip(a, b))
    assert restored / tokens >= 0.95


def test_a_disguise_counts_for_the_script_of_its_text(table):
    counts = counted_pairs(["сору the marked files", "стол сору дом"], table)
    assert counts["CYRILLIC", "со"] == 1 and counts["LATIN", "th"] == 1


def test_long_tokens_and_no_statistics(table):
    empty = Spelling({}, table)
    assert empty.canonical("сор" * 1000) == empty.canonical("cop" * 1000)
    assert empty.canonical("") == "" and script_of("-") == ""


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string, item long, look string, raw int")


def pairs(spark, rows, found=searched):
    return {tuple(r) for r in look_pairs(found(documents(spark, rows), "doc", "text"), "a", "b").collect()}


def test_pairs(spark, monkeypatch):
    rows = [(n, t, 0, "clash", 1) for n, t in enumerate(["same text", "ѕame text", "same text", "sаme tехt", "Same text", "", "\u200b", None, "alone"])] + [(None, "same text", 0, "", 0)]
    wanted = {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3), (5, 6)}
    assert pairs(spark, rows) == pairs(spark, rows, looks) == wanted
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, "a", 0, "", 0), (1, "а", 0, "", 0)]) == set()
    joined = skew.key_join
    monkeypatch.setattr("shelfmark.llm.lookalikes.key_join", lambda *a, **k: joined(*a, **{**k, "few": 0}))
    assert pairs(spark, rows) == wanted


def test_copies_never_meet(spark):
    df = spark.range(6000).select(F.col("id").alias("doc"), F.when(F.col("id") < 3, "cоpy").otherwise("copy").alias("text"))
    found = looks(df, "doc", "text")
    assert look_pairs(found, "a", "b").count() == 3 * 5997
    assert {tuple(r) for r in look_classes(found).groupBy("class_item", "spellings").count().collect()} == {(0, 2, 6000)}


def test_texts(spark):
    out = {r.doc: r.text for r in canonical_texts(documents(spark, [(1, "ѕo", 0, "", 0), (2, None, 0, "", 0), (3, "the flag", 0, "", 0)]), "doc", "text").collect()}
    assert out == {1: out[1], 2: None, 3: "the flag"} and len(out[1]) == 2
