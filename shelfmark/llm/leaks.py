"""Passages of evaluation items within a corpus, found by winnowing."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import Optional

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shelfmark.llm.lookalikes import MARKS, Looks, swapped
from shelfmark.operators.skew import FEW_KEYS, key_join
from shelfmark.session import materialise

WORD = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯ])*")

#: Bytes of UTF-8 text with ASCII letters and digits, and what is not ASCII, as they are and all else as space.
WORD_BYTES = bytes(n if n > 127 or chr(n).isalnum() else 32 for n in range(256))


class Pieces(dict):
    """The words of pieces of text between ASCII spaces and signs; pieces in ASCII are words."""

    def __missing__(self, piece: bytes) -> tuple[str | bytes, ...]:
        self[piece] = found = (piece,) if piece.isascii() else tuple(w.encode() if w.isascii() else w for w in WORD.findall(piece.decode()))
        return found


# Odd 64-bit numbers that spread hashes.
SPREAD, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class WordForms:
    """Words of texts, and when two words are the same.

    Two letters are the same if they look the same, or if one of them looks like the other case of a letter
    that looks like the other one: Cyrillic н, its capital Н and Latin H are the same, and so are н and a
    Latin H. The relation is not transitive, so words have keys that are: letters are united along all
    looks and cases. Equal words have equal keys, whatever was done to them first, case or look; same()
    then tells words of one key apart exactly. ß and its capital are
    ss, and so are letters that look like ß in a word that cannot be Greek.
    """

    def __init__(self, looks: Looks):
        self.looks, self.pieces, parent = looks, Pieces(), {}
        classes = looks.classes

        def root(x: str) -> str:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        def unite(x: str, y: str) -> None:
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

        self.longer: dict[str, str] = {}
        self.alike: dict[str, set[str]] = defaultdict(set)
        for ch, name in classes.items():
            self.alike[name].add(ch)
        for n in range(0x20000):
            ch = chr(n)
            if len(ch.casefold()) > 1 and unicodedata.normalize("NFD", ch) == ch:
                self.longer[ch] = ch.casefold()
                continue
            for x in {ch.lower(), ch.upper(), ch.casefold()} - {ch}:
                if len(x) == 1:
                    unite(classes.get(ch, ch), classes.get(x, x))
        self.roots = {c: root(c) for c in parent}

    def key(self, word: str) -> str:
        """What all words have that may be the same as this one."""
        return "".join(self.roots.get(k := self.looks.classes.get(c, c), k) for c in self.spelt(word))

    def spelt(self, word: str) -> str:
        """The word with letters written out whose other case has several."""
        word = swapped(word, self.longer)
        if not word.isascii() and not self.alike["ß"].isdisjoint(word) and not all(any(s == "GREEK" for s, _ in self.looks.letters(self.looks.classes.get(c, c))) for c in MARKS.sub("", word)):
            word = "".join("ss" if c in self.alike["ß"] else c for c in word)
        return word

    def flips(self, name: str) -> frozenset[str]:
        """The looks of the other cases of the letters of a class."""
        return frozenset(self.looks.classes.get(y, y) for x in {name, *self.alike.get(name, ())} for y in {x.lower(), x.upper()} if y != x and len(y) == 1)

    @lru_cache(maxsize=1_000_000)  # noqa: B019
    def same(self, a: str, b: str) -> bool:
        """Whether two normalised words are the same."""
        if a == b:
            return True
        a, b = self.spelt(a), self.spelt(b)
        if len(a) != len(b):
            return False
        for x, y in zip(a, b):
            if x != y and x.casefold() != y.casefold():
                p, q = self.looks.classes.get(x, x), self.looks.classes.get(y, y)
                if p != q and p not in self.flips(q) and q not in self.flips(p):
                    return False
        return True

    def words(self, text: str) -> list[str | bytes]:
        """Runs of letters and digits as they stand in the normalised text, accents with their letters; those in ASCII as bytes."""
        pieces = self.looks.normalise(text).encode("utf-8", "replace").translate(WORD_BYTES).split()
        if len(self.pieces) > 1_000_000:
            self.pieces.clear()
        return pieces if text.isascii() else list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def __reduce__(self):
        return WordForms, (self.looks,)


class WordHashes(dict):
    """64-bit hashes of the keys of words, each made once; emptied between texts when it has grown large."""

    def __init__(self, forms: WordForms):
        self.forms = forms

    def __missing__(self, word: str | bytes) -> int:
        self[word] = found = xxh64_intdigest(self.forms.key(word.decode() if isinstance(word, bytes) else word))
        return found


def winnow(hashes: np.ndarray, k: int, window: int, text: Optional[np.ndarray] = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints): the least k-gram hash of each window of k-grams, the rightmost of equals; hashes are of words.

    Any run of k + window - 1 words has a window of its own, so two texts that share such a run share
    the least hash of that window. hashes may hold many texts one after the other, with text saying
    which each word is of; no window reaches from one into the next.
    """
    span, count = k + window - 1, len(hashes) - k - window + 2
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            grams = grams * np.uint64(SPREAD) + hashes[j : j + len(grams)]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(MIX)
        grams ^= grams >> np.uint64(29)
    places, least = np.arange(count), grams[:count]
    for j in range(1, window):
        other = grams[j : j + count]
        lower = other <= least
        least, places = np.where(lower, other, least), np.where(lower, np.arange(j, j + count), places)
    if text is not None:
        places = places[text[:count] == text[span - 1 : span - 1 + count]]
    places = np.unique(places)
    return places, grams[places]


#: Texts are winnowed together until they have about so many words.
WORDS_AT_ONCE = 400_000


class Marks:
    """Which fingerprints may be wanted: a bit for each value of their lowest bits."""

    def __init__(self, bits: int, held: bytes):
        self.mask, self.held = bits - 1, np.frombuffer(held, np.uint8)

    def may_hold(self, prints: np.ndarray) -> np.ndarray:
        slot = (prints & np.uint64(self.mask)).astype(np.int64)
        return (self.held[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


#: Bits in a bitmap of Spark's, and the least and most bits of all marks: 512 KB and 32 MB, which are sent to the tasks.
BITMAP, LEAST_BITS, MOST_BITS = 32768, 1 << 22, 1 << 28


def marks(tested: DataFrame, most_bits: int = MOST_BITS) -> Marks:
    """Marks of the fingerprints in a written table: at least 16 bits to each, at most most_bits.

    With more fingerprints than a sixteenth of that, more of the corpus passes that nobody wants; what
    passes meets the exact fingerprints in any case.
    """
    count = tested.count()
    bits = min(LEAST_BITS, most_bits)
    while bits < min(16 * count, most_bits):
        bits *= 2
    slot = F.pmod("fingerprint", F.lit(bits).cast("long")) + 1
    parts = tested.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    held = bytearray(bits // 8)
    for r in parts.collect():
        held[(r.part - 1) * BITMAP // 8 : r.part * BITMAP // 8] = r.bits
    return Marks(bits, bytes(held))


def fingerprints(df: DataFrame, item: str, text: str, forms: WordForms, span: int, k: int, wanted: Marks | None = None, alone: bool = False) -> DataFrame:
    """(item, place, fingerprint, words): what winnowing keeps of each text, with the words around it; or, if asked for, fingerprints alone.

    words holds those of the k-gram, span - k to its left and as many to its right: all that is needed
    to see whether a shared run of span words covers it. Beyond the text's ends it holds nulls. Only
    fingerprints that wanted may hold are kept, so of a corpus little more leaves the tasks than is shared.
    """
    kind = df.schema[item].dataType.simpleString()
    side = span - k
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def chunks(texts: list) -> Iterator[tuple[list[int], list[list], list[np.ndarray]]]:
        known = WordHashes(forms)
        rows, held, hashes, size = [], [], [], 0
        for row, t in enumerate(texts):
            words = forms.words(t) if t else ()
            if len(words) < span:
                continue
            if len(known) > 1_000_000:
                known.clear()
            rows.append(row)
            held.append(words)
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            size += len(words)
            if size >= WORDS_AT_ONCE:
                yield rows, held, hashes
                rows, held, hashes, size = [], [], [], 0
        if rows:
            yield rows, held, hashes

    def around(words: list, at: int) -> list[str | None]:
        near = [None] * max(0, side - at) + words[max(0, at - side) : at + k + side]
        near += [None] * (k + 2 * side - len(near))
        return [w.decode() if isinstance(w, bytes) else w for w in near]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows, held, hashed in chunks(batch.column(1).to_pylist()):
                ends = np.cumsum([len(h) for h in hashed])
                starts = np.concatenate([[0], ends[:-1]])
                hashes = np.concatenate(hashed)
                text_of = np.repeat(np.arange(len(held)), ends - starts)
                at, grams = winnow(hashes, k, span - k + 1, text_of)
                if sent is not None:
                    hit = sent.value.may_hold(grams)
                    at, grams = at[hit], grams[hit]
                if alone:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(grams).view(np.int64))], names=["fingerprint"])
                    continue
                for first in range(0, len(at), 20_000):
                    own = text_of[at[first : first + 20_000]]
                    place = at[first : first + 20_000] - starts[own]
                    words = [around(held[o], p) for o, p in zip(own.tolist(), place.tolist())]
                    ids = batch.column(0).take(pa.array(np.array(rows)[own]))
                    prints = pa.array(grams[first : first + 20_000].view(np.int64))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int32)), prints, pa.array(words, pa.list_(pa.string()))], names=["item", "place", "fingerprint", "words"])

    return df.select(item, text).dropna().mapInArrow(run, "fingerprint long" if alone else f"item {kind}, place int, fingerprint long, words array<string>")


def shared_run(a: list[str | None], b: list[str | None], span: int, same: Callable[[str, str], bool]) -> bool:
    """Whether the words around two equal fingerprints agree over a run of span words, null agreeing with nothing.

    There are 2 * span - k of them, so any such run covers the k-gram in the middle.
    """
    run = 0
    for x, y in zip(a, b):
        run = run + 1 if x is not None and (x == y or (y is not None and same(x, y))) else 0
        if run >= span:
            return True
    return False


def leaks(documents: DataFrame, document: str, text: str, items: DataFrame, item: str, item_text: str, span: int = 12, k: int = 8, most_bits: int = MOST_BITS, few: int = FEW_KEYS) -> DataFrame:
    """Distinct (document, item): documents that hold at least span consecutive words of the item's text.

    Words are the same whatever their letter case and look, as WordForms says. Both sides are winnowed
    with the same windows over hashes of the words' keys, so each shared run of span words shares a
    fingerprint; fingerprints that meet are extended to both sides, word by word, and kept if the run
    reaches span words.

    The items' fingerprints mark bits of a table of bounded size, which all tasks get, so documents are
    read once and filtered where they are read. What passes meets the items' fingerprints: sent to all
    tasks up to `few` of them, else in a join that splits a fingerprint that most documents have. If the
    items have more fingerprints than the table can tell apart, a pass before finds those that the
    documents have as well, by fingerprints alone, and only these mark bits.

    Null or empty texts, and texts of fewer than span words, hold nothing. Repeated rows and copies are
    found each by its id; ids that are null never are. Empty tables give no rows.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be from 1 to span")
    forms = WordForms(Looks.of(documents.sparkSession))
    tested = materialise(fingerprints(items.dropna(subset=[item]), item, item_text, forms, span, k))
    documents, wanted = documents.dropna(subset=[document]), tested
    if tested.count() * 4 > most_bits:
        both = fingerprints(documents, document, text, forms, span, k, marks(tested, most_bits), alone=True).distinct()
        wanted = materialise(both.join(tested.select("fingerprint").distinct(), "fingerprint", "left_semi"))
    held = materialise(fingerprints(documents, document, text, forms, span, k, marks(wanted, most_bits)))
    right = tested.select(F.col("item").alias("tested"), "fingerprint", F.col("words").alias("wanted"))
    # a text that repeats itself sends the same words once
    met = key_join(held.select("item", "fingerprint", "words").distinct(), right, ["fingerprint"], few=few, shard_by=["item"])
    kinds = {c: met.schema[c].dataType.simpleString() for c in ("item", "tested")}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("words").to_pylist(), batch.column("wanted").to_pylist()
            kept = pa.array([shared_run(x, y, span, forms.same) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in ("item", "tested")], names=["item", "tested"])

    hits = met.select("item", "tested", "words", "wanted").mapInArrow(run, f"item {kinds['item']}, tested {kinds['tested']}")
    return hits.select(F.col("item").alias(document), F.col("tested").alias(item)).distinct()
