"""Texts that look the same, brought to one form.

A text is first normalised: full-width, half-width and joined letter forms and kinds of space become
plain, invisible characters go, accents are taken off their letters. Letters that look alike across
scripts are one class, by the public relation of confusable characters. Each run of letters is then a
token, whose lattice holds, at each place, all letters of its class. A Viterbi search gives the best
letters of each script the whole token may be in, under counts of letter pairs of that script, and
another one over the tokens of the text chooses the scripts, each change of which has a cost. Both
depend only on what is seen, so texts that look the same get the same form, whatever characters they
were written in, and texts that do not get different ones.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.skew import fragment_join, key_join, semi_join
from shelfmark.session import materialise

# Format characters that are seen.
SEEN_FORMATS = "؀؁؂؃؄؅۝܏࣢𑂽𑃍"

# Ranges of ignorable characters that are not format characters.
IGNORABLE_RANGES = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]

# Kinds of compatibility forms that look like what they decompose to.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>")

# Hyphens that look like the one of the keyboard.
HYPHENS = "‐‑"

# Letters that differ from i by their missing dot, and one that looks like l.
DOTLESS, LIKE_L = "ıɩɪιӏꙇ𑣃", "ӏ"

#: Scripts a token is searched in; letters of others belong to classes, but no token is rewritten to them.
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")

TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
MARKS = re.compile("[̀-ͯ]+")

#: Bytes of UTF-8 text with ASCII letters in lower case, what is not ASCII as it is, and all else as space.
LETTER_BYTES = bytes(n if n > 127 else ord(chr(n).lower()) if chr(n).isalpha() else 32 for n in range(256))


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """The script of a letter among SCRIPTS, or ''."""
    name = unicodedata.name(ch, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "")


_CLASSES: dict[str, str] = {}


def letter_classes(spark: SparkSession) -> dict[str, str]:
    """The letter that names the class of each letter that looks like another one; all others name themselves.

    The relation is that of the Unicode consortium's list of confusable characters, which comes with
    Spark's own copy of ICU: letters whose skeletons are equal look alike. Only letters are compared with
    letters, so that digits and punctuation stay visible. A class is named by an ASCII letter where it
    has one; where it has two, as I and l, letters go with the one of their case. Classes without ASCII
    letters keep the cases apart. Letters that differ from i by the dot are a class of their own.
    """
    if _CLASSES:
        return _CLASSES
    letters = []
    for n in range(0x20000):
        ch = chr(n)
        if unicodedata.category(ch)[0] == "L":
            form = unicodedata.decomposition(ch)
            if not form or (form.startswith("<compat>") and not script_of(ch) == "LATIN" and len(unicodedata.normalize("NFKD", ch)) == 1):
                letters.append(ch)
    skeleton = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    looks = dict(zip(letters, skeleton("\n".join(letters)).split("\n")))
    groups: dict[tuple[str, str], list[str]] = defaultdict(list)
    for ch in letters:
        plain = unicodedata.normalize("NFKD", ch)
        if plain == ch or looks.get(plain) != looks[ch]:
            look = "dotless" if ch in DOTLESS and ch not in LIKE_L else looks["I"] if ch in LIKE_L else looks[ch]
            groups[look, ""].append(ch)
    order = {s: n for n, s in enumerate((*SCRIPTS, ""))}
    kind = lambda ch: {"Lu": "u", "Lt": "u", "Ll": "l"}.get(unicodedata.category(ch), "o")
    for group in groups.values():
        if len(group) < 2:
            continue
        ascii_ = [ch for ch in group if ch.isascii()]
        if any(len(looks[a]) > 1 for a in ascii_):
            continue  # looks like several letters
        for ch in group:
            like = ascii_ or [x for x in group if kind(x) == kind(ch)]
            if len(ascii_) > 1:
                like = [a for a in ascii_ if (kind(a) == "u") == (kind(ch) == "u")]
            name = min(like, key=lambda x: (order[script_of(x)], x))
            if name != ch:
                _CLASSES[ch] = name
    return _CLASSES


@lru_cache(maxsize=1)
def normal_forms() -> dict[str, str]:
    """What each character becomes, by Unicode's own properties; nothing if it is ignorable."""
    table: dict[str, str] = {}
    for n in range(0x20000):
        ch = chr(n)
        kind, form = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Zs" or ch == "\t":
            table[ch] = " "
        elif kind in ("Zl", "Zp") or ch in "\r\x0b\x0c\x85":
            table[ch] = "\n"
        elif kind == "Cf" and ch not in SEEN_FORMATS:
            table[ch] = ""
        elif ch in HYPHENS:
            table[ch] = "-"
        elif form.startswith(SAME_LOOK):
            table[ch] = unicodedata.normalize("NFKD", ch)
    for first, last in IGNORABLE_RANGES:
        table.update((chr(n), "") for n in range(first, last + 1))
    return table


def swapped(text: str, table: dict[str, str]) -> str:
    """The text with the table's characters replaced: a few distinct ones by a quick search each, many in one slow pass."""
    found = [c for c in set(text) if c in table]
    if len(found) > 64:
        return text.translate({ord(c): table[c] for c in found})
    for c in found:
        text = text.replace(c, table[c])
    return text


class Looks:
    """Texts by what is seen of them: classes of letters, plain spaces and line breaks, accents apart."""

    def __init__(self, classes: dict[str, str]):
        self.classes = classes
        self.forms = {c: f for c, f in normal_forms().items() if c not in classes}
        #: The letters of SCRIPTS in each class that has more than one look to choose from.
        self.members: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for ch in sorted({*classes, *classes.values()}):
            if script_of(ch):
                self.members[classes.get(ch, ch)].append((script_of(ch), ch))
        self.members = dict(self.members)

    @classmethod
    def of(cls, spark: SparkSession) -> "Looks":
        return cls(letter_classes(spark))

    def normalise(self, text: str) -> str:
        """Compatibility forms, kinds of space and line breaks made plain, ignorable characters deleted, accents apart."""
        if text.isascii():
            return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ") if "\r" in text or "\t" in text else text
        return unicodedata.normalize("NFD", swapped(text.replace("\r\n", "\n"), self.forms))

    def classed(self, text: str) -> str:
        """The text by classes: equal for texts that look the same, and for no others."""
        text = self.normalise(text)
        return text if text.isascii() else swapped(text, self.classes)

    def letters(self, name: str) -> list[tuple[str, str]]:
        """(script, letter) of the letters a class may stand for."""
        return self.members.get(name) or [(script_of(name), name)]

    @lru_cache(maxsize=200_000)  # noqa: B019
    def kind(self, token: str) -> tuple[str, bool]:
        """The script a normalised token is written in, '' for several, and whether one of its letters looks like none of another script."""
        bare = MARKS.sub("", token)
        scripts = {script_of(c) for c in bare}
        if len(scripts) > 1:
            return "", False
        return scripts.pop(), any(len({s for s, _ in self.letters(self.classes.get(c, c))}) == 1 for c in bare)

    def __reduce__(self):
        return Looks, (self.classes,)


def _basic(ch: str) -> bool:
    """Letters of the scripts' own blocks; with them the pairs of any corpus are bounded by alphabets."""
    return ch < "ɐ" or "Ͱ" <= ch < "֐"


class PairCounts:
    """Letter pairs in lower case, with ^ and $ for the ends, by script, of the tokens of many texts.

    A token counts for the script it is written in if one of its letters is certain to be of that script.
    Others may be a disguise; they count if most certain tokens of their text are of that script too.
    """

    def __init__(self, looks: Looks):
        self.looks = looks
        self.words: dict[str, Counter] = defaultdict(Counter)
        self.total: Counter = Counter()

    def add(self, normal: str) -> None:
        """A text by what normalise gives for it."""
        pieces = normal.encode("utf-8", "replace").translate(LETTER_BYTES).split()
        if normal.isascii():
            self.words["LATIN"].update(pieces)
        else:
            odd = {p: TOKEN.findall(p.decode()) for p in set(pieces) if not p.isascii()}
            kinds = {t: self.looks.kind(t) for found in odd.values() for t in found}
            if any(script not in ("", "LATIN") for script, _ in kinds.values()):
                self._mixed(pieces, odd)
            else:
                latin = self.words["LATIN"]
                latin.update(pieces)
                for piece, n in [(p, latin.pop(p)) for p in odd]:
                    for t in odd[piece]:
                        if kinds[t][0]:
                            latin[t] += n
        if sum(map(len, self.words.values())) > 1_000_000:
            self.settle()

    def _mixed(self, pieces: list[bytes], odd: dict[bytes, list[str]]) -> None:
        """A text of several scripts: which of its tokens count depends on the script of most of those that are certain."""
        tokens: Counter = Counter()
        for piece, n in Counter(pieces).items():
            for t in odd[piece] if piece in odd else (piece.decode(),):
                tokens[t] += n
        kinds = {t: self.looks.kind(t) for t in tokens}
        certain: Counter = Counter()
        for t, (script, sure) in kinds.items():
            if script and sure:
                certain[script] += tokens[t]
        most = max(certain, key=lambda s: (certain[s], s)) if certain else ""
        for t, (script, sure) in kinds.items():
            if script and (sure or script == most):
                self.words[script][t] += tokens[t]

    def settle(self) -> Counter:
        """The pairs of all words so far."""
        for script, words in self.words.items():
            for word, n in words.items():
                bare = word.decode() if isinstance(word, bytes) else MARKS.sub("", word).lower()
                for a, b in zip("^" + bare, bare + "$"):
                    if _basic(a) and _basic(b):
                        self.total[script, a + b] += n
        self.words.clear()
        return self.total


def counted_pairs(texts: Iterable[str | None], looks: Looks) -> Counter:
    """Letter pairs by script of texts."""
    counts = PairCounts(looks)
    for text in texts:
        if text:
            counts.add(looks.normalise(text))
    return counts.settle()


class Spelling:
    """Scores of letter pairs by script, and the best letters for the classes of a token or text."""

    #: The cost of a change of script within a token outweighs any score, so it changes only where it must.
    CHANGE = 1e6
    #: The cost of a change of script between two tokens.
    SWITCH = 6.0
    #: The cost of a letter that no text has in the script.
    STRANGE = 6.0

    def __init__(self, counts: dict[tuple[str, str], int], looks: Looks):
        self.looks = looks
        after: dict[tuple[str, str], int] = defaultdict(int)
        letters: dict[str, set] = defaultdict(set)
        whole: dict[str, int] = defaultdict(int)
        for (script, pair), n in counts.items():
            after[script, pair[0]] += n
            letters[script].add(pair[1])
            whole[script] += n
        total = sum(whole.values())
        self.scores = {k: math.log((n + 0.5) / (after[k[0], k[1][0]] + 0.5 * (len(letters[k[0]]) + 1))) for k, n in counts.items()}
        self.unseen = {(s, a): math.log(0.5 / (n + 0.5 * (len(letters[s]) + 1))) for (s, a), n in after.items()}
        self.floor = {s: math.log(0.5 / (0.5 * (len(letters[s]) + 1) + 1)) - 4 for s in SCRIPTS}
        self.prior = {s: math.log((whole[s] + 1) / (total + len(SCRIPTS))) for s in SCRIPTS}
        self.alphabet = dict(letters)
        self.known: dict[str, list[tuple[str, float, str]]] = {}

    @classmethod
    def fit(cls, documents: DataFrame, text: str, looks: Looks | None = None) -> "Spelling":
        """From all texts; the driver gets the pair counts, whose number the alphabets bound."""
        looks = looks or Looks.of(documents.sparkSession)
        return cls(collected(_pass(documents, None, text, looks, count=True)), looks)

    def score(self, script: str, a: str, b: str) -> float:
        if not script:
            return 0.0
        a, b = a.lower(), b.lower()
        found = self.scores.get((script, a + b))
        if found is None:
            found = self.unseen.get((script, a), self.floor[script]) - (0.0 if b in self.alphabet.get(script, "") else self.STRANGE)
        return found

    def path(self, classes: str, scripts: Iterable[str] | None = None) -> tuple[float, str]:
        """The best letters for a token given by the classes of its letters, of some scripts only or of all; time and memory follow its length."""
        best: dict[tuple[str, str], float] = {("", "^"): 0.0}
        back: list[dict[tuple[str, str], tuple[str, str]]] = []
        for ch in classes:
            step, came = {}, {}
            for script, letter in self.looks.letters(ch):
                if scripts is not None and script not in scripts:
                    continue
                for at, score in best.items():
                    was, before = at
                    score += self.score(script, before if was == script or before == "^" else "^", letter) - (self.CHANGE if was != script and before != "^" else 0.0)
                    if (script, letter) not in step or score > step[script, letter]:
                        step[script, letter], came[script, letter] = score, at
            # ties fall to the state that sorts first, here and below, so a lattice has one best path
            best = dict(sorted(step.items()))
            back.append(came)
        at = min(best, key=lambda s: (-(best[s] + self.score(*s, "$")), s))
        whole, letters = best[at] + self.score(*at, "$"), []
        for came in reversed(back):
            letters.append(at[1])
            at = came[at]
        return whole, "".join(reversed(letters))

    def options(self, token: str) -> list[tuple[str, float, str]]:
        """(script, score, form) for each script that a token given by classes may be in as a whole; best first.

        A token that fits no script has its best mixed form, under script ''.
        """
        found = self.known.get(token)
        if found is None:
            bare = MARKS.sub("", token)
            fits = reduce(lambda a, b: a & b, [{s for s, _ in self.looks.letters(c)} for c in set(bare)])
            paths = [(s, *self.path(bare, (s,))) for s in sorted(fits)] if fits else [("", 0.0, self.path(bare)[1])]
            if len(bare) < len(token):
                marked = []
                for script, score, form in paths:
                    letters = iter(form)
                    marked.append((script, score, "".join(c if "̀" <= c <= "ͯ" else next(letters) for c in token)))
                paths = marked
            found = sorted(paths, key=lambda p: (-p[1], p[0]))
            if len(self.known) >= 500_000:
                self.known.clear()
            if len(token) <= 64:
                self.known[token] = found
        return found

    def chosen(self, tokens: list[str]) -> list[str]:
        """The forms of the tokens of a text: the scripts with the highest scores, changes of script between tokens paid for."""
        options = {t: self.options(t) for t in set(tokens)}
        if len({o[0][0] for o in options.values() if o[0][0]}) <= 1:
            return [options[t][0][2] for t in tokens]
        best: dict[str, float] = dict(self.prior)
        back: list[dict[str, tuple[str, str]] | str] = []
        for t in tokens:
            found = options[t]
            if not found[0][0]:
                back.append(found[0][2])
                continue
            top = min(best, key=lambda s: (-best[s], s))
            step, came = {}, {}
            for script, score, form in found:
                stay = best.get(script, -math.inf)
                was = script if stay >= best[top] - self.SWITCH else top
                step[script] = score + max(stay, best[top] - self.SWITCH)
                came[script] = (was, form)
            best = step
            back.append(came)
        at, forms = min(best, key=lambda s: (-best[s], s)), []
        for came in reversed(back):
            if isinstance(came, str):
                forms.append(came)
            else:
                at, form = came[at]
                forms.append(form)
        return forms[::-1]

    def canonical(self, text: str) -> str:
        """The one form of all texts that look like this one."""
        classes = self.looks.classed(text)
        tokens = TOKEN.findall(classes)
        forms = self.chosen(tokens) if tokens else tokens
        if forms != tokens:
            each = iter(forms)
            classes = TOKEN.sub(lambda m: next(each), classes)
        return classes if classes.isascii() else unicodedata.normalize("NFC", classes)


def _digest(text: str) -> bytes:
    from hashlib import blake2b

    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _pass(documents: DataFrame, item: str | None, text: str, looks: Looks, count: bool) -> DataFrame:
    """One pass over all texts, not yet run: (item, look, raw) of each with digests of classes and text, and (script, pair, n) of each task."""
    kind = documents.schema[item].dataType.simpleString() if item else "int"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts, schema = PairCounts(looks), None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            normal = [looks.normalise(t) for t in texts]
            if count:
                for n in normal:
                    counts.add(n)
            schema = pa.schema([("item", batch.column(0).type), ("look", pa.binary()), ("raw", pa.binary()), ("script", pa.string()), ("pair", pa.string()), ("n", pa.int64())])
            if item:
                seen = [_digest(n if n.isascii() else swapped(n, looks.classes)) for n in normal]
                columns = [batch.column(0), pa.array(seen, pa.binary()), pa.array([_digest(t) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(texts), f.type) for f in list(schema)[3:]]], schema=schema)
        if schema and (rows := list(counts.settle().items())):
            none = [pa.nulls(len(rows), f.type) for f in list(schema)[:3]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([s for (s, _), _ in rows]), pa.array([p for (_, p), _ in rows]), pa.array([n for _, n in rows], pa.int64())], schema=schema)

    rows = documents.select(F.col(item).alias("item") if item else F.lit(0).alias("item"), F.col(text).alias("text")).dropna()
    return rows.mapInArrow(run, f"item {kind}, look binary, raw binary, script string, pair string, n long")


def collected(rows: DataFrame) -> dict[tuple[str, str], int]:
    """The pair counts in the result of a pass, by script and pair."""
    counts = rows.filter("pair is not null").groupBy("script", "pair").agg(F.sum("n").alias("n"))
    return {(r.script, r.pair): r.n for r in counts.collect()}


def canonical_texts(documents: DataFrame, item: str, text: str, model: Spelling | None = None) -> DataFrame:
    """(item, text): each text in the form all texts share that look like it; null stays null, empty stays empty."""
    model = model or Spelling.fit(documents, text)
    kind = documents.schema[item].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            forms = [t if t is None else model.canonical(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[item, text])

    return documents.select(item, text).mapInArrow(run, f"`{item}` {kind}, `{text}` string")


def looks(documents: DataFrame, item: str, text: str) -> DataFrame:
    """(item, look, raw): digests of the text by classes and of the text; rows with no text or no item are left out."""
    return _pass(documents, item, text, Looks.of(documents.sparkSession), count=False).select("item", "look", "raw")


def _several(found: DataFrame) -> DataFrame:
    """Rows of looks that have more than one spelling."""
    several = found.groupBy("look").agg(F.min("raw").alias("first"), F.max("raw").alias("last")).filter("first <> last")
    return materialise(semi_join(found, materialise(several.select("look")), ["look"]))


def searched(documents: DataFrame, item: str, text: str) -> DataFrame:
    """(item, look, raw) of texts that look like one of another spelling: look is a digest of the one form they have.

    One pass over all texts takes their digests by classes and counts letter pairs. Only texts whose
    classes come in several spellings can have a form in common with another text, since classes decide
    the lattices; of those one of each spelling is read again and brought to its form.
    """
    table = Looks.of(documents.sparkSession)
    rows = materialise(_pass(documents, item, text, table, count=True))
    model = Spelling(collected(rows), table)
    found = _several(rows.filter("look is not null").select("item", "look", "raw"))
    spellings = materialise(found.groupBy("raw").agg(F.min("item").alias("item")))
    texts = semi_join(documents.select(F.col(item).alias("item"), F.col(text).alias("text")).dropna(), spellings, ["item"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            once = list(dict.fromkeys(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(t) for t in once], pa.binary()), pa.array([_digest(model.canonical(t)) for t in once], pa.binary())], names=["raw", "form"])

    forms = materialise(texts.mapInArrow(run, "raw binary, form binary").distinct())
    return key_join(found.select("item", "raw"), forms, ["raw"], shard_by=["item"]).select("item", F.col("form").alias("look"), "raw")


def look_classes(found: DataFrame) -> DataFrame:
    """(item, class_item, spellings): for each row of looks the smallest item that looks the same, and the spellings of that look."""
    spellings = found.groupBy("look", "raw").agg(F.min("item").alias("item"))
    classes = spellings.groupBy("look").agg(F.min("item").alias("class_item"), F.count(F.lit(1)).alias("spellings"))
    return fragment_join(found, classes, ["look"], shard_by=["item"]).select("item", "class_item", "spellings")


def look_pairs(found: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of items whose texts differ but look the same; found is what looks or searched gives.

    Looks of one spelling only are left out at once. Spellings of a look then pair up, one row for each
    however often it is copied; the pairs of a look with many spellings are made in many tasks. The rarer
    spelling of a pair then gets its items, and the items of the more frequent one are split over tasks by
    load. Copies of one spelling never meet, and no row is made that is not a result. Empty texts look
    like texts of ignorable characters only.
    """
    found = _several(materialise(found))
    spellings = materialise(found.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("n")))
    more, less = spellings.select("look", "raw", "n"), spellings.select("look", F.col("raw").alias("raw_b"), F.col("n").alias("n_b"))
    rarer = (F.col("n") > F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("raw") > F.col("raw_b")))
    pairs = materialise(fragment_join(more, less, ["look"], shard_by=["raw"]).filter(rarer).drop("n", "n_b"))
    rare = materialise(key_join(found.select("look", F.col("raw").alias("raw_b"), F.col("item").alias("item_b")), pairs, ["look", "raw_b"], shard_by=["item_b"]))
    both = key_join(found.select("look", "raw", F.col("item").alias("item_a")), rare, ["look", "raw"], shard_by=["item_a"])
    return both.select(F.least("item_a", "item_b").alias(a), F.greatest("item_a", "item_b").alias(b)).filter(F.col(a) < F.col(b)).distinct()
