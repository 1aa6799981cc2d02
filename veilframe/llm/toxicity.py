"""Toxicity of texts behind a noisy channel: odd spellings are decoded, then the restored text is scored.

The channel: letters are written as look-alike signs, repeated, hidden behind a sign, or set apart by separators. A token
that looks like that opens a lattice of readings, in which a separator may also end a word; Viterbi search finds the
likeliest under a letter model (order 2) counted over the whole corpus, and the words of readings nearly as likely. The
restored words, and their beginnings, are looked up in a lexicon that was learnt from labelled documents: what is
significantly more frequent in toxic ones. A word weighs as much as the heaviest entry of its readings;
a logistic regression on the weights of a text's words, in sum and for its length, gives the probability.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialize, q, small_side, text_or_empty
from .quality import held_out, labelled_sample
from .tokenizers_fast import Memory

TRAIN_ROWS = 20_000     # labelled documents used for fitting, about (a documented bound; scores cover all documents)
SURE = 18.0             # likelihood ratio (2 ln) that a lexicon entry needs
LEAST_WEIGHT = 2.0      # how much more frequent it is in toxic documents (ln)
LEAST_DOCS = 3          # toxic documents that have it
BEGINNINGS = (3, 4, 5, 6)   # letters of a word's beginning that are entries of their own
SLICE = 1 << 20

# Letters that a sign can stand for; "*" hides any vowel.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou"}
SEPARATORS = " .-_*~'/\\,:;|+"

_BEFORE, _AFTER = ".,;:!?'\"#%&)>[]{}/\\=~^`-_–—…«»„“”‘’¿", ".,;:!?'\"#%&()<>|[]{}/\\=~^`-_–—…«»„“”‘’*"
_SIGNS, _GAPS = "".join(map(re.escape, LOOKS_LIKE)), "".join(map(re.escape, SEPARATORS))
_SUSPECT = re.compile(rf"(?:[^\W\d_].*[0-9{_SIGNS}{_GAPS}]|[0-9{_SIGNS}].*[^\W\d_]|(.)\1)")
_DOUBLED = re.compile(r"(.)\1")
_APART = re.compile(rf"(?<![^\W_])(?:[*|+][{_GAPS}]+)?[^\s{_GAPS}](?:[{_GAPS}]+[^\s{_GAPS}]){{2,}}(?:[{_GAPS}]+[*|+])?(?![^\W_])")

_SPACE = re.compile(r"\s")
_PIECES = re.compile(rf"[{_GAPS}]+")

_SYMBOLS = 64


def _code(c: str) -> int:
    """0 between words, 1–26 a–z, other letters by residue."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c.isalpha() else 0


_TABLE = np.array([_code(chr(p).lower()[:1]) for p in range(0x250)], np.int64)


def _letter_triples(text: str) -> np.ndarray:
    """Each letter (or end of a word, 0) of a stretch of text with the two before it, as one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 27 + points % 37).astype(np.int32)
    inside = codes > 0
    inside[1:] |= codes[:-1] > 0
    codes = np.concatenate((np.zeros(1, np.int32), codes[inside], np.zeros(1, np.int32)))  # one 0 between words
    before = np.where(codes[1:-1] == 0, 0, codes[:-2])
    return (before * _SYMBOLS + codes[1:-1]) * _SYMBOLS + codes[2:]


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter triples of all texts of a task."""
    total, waiting, held = np.zeros(_SYMBOLS ** 3, np.int64), [], 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            for start in range(0, len(text), SLICE):
                waiting.append(_letter_triples(text[start:start + SLICE]))
                held += len(waiting[-1])
                if held > 2 * SLICE:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total))
                    waiting, held = [], 0
    if waiting:
        total += np.bincount(np.concatenate(waiting), minlength=len(total))
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(found, pa.int32()), "n": pa.array(total[found])})


def letter_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (−ln probability) of a letter after two others, counted over all texts; a table of fixed size."""
    counted = (docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_letter_counts, "gram int, n long")
               .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # at most 64**3 rows
    counts = np.zeros(_SYMBOLS ** 3)
    for gram, n in counted:
        counts[gram] = n
    counts = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    pairs = counts.sum(0)
    single = pairs.sum(0) + 1
    single = single / single.sum()
    two = (pairs + 20 * single) / (pairs.sum(1, keepdims=True) + 20)
    three = (counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20)
    return -np.log(three).astype(np.float32)


class Decoder:
    """Viterbi search for the likeliest words behind a written form."""

    SIGN, REPEAT, GAP, KEEP, END = 0.6, 2.0, 0.4, 6.0, 0.4
    BEAM = 6.0      # readings so much less likely (−ln) than the best at a place are still followed

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.ravel().tolist()

    def restore(self, written: str) -> str:
        """The likeliest reading."""
        return " ".join(words[0] for words in self.read(written))

    def read(self, written: str) -> list[list[str]]:
        """The words of the likeliest reading, each before the other words that were read at its place.

        Each written sign may give a letter or nothing, a separator also the end of a word. The states are where the word
        began, how many repeats were left out, and the last two letters read.
        """
        costs, paths, seen, previous = self.costs, {(0, 0, 0, 0): (0.0, None, None)}, [], ""
        for at, c in enumerate(written):
            letters = [(c, _code(c), 0.0)] if c.isalpha() else []
            letters += [(x, _code(x), self.SIGN + 0.7 * (c in "*#")) for x in LOOKS_LIKE.get(c, "")]
            apart = c in SEPARATORS
            skip = self.GAP if apart else self.REPEAT * 0.5 + 2 if c == previous and c.isalpha() else None if letters else self.KEEP + 2
            following: dict[tuple[int, int, int, int], tuple] = {}
            ends = []
            for (start, left, a, b), (cost, word, words) in paths.items():
                row = (a * _SYMBOLS + b) * _SYMBOLS
                for x, k, price in letters:
                    state, total = (start, left, b, k), cost + price + costs[row + k]
                    if state not in following or total < following[state][0]:
                        following[state] = (total, (word, x), words)
                if skip is not None and (b or not apart):
                    state, total = (start, left + (not apart), a, b), cost + skip
                    if state not in following or total < following[state][0]:
                        following[state] = (total, word, words)
                if apart:
                    state, total = (at + 1, 0, 0, 0), cost
                    if b:
                        total += self.END + costs[row]
                        words = (words, (start, at, word))
                        ends.append((total, words[1]))
                    if state not in following or total < following[state][0]:
                        following[state] = (total, None, words)
            most = min(v[0] for v in following.values()) + self.BEAM
            paths, previous = {k: v for k, v in following.items() if v[0] <= most}, c
            seen += [place for total, place in ends if total <= most]
        last = [(cost + (costs[(a * _SYMBOLS + b) * _SYMBOLS] if b else 0.0), (words, (start, len(written), word)) if b else words)
                for (start, _, a, b), (cost, word, words) in paths.items()]
        least = min(total for total, _ in last)
        seen += [words[1] for total, words in last if words and total <= least + self.BEAM]
        words, best = next(words for total, words in last if total == least), []
        while words:
            words, place = words
            best.append(place)
        best = best[::-1] or seen[:1]
        found = [[_spelt(word)] for _, _, word in best]
        starts = [start for start, _, _ in best]
        for start, end, word in seen:
            first = max(0, bisect.bisect_right(starts, start) - 1)
            over = range(first, max(first + 1, bisect.bisect_left(starts, end)))
            near = max(over, key=lambda k: min(end, best[k][1]) - max(start, starts[k]))
            found[near].append(_spelt(word))
        return [list(dict.fromkeys(x)) for x in found]


def _spelt(word) -> str:
    letters = []
    while word:
        word, x = word
        letters.append(x)
    return "".join(reversed(letters))


def _start(letters: str) -> int:
    return xxhash.xxh32_intdigest(letters) & 0xFFFFFF


def _entry(kind: str, text: str) -> int:
    """A whole number for a word or a beginning; its upper part tells the first three letters."""
    return (_start(text[:3]) << 39) | (xxhash.xxh64_intdigest(f"{kind}{text}") >> 25)


class Reader:
    """Text → its distinct words as they were restored, each as the entries that stand for it."""

    def __init__(self, costs: np.ndarray) -> None:
        self.decoder = Decoder(costs)
        self.memory = Memory(self.of_token, 4 << 20)

    def words(self, token: str) -> list[list[str]]:
        """The words of a token, each with its other readings."""
        token, plain = _stripped(token)
        return [[token]] if plain else self.decoder.read(token)

    def of_token(self, token: str) -> tuple:
        """Of each word: its readings and their beginnings."""
        return self._entries(token)

    def _entries(self, token: str) -> tuple:
        out = []
        for readings in self.words(token):
            held = set()
            for word in readings:
                if _counts(word):
                    held.add(_entry("w", word))
                    held.update(_entry("b", word[:n]) for n in BEGINNINGS if len(word) > n)
            if held:
                out.append(tuple(sorted(held)))
        return tuple(out)

    def of_text(self, text: str) -> list:
        """What ``memory`` holds for the words of the distinct tokens of the whole text, those set apart letter by letter included."""
        tokens: set[str] = set()
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > SLICE:
                cut = _SPACE.search(text, start + SLICE)
                end = cut.start() if cut else end
            part = text[start:end].lower()
            start = end
            tokens.update(part.split())
            tokens.update(x for x in (m.group() for m in _APART.finditer(part)) if " " in x)
        return list(chain.from_iterable(map(self.memory.__getitem__, tokens)))


class Weigher(Reader):
    """The same, with the weight of each word in a lexicon instead of its entries.

    All entries of a word begin with its first three letters. A word that begins otherwise weighs nothing, and a lattice is opened
    only if some reading of it can begin like an entry; else its pieces between separators count as words without weight.
    """

    def __init__(self, costs: np.ndarray, lexicon: dict[int, float]) -> None:
        super().__init__(costs)
        self.lexicon = lexicon
        self.memory = Memory(self.of_token, 32 << 20)
        starts = {e >> 39 for e in lexicon}
        self.begins = Memory(lambda letters: _start(letters) in starts, 4 << 20)

    def of_token(self, token: str) -> tuple:
        token, plain = _stripped(token)
        if plain:
            return (self.weight(token),) if _counts(token) else ()
        if not self.reachable(token):
            return (0.0,) * max(1, sum(len(x) >= 3 for x in _PIECES.split(token)))
        places = ([self.weight(word) for word in readings if _counts(word)] for readings in self.decoder.read(token))
        return tuple(max(weights) for weights in places if weights)

    def weight(self, word: str) -> float:
        if not self.begins[word[:3]]:
            return 0.0
        find = self.lexicon.get
        return max(find(_entry("w", word), 0.0), *(find(_entry("b", word[:n]), 0.0) for n in BEGINNINGS if len(word) > n), 0.0)

    def reachable(self, written: str) -> bool:
        """Whether a reading can have a word that begins like an entry: the lattice's steps, followed for three letters only."""
        states, previous = {""}, ""
        for c in written:
            letters = (c if c.isalpha() else "") + LOOKS_LIKE.get(c, "")
            apart = c in SEPARATORS
            following = set(states) if apart or not letters or (c == previous and c.isalpha()) else set()
            for state in states:
                for x in letters:
                    begun = state + x
                    if len(begun) < 3:
                        following.add(begun)
                    elif self.begins[begun]:
                        return True
            if apart:
                following.add("")
            states, previous = following, c
        return False


def _stripped(token: str) -> tuple[str, bool]:
    """The token without marks around it, and whether it is to be taken as it stands."""
    if not token.isalpha():
        token = token.lstrip(_BEFORE).rstrip(_AFTER)
    if token.isalpha() and not _DOUBLED.search(token):
        return token, True
    return token, not _SUSPECT.search(token)


def _counts(word: str) -> bool:
    return len(word) >= 3 and (word.isalpha() or any(map(str.isalpha, word)))


_held: dict[type, tuple[str, Reader]] = {}


def _shared(kind: type[Reader], name: str, *facts) -> Reader:
    """The process's reader: what it remembers serves all tasks of a Python worker. ``name`` tells its facts from others."""
    if kind not in _held or _held[kind][0] != name:
        _held.clear()
        _held[kind] = (name, kind(*facts))
    return _held[kind][1]


class Model(NamedTuple):
    costs: np.ndarray
    lexicon: dict[int, float]
    weights: np.ndarray     # of the logistic regression, the last one its constant
    base: float             # share of toxic documents, what is said if nothing could be learnt


def evidence(weights: np.ndarray, words: int) -> tuple[float, ...]:
    """What the regression sees: weights in sum, for the length, the heaviest, and how many there are."""
    held = weights[weights > 0]
    total = math.fsum(np.sort(held))
    return (math.log1p(total), total / math.sqrt(words + 10.0), float(held.max()) if len(held) else 0.0, math.log1p(len(held)),
            100 * len(held) / (words + 20.0))


def _reading(costs: np.ndarray):
    name = xxhash.xxh3_128_hexdigest(costs.tobytes())

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def entries(texts: pa.Array) -> pa.Array:
        read = _shared(Reader, name, costs).of_text
        return pa.array([read(x.as_py() or "") for x in texts], pa.list_(pa.list_(pa.int64())))

    return entries


def _evidence_column(lexicon: dict[int, float]):
    """Column function: entries of a text's words → what the regression sees."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def seen(entries: pa.Array) -> pa.Array:
        out = []
        for x in entries:
            weights = np.array([max(lexicon.get(e, 0.0) for e in word) for word in x.as_py() or ()], float)
            out.append(evidence(weights, len(weights)))
        return pa.array(out, pa.list_(pa.float64()))

    return seen


def learn_lexicon(rows: DataFrame) -> dict[int, float]:
    """Entries that words of toxic documents have significantly more often, and their weights (ln of the ratio of rates).

    ``rows (id, y, entries)`` is a bounded sample, and an entry is held by at least ``LEAST_DOCS`` of its toxic documents.
    """
    words = rows.groupBy("y").agg(F.sum(F.size("entries")).alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    words = {r["y"]: float(r["n"] or 0) for r in words}
    if not words.get(1.0) or not words.get(0.0):
        return {}
    each = rows.select("id", "y", F.explode(F.flatten("entries")).alias("entry"))
    hits = materialize(each.where(F.col("y") == 1).groupBy("id", "entry").agg(F.count(F.lit(1)).alias("n"))
                       .groupBy("entry").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_DOCS), "hits")
    others = (each.where(F.col("y") == 0).join(small_side(hits.select("entry"), 16), "entry", "left_semi")
              .groupBy("entry").agg(F.count(F.lit(1)).alias("o")))
    both = hits.join(others, "entry", "left").select("entry", "t", F.coalesce("o", F.lit(0)).alias("o"))
    rate = words[1.0] / (words[1.0] + words[0.0])
    total = F.col("t") + F.col("o")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (total * rate))
                 + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / (total * (1 - rate)))).otherwise(0))
    weight = F.log((F.col("t") + 0.5) / words[1.0]) - F.log((F.col("o") + 0.5) / words[0.0])
    chosen = both.where((ratio > SURE) & (weight > LEAST_WEIGHT)).select("entry", weight.alias("weight")).collect()
    return {r["entry"]: float(r["weight"]) for r in chosen}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        bound: int = TRAIN_ROWS) -> Model:
    """Letter model from all documents; lexicon and regression from labelled ones that are not held out."""
    costs = letter_model(docs, text_col)
    sample = materialize(labelled_sample(labels, label, id_col, bound), "labelled")
    rows = materialize(docs.select(q(id_col).alias("id"), text_or_empty(text_col).alias("text"))
                       .join(small_side(sample, 24), "id").select("id", "y", _reading(costs)("text").alias("entries")), "entries")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    n, toxic = facts["n"] or 0, facts["y"] or 0.0
    lexicon = learn_lexicon(rows) if 0 < toxic < n else {}
    if not lexicon:
        return Model(costs, {}, np.zeros(0), toxic / n if n else 0.0)
    seen = rows.select(array_to_vector(_evidence_column(lexicon)("entries")).alias("features"), F.col("y").alias("label"))
    fitted = LogisticRegression(regParam=1e-4, maxIter=60).fit(materialize(seen, "evidence"))
    return Model(costs, lexicon, np.append(fitted.coefficients.toArray(), fitted.intercept), toxic / n)


def score_column(model: Model):
    """Column function: text → probability of being toxic."""
    name = xxhash.xxh3_128_hexdigest(model.costs.tobytes() + repr(sorted(model.lexicon.items())).encode())

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if not model.lexicon:
            return pa.array(np.full(len(texts), model.base))
        read = _shared(Weigher, name, model.costs, model.lexicon).of_text
        out = np.zeros(len(texts))
        for k, x in enumerate(texts):
            weights = np.array(read(x.as_py() or ""), float)
            out[k] = np.dot(model.weights[:-1], evidence(weights, len(weights))) + model.weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.7, **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Scores depend on the text only, and cover all of it. Null and empty texts score as texts without hits; a null id is
    not held out and never learnt from. Without toxic and other labelled documents no word counts, and all scores are the
    same. Repeated rows each get their score; an empty table gives an empty result.
    """
    model = fit(docs, labels, label, id_col, text_col, **options)
    return (docs.select(q(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
            .select("doc_id", "held_out", score_column(model)("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
