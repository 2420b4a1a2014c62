"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded texts.

Folding lower-cases, composes, and maps homoglyphs of other scripts and digit substitutions to one Latin letter
(l and i fold alike, as 1 stands for both), in texts and lexicon alike; accented letters stay, as languages tell
words apart by them. Entries are words, or stems that match all words that begin with them. The automaton finds all
entries in one pass; one within an exception phrase does not count. The sum of weights, as it is and by length,
gives a score between 0 and 1 through a logistic curve.

Learned from labelled rows: entries with weights (log odds of words and stems among labelled texts, near copies
counted once), exception phrases (pairs of words around an entry that stand in clean texts), and the curve.

Defined results: a null or empty text has no match and gets the curve's value there. Null labels and ids are not
learned from; without positive rows the lexicon is empty and the score is the prior. Repeated rows score alike.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, labelled, stored

#: Labelled rows that are learned from at most.
LEARN_ROWS = 20_000
#: Entries at most, exception phrases at most, and the evidence that an entry needs: bounds of the model's size.
MOST_ENTRIES, LEAST_TEXTS, LEAST_ODDS, LEAST_Z = 500, 5, 3.5, 3.2
#: Lengths of stems.
STEMS = range(3, 9)
#: Terms that a task counts before it hands them on.
HELD_TERMS = 100_000

# Letters of other scripts that look like a Latin letter, and characters that stand for one.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Signs that stand for a letter only where a letter follows, as they also end words.
SIGNS = {"@": "a", "$": "s"}
WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[@$](?=[^\W_])")


class _Folds(dict):
    """What each character folds to, found by rule when it is first met."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        out = unicodedata.normalize("NFKC", c).lower()
        out = "".join(x for x in out if x not in "​‌‍⁠﻿­")
        out = "".join(DIGITS.get(x, HOMOGLYPHS.get(x, x)) for x in out).replace("l", "i")
        self[code] = out
        return out


_FOLDS = _Folds()


def folded(text: str) -> str:
    if "$" in text or "@" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.translate(_FOLDS)


@dataclass
class Lexicon:
    """Folded entries with weights (a stem ends in *), folded exception phrases, and the curve's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def automaton(self):
        """Entries and exceptions in one pyahocorasick automaton; None if there are none."""
        import ahocorasick

        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), False, None))
        for entry, weight in sorted(self.weights.items()):  # a stem comes after its own word
            word = entry.removesuffix("*")
            if word == entry or word not in self.weights:
                found.add_word(word, (len(word), word != entry, weight))
            else:
                found.add_word(word, (len(word), True, max(weight, self.weights[word])))
        found.make_automaton()
        return found


def matches(text: str, automaton) -> list[tuple[int, int, float]]:
    """(begin, last, weight) of the entries in a folded text, without those within exception phrases."""
    if automaton is None or not text:
        return []
    found, spared = [], []
    last = len(text) - 1
    for end, (size, stem, weight) in automaton.iter(text):
        begin = end - size + 1
        if (begin and text[begin - 1].isalnum()) or (not stem and end < last and text[end + 1].isalnum()):
            continue
        (spared if weight is None else found).append((begin, end, weight))
    if spared:
        # An entry is within a phrase if one that begins no later ends no earlier.
        spared.sort()
        begins, ends = [x[0] for x in spared], list(accumulate((x[1] for x in spared), max))
        found = [x for x in found if not (at := bisect_right(begins, x[0])) or ends[at - 1] < x[1]]
    return found


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the curve takes: none, whether anything was found, the sum, and the sum by length."""
    per = total / np.maximum(words, 1)
    return np.column_stack([np.ones(len(total)), total > 0, np.log1p(np.maximum(total, 0)), np.sqrt(np.maximum(per, 0))])


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Logistic coefficients by Newton steps, with a small ridge."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def sums(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of docs but the text, and total, hits, words of each text."""
    docs = docs.select(*[c for c in docs.columns if c not in ("total", "hits", "words")])
    rest = [c for c in docs.columns if c != "text"]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name != "text")

    def weigh(it):
        automaton = lexicon.automaton()
        for block in batches(it, limit=4 << 20):
            texts = block["text"].to_pylist()
            found = [matches(folded(t), automaton) for t in texts]
            words = [len(t.split()) for t in texts]
            arrays = [*(block[c].combine_chunks() for c in rest), pa.array([sum(m[2] for m in x) for x in found], pa.float64()), pa.array([len(x) for x in found], pa.int64()), pa.array(words, pa.int64())]
            yield from pa.Table.from_arrays(arrays, names=[*rest, "total", "hits", "words"]).to_batches()

    return docs.select(*rest, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(weigh, f"{kinds}total double, hits long, words long")


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, hits for every row of docs (doc_id, text)."""
    one, any_, log, root = lexicon.curve
    z = F.lit(one) + F.when(F.col("total") > 0, any_).otherwise(0.0) + log * F.log1p("total") + root * F.sqrt(F.col("total") / F.greatest("words", F.lit(1)))
    score = 1 / (1 + F.exp(-z))
    return sums(docs.select("doc_id", "text"), lexicon).select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "hits")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, label, sketch: near copies mostly share their smallest triple of words by hash."""

    def each(it):
        import xxhash

        h = xxhash.xxh3_64_intdigest
        for block in batches(it, limit=1 << 20):
            low = []
            for text in block["text"].to_pylist():
                words = WORD.findall(text)
                low.append(min((h(" ".join(words[i : i + 3])) for i in range(len(words) - 2)), default=h(text)) >> 1)
            yield from pa.Table.from_arrays([block["doc_id"], block["label"], pa.chunked_array([pa.array(low, pa.int64())])], names=["doc_id", "label", "sketch"]).to_batches()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "label", "text").mapInArrow(each, f"doc_id {kind}, label int, sketch long")


def term_counts(docs: DataFrame) -> DataFrame:
    """term, a, b: in how many texts of label 1 and 0 each word and stem occurs; partial sums."""

    def each(it):
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            terms = [*held[1], *(t for t in held[0] if t not in held[1])]
            batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[1][t] for t in terms], pa.int64()), pa.array([held[0][t] for t in terms], pa.int64())], names=["term", "a", "b"])
            held[0].clear()
            held[1].clear()
            return batch

        for block in batches(it, limit=1 << 18):
            for y, text in zip(block["label"].to_pylist(), block["text"].to_pylist(), strict=True):
                words = {w for w in WORD.findall(folded(text)) if len(w) >= 3}
                held[y].update(words)
                held[y].update({w[:n] + "*" for w in words for n in STEMS if n < len(w)})
            if len(held[0]) + len(held[1]) > HELD_TERMS:
                yield out()
        yield out()

    return docs.select("label", "text").mapInArrow(each, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def word_before(text: str, at: int, size: int = 40) -> str:
    """The last word before a place, whole, however long; empty if there is none."""
    while True:
        words = WORD.findall(text[max(0, at - size) : at])
        if len(words) > 1 or size >= at:
            return words[-1] if words else ""
        size *= 4


def words_from(text: str, at: int, size: int = 80) -> tuple[str, str]:
    """The word that begins at a place and the one after it, whole; empty where there is none."""
    while True:
        words = WORD.findall(text[at : at + size])
        if len(words) > 2 or at + size >= len(text):
            return tuple([*words[:2], "", ""][:2])
        size *= 4


def contexts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """phrase, a, b: in how many texts of label 1 and 0 an entry's word stands with a neighbour."""

    def each(it):
        automaton = lexicon.automaton()
        for block in batches(it, limit=1 << 20):
            rows = []
            for y, text in zip(block["label"].to_pylist(), block["text"].to_pylist(), strict=True):
                text = folded(text)
                phrases = set()
                for begin, _, _ in matches(text, automaton):
                    before, (here, after) = word_before(text, begin), words_from(text, begin)
                    if before and text[begin - 1] == " ":
                        phrases.add(f"{before} {here}")
                    if after:
                        phrases.add(f"{here} {after}")
                rows += [(p, y) for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["phrase", "label"])

    found = docs.select("label", "text").mapInArrow(each, "phrase string, label int")
    return found.groupBy("phrase").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))


def chosen_entries(rows: list[tuple[str, int, int, float]], ratio: float, most: int = MOST_ENTRIES) -> dict[str, float]:
    """Entries of (term, texts of label 1, texts of label 0, odds); ratio: texts of label 1 by those of label 0.

    The widest first; not those that a chosen stem stands for, nor stems that add little to chosen entries.
    """
    chosen: dict[str, float] = {}
    texts: dict[str, int] = {}
    # Of terms that are equally wide the most specific: the word itself, then the longest stem.
    for term, a, b, odds in sorted(rows, key=lambda r: (10 * ratio * r[2] - r[1], r[0].endswith("*"), -len(r[0]), r[0])):
        word = term.removesuffix("*")
        if any(chosen.get(word[:n] + "*", -9.0) >= odds - 1 for n in range(2, len(word) + 1)):
            continue
        if word != term and a <= 1.2 * sum(n for t, n in texts.items() if t.startswith(word)):
            continue
        chosen[term], texts[term] = odds, a
        if len(chosen) == most:
            break
    return chosen


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Lexicon:
    """The lexicon from at most `rows` labelled rows (doc_id, label), chosen by a hash of their ids."""
    binary = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    sample = stored(labelled(docs, binary, "label", rows), "labelled")
    single = stored(sketches(sample).groupBy("sketch", "label").agg(F.min("doc_id").alias("doc_id")), "single")
    sizes = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        prior = 0.5 / (n0 + 1)
        return Lexicon(curve=(float(np.log(prior / (1 - prior))), 0.0, 0.0, 0.0))
    counted = term_counts(sample.join(F.broadcast(single.select("doc_id")), "doc_id"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    counted = counted.where(F.col("a") >= LEAST_TEXTS).withColumn("odds", F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)))
    counted = counted.where((F.col("odds") >= LEAST_ODDS) & (F.col("odds") / F.sqrt(1 / a + 1 / b) >= LEAST_Z))
    # A term needs several of at most `rows` texts, so terms are bounded by the sample.
    lexicon = Lexicon(chosen_entries([(r["term"], r["a"], r["b"], float(r["odds"])) for r in counted.collect()], n1 / max(1, n0)))
    spared = contexts(sample, lexicon).where((F.col("b") >= 3) & (F.col("a") * 10 <= F.col("b")))
    lexicon.exceptions = tuple(r["phrase"] for r in spared.orderBy(F.desc("b"), "phrase").limit(MOST_ENTRIES).collect())
    found = sums(sample.select("label", "text"), lexicon).select("label", "total", "words").toPandas()  # at most `rows` rows
    lexicon.curve = fitted(features(found["total"].to_numpy(), found["words"].to_numpy()), found["label"].to_numpy(float))
    return lexicon


def held_out() -> Column:
    """Whether a row is never learned from: one in five, by its id."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
