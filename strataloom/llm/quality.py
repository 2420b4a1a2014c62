"""Quality rules: counts for each text, and a learned decision list over them.

Sequential covering learns which documents to reject: a rule grows by the threshold literal with the best
FOIL gain on two thirds of the labelled rows, is pruned on the other third, and is kept if it is precise
enough there; rows that it covers are set aside and the next rule grows. The list becomes one ordered Spark
`when ... when ... otherwise` expression over the count columns, so applying it is plain column arithmetic.

Defined results: a null text has no words and fails the base rule. Repeated rows are judged alike, a null
label or id is not learned from. Columns other than doc_id and text are passed through by `with_counts` only if
asked for. An empty table gives no rows; without labelled rows, or with one label only, the list is empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, batches, labelled, mixed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_points")
#: Labelled rows that are learned from at most.
LEARN_ROWS = 20_000
#: A rule rejects only if at least this share of the pruning rows that it covers are labelled 0.
PRECISION = 0.9

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_POINTS = np.zeros(256, bool)
_POINTS[list(b".,!?;:")] = True


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).astype(np.int64)


def repeated_words(codes: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text its number of words in windows of `width` words that it holds twice or more."""
    n_docs, n = len(offsets) - 1, len(codes)
    counts = np.diff(offsets)
    if n < width:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), counts)
    at = np.flatnonzero(np.arange(n) + width <= offsets[1:][doc])
    with np.errstate(over="ignore"):
        key = mixed(doc[at].astype(np.uint64))
        for j in range(width):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + codes[at + j].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    if any((codes[a + j] != codes[b + j]).any() for j in range(width)) or (doc[a] != doc[b]).any():
        # Two different windows share a hash: compare the windows themselves.
        order = np.lexsort([*(codes[at + j] for j in range(width)), doc[at]])
        x, y = at[order[1:]], at[order[:-1]]
        same = doc[x] == doc[y]
        for j in range(width):
            same &= codes[x + j] == codes[y + j]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(width):
        covered[at[twice] + j] = True
    return _per_text(covered, offsets)


def count_texts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text."""
    words = Words(data, off)
    n_docs = len(off) - 1
    out = {"n_words": words.counts, "word_chars": _per_text(words.solid & ((data & 0xC0) != 0x80), off)}
    for name, which in (("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_points", _POINTS)):
        out[name] = _per_text(which[data], off)
    out["n_repeat_words"] = repeated_words(words.codes, words.offsets)
    doc = words.documents()
    out["n_distinct"] = np.bincount(np.unique(doc << 32 | words.codes) >> 32, minlength=n_docs)

    # Lines without their line feeds, packed; a line starts at each text and after each line feed.
    feed = data == 10
    starts = np.union1d(off[:-1], np.flatnonzero(feed) + 1)
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    of = np.searchsorted(off, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.solid, out=solid[1:])
    full = solid[ends] > solid[starts]
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~feed, out=kept[1:])
    edges = np.append(kept[starts], kept[-1]).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[~feed])]).dictionary_encode()
    key = (of << 32 | lines.indices.to_numpy(zero_copy_only=False).astype(np.int64))[full]
    out["n_lines"] = np.bincount(key >> 32, minlength=n_docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(key) >> 32, minlength=n_docs)
    return out


def with_counts(docs: DataFrame) -> DataFrame:
    """All columns of docs but the text, and the counts of each text."""
    docs = docs.select(*[c for c in docs.columns if c not in COUNTS])
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")

    def counted(it):
        for block in batches(it):
            found = count_texts(*as_bytes(block["text"]))
            arrays = [block[c].combine_chunks() for c in rest] + [pa.array(found[c].astype(np.int64)) for c in COUNTS]
            yield from pa.Table.from_arrays(arrays, names=[*rest, *COUNTS]).to_batches()

    return docs.select(*rest, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, ", ".join([x for x in [kinds] if x] + [f"{c} long" for c in COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: What literals compare: each is a quotient of two count columns.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "repeated_line_share": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "points_per_word": ("n_points", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    top = F.col(over).cast("double")
    return top if under is None else top / F.greatest(F.col(under), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for literal in rule:
        out &= literal.holds(x)
    return out


def _best_literal(x: dict[str, np.ndarray], reject: np.ndarray, cuts: int) -> tuple[float, Literal | None]:
    """The literal with the largest FOIL gain among rows x."""
    p, n = int(reject.sum()), int((~reject).sum())
    before = np.log2(p / (p + n))
    best: tuple[float, Literal | None] = (0.0, None)
    for name, v in x.items():
        edges = np.unique(np.quantile(v, np.linspace(0, 1, cuts)))
        edges = (edges[1:] + edges[:-1]) / 2
        if not len(edges):
            continue
        place = np.searchsorted(edges, v, side="left")  # 0 .. len(edges): the cuts below v
        ps = np.cumsum(np.bincount(place[reject], minlength=len(edges) + 1))[:-1]
        ns = np.cumsum(np.bincount(place[~reject], minlength=len(edges) + 1))[:-1]
        for above, pp, nn in ((False, ps, ns), (True, p - ps, n - ns)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = float(gain[k]), Literal(name, above, float(edges[k]))
    return best


def learn_list(x: dict[str, np.ndarray], quality: np.ndarray, precision: float = PRECISION, most_rules: int = 20, most_literals: int = 4, cuts: int = 64, least_rows: int = 5, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that reject, by sequential covering of the rows labelled 0."""
    rng = np.random.default_rng(seed)
    left = np.arange(len(quality))
    rules: list[Rule] = []
    while len(rules) < most_rules:
        reject = quality[left] == 0
        if reject.sum() < 2 * least_rows or not (~reject).any():
            break
        grow = rng.random(len(left)) < 2 / 3
        g, p = left[grow], left[~grow]
        rule: Rule = ()
        inside = np.ones(len(g), bool)
        while len(rule) < most_literals:
            y = quality[g[inside]] == 0
            if not y.any() or y.all():
                break
            gain, literal = _best_literal({k: v[g[inside]] for k, v in x.items()}, y, cuts)
            if literal is None:
                break
            rule = (*rule, literal)
            inside = covers(rule, {k: v[g] for k, v in x.items()}, len(g))
        if not rule:
            break
        xp, yp = {k: v[p] for k, v in x.items()}, quality[p] == 0

        def worth(r: Rule) -> tuple[float, int]:
            c = covers(r, xp, len(p))
            return ((int(yp[c].sum()) + 1) / (int(c.sum()) + 2), -len(r))

        rule = max((rule[: k + 1] for k in range(len(rule))), key=worth)
        held = covers(rule, xp, len(p))
        if held.sum() < least_rows or yp[held].mean() < precision:
            break
        rules.append(rule)
        left = left[~covers(rule, {k: v[left] for k, v in x.items()}, len(left))]
    return rules


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, **how) -> list[Rule]:
    """The decision list from a sample of at most `rows` labelled rows, chosen by a hash of their ids."""
    counted = with_counts(labelled(docs, labels, "quality", rows))
    found = counted.where(~base_failed()).select("quality", *[feature(k).alias(k) for k in FEATURES]).toPandas()
    if found.empty:
        return []
    found = found.sort_values([*FEATURES, "quality"])  # the order of rows must not matter
    return learn_list({k: found[k].to_numpy(float) for k in FEATURES}, found["quality"].to_numpy(), **how)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; 0 where none does: one ordered conditional."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = rule[0].column()
        for literal in rule[1:]:
            holds = holds & literal.column()
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, rules: list[Rule], also: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of also, the base counts, base_failed, kept, and the rule that rejected the text (0: none)."""
    counted = with_counts(docs.select("doc_id", "text", *also))
    return counted.select("doc_id", *also, *COUNTS[:5], base_failed().alias("base_failed"), verdict(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
