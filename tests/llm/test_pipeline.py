"""The pipeline against a brute-force version on a small corpus."""

from __future__ import annotations

import collections
import itertools
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strataloom.llm.queries import vocabulary_file  # noqa: E402

from .test_operators import bag, library, prose, similarity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    out = tmp_path_factory.mktemp("data")
    vocabulary = [f"word{i}" for i in range(500)]
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, 80 + i, vocabulary)))
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    for i in range(5):  # near copies
        words = rows[20 + i][1].split()
        words[i] = "other"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 70, [w + "%%%" for w in vocabulary])) for i in range(30)]  # junk
    rows += [(400, rows[30][1] + " password=abcdef0123456789"), (500, "short"), (501, None), (502, ""), (503, "again and again " * 40)]
    rows.append((None, prose(rng, 90, vocabulary)))
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(not 300 <= i < 400), 0) for i, _ in rows if i is not None and i < 400]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows


def test_stages(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    texts = dict(rows)

    # Quality: junk and what the base rule fails go, all else stays.
    def base_fails(t):
        w = (t or "").split()
        seen = collections.defaultdict(list)
        for s in range(len(w) - 2):
            seen[tuple(w[s : s + 3])].append(s)
        repeat = len({s + k for at in seen.values() if len(at) > 1 for s in at for k in range(3)})
        return len(w) < 50 or 100 * repeat > 50 * len(w)

    want = {i for i, t in rows if i is None or not (300 <= i < 400 or base_fails(t))}
    assert {r.doc_id for r in kept["quality_rules"].collect()} == want

    groups = collections.defaultdict(list)
    for i in want - {None}:
        groups[texts[i]].append(i)
    want = {max(ids) for ids in groups.values()} | {None}
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == want

    parent = {i: i for i in want}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(want - {None}), 2):
        if similarity(bag(texts[a]), bag(texts[b])) >= 0.8:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    want = {i for i in want if top(i) == i}
    assert {r.doc_id for r in kept["near_dedup"].collect()} == want and not want & {200, 201, 202, 203, 204, 400}

    clean = {r.doc_id: r for r in kept["secret_scan"].collect()}
    assert set(clean) == want and all(clean[i].text == texts[i] and clean[i].n_chars == len(texts[i]) for i in want)

    lib = library(vocabulary_file("word_bpe_49k.json"))
    tokens = {i: len(lib.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want}
    total = collections.Counter()
    for r in kept["packing"].collect():
        assert r.doc_tokens == tokens[r.doc_id]
        total[r.doc_id] += r.length
    assert total == tokens


def test_verdicts_act_on_their_own_rows(spark, tmp_path):
    """Rows without an id are dropped by their verdicts, and of texts that share an id only the rejected ones."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(500)]
    good, copied, other, near = (prose(rng, 90, words) for _ in range(4))
    altered = near.split()
    altered[40] = "other"
    altered = " ".join(altered)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    def want(*rows):
        return sorted(rows, key=str)

    assert left(corpus_pipeline.quality_rules, [(None, "too short"), (None, good), (1, "too short"), (1, good)]) == want((None, good), (1, good))
    assert left(corpus_pipeline.exact_duplicates, [(None, copied), (5, copied), (3, copied), (3, other), (None, good)]) == want((5, copied), (3, other), (None, good))
    assert left(corpus_pipeline.near_duplicate_groups, [(2, near), (None, altered), (7, altered), (7, good), (None, other)]) == want((2, near), (7, good), (None, other))


def test_secrets_are_redacted(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, sf_dir).collect()}
    texts = dict(rows)
    assert out[400].text == texts[400].replace("password=abcdef0123456789", "[secret]") and out[400].n_chars == len(out[400].text)
    assert out[501].text is None and all(out[i].text == t for i, t in texts.items() if i != 400)


def test_run_is_the_stages(spark, folder):
    sf_dir, _ = folder
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
