"""Exact, near and substring duplicates and near vectors, against plain loops."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, exact, frames, graph, near, spans, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, block string, key long, node long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text):
    w = [lower(x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def least_label(nodes, links):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(60)] + ["é", "the", "THE"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 90))] for _ in range(8)]
    rows = []
    for k in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k * 3 - 40, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE two"), (905, "one"), (None, rows[0][1])]
    rows += [(906, rows[3][1]), (906, rows[3][1]), (907, "x y z " * 3000), (908, "x y z " * 3000 + "end")]
    return [(*r, "b", 1, 2) for r in rows]


@pytest.mark.parametrize("percent", [85, 80, 100])
def test_near_duplicates_equal_all_pairs(spark, percent):
    rows = near_rows(percent)
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS), percent).collect()
    assert len(got) == len(rows)
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets[r[0]] = shingle_set(r[1])
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    label = least_label(ids, links)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]),
                label[r.doc_id],
                label[r.doc_id] == r.doc_id,
            )


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert near.near_duplicates(none).collect() == []
    assert near.drop_near_duplicates(none).columns == none.columns


def test_an_id_with_two_texts_joins_their_components(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = [(1, a), (5, a), (5, b), (7, b), (9, "other words entirely here now")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (7, 1), (9, 9)}


def test_large_groups_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BAND_BLOCK", 4)
    monkeypatch.setattr(near, "SET_BLOCK", 4)
    rows = near_rows(3)[:150]
    whole = near.near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect()
    monkeypatch.undo()
    assert sorted(whole) == sorted(near.near_duplicates(spark.createDataFrame(rows, DOCS), 85).collect())


def test_odd_sketches_allow_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    samples, bits = 96, near.SKETCH_BITS
    most = near.most_odd_bits(samples, 85)
    worst = []
    for _ in range(2000):
        flips = 2 * rng.binomial(samples, 0.15)
        worst.append(int((np.bincount(rng.integers(0, bits, flips), minlength=bits) & 1).sum()))
    assert max(worst) <= most < bits / 4


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(7, 7), (500, 500), (300, 299), (299, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == least_label({x for e in edges for x in e}, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 30_000])
def test_fuse_filters_hold_their_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    built = exact.build_filter(keys)
    assert exact.passes(keys, *built).all()
    assert exact.passes(rng.integers(2**63, 2**64, 20_000, dtype=np.uint64), *built).mean() < 0.01


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("line", ["doc_id < 30", "doc_id % 2 = 0", "false", "true"])
def test_exact_duplicates_wherever_the_snapshot_ends(spark, line):
    rng = random.Random(4)
    texts = ["a b", "a  b", "a\n\tb", "A b", "", None, " ", "é", "a b ", "x" * 50_000]
    rows = [(k, rng.choice(texts), "b", 1, 2) for k in range(60)]
    rows += [(7, rows[7][1], "c", 3, 4), (None, "a b", "", 0, 0), (None, "only without id", "", 0, 0)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, DOCS), F.expr(line)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r[0])
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        first = min((x for x in ids if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (first, len(ids), r.doc_id == first)
    kept = exact.drop_exact_duplicates(spark.createDataFrame(rows, DOCS), F.expr(line))
    assert kept.columns == ["doc_id", "text", "block", "key", "node"]
    assert sorted(normal(r.text) for r in kept.dropDuplicates(["doc_id", "text"]).collect()) == sorted(groups)


def test_exact_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact.exact_duplicates(none, exact.midpoint(none)).collect() == []


def without_repeats(rows):
    docs = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [20, 50_000])
def test_repeated_spans_equal_all_windows(spark, monkeypatch, shard_words):
    monkeypatch.setattr(spans, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spans, "STREAM_WORDS", shard_words * 4)
    rng = random.Random(9)
    bases = [[rng.choice("a b c d é f A".split()) for _ in range(45)] for _ in range(6)]
    rows = []
    for k in range(160):
        w = []
        for _ in range(rng.randint(0, 4)):
            base, at = rng.choice(bases), rng.randint(0, 30)
            w += base[at : at + rng.randint(1, 30)] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        rows.append((rng.choice([k, k, k // 2, None]), rng.choice([" ", "\n "]).join(w), "b", 1, 2))
    rows += [(500, None, "", 0, 0), (501, "", "", 0, 0), (502, "w " * 20_000, "", 0, 0), (503, "w " * 20_001, "", 0, 0)]
    got = spans.remove_repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(rows)


def test_repeated_spans_of_nothing(spark):
    assert spans.remove_repeated_spans(spark.createDataFrame([], DOCS)).collect() == []


def test_suffix_automaton_knows_the_smallest_document():
    rng = random.Random(2)
    sequences = [([rng.randrange(3) for _ in range(rng.randint(1, 30))], doc) for doc in rng.sample(range(100), 12)]
    automaton = spans.SuffixAutomaton()
    for sequence, doc in sequences:
        automaton.add(sequence, doc)
    automaton.finish()
    for _ in range(200):
        asked, doc, width = [rng.randrange(3) for _ in range(15)], rng.randrange(100), rng.randint(1, 6)
        earlier = {tuple(s[i : i + width]) for s, d in sequences if d < doc for i in range(len(s) - width + 1)}
        want = [i for i in range(15 - width + 1) if tuple(asked[i : i + width]) in earlier]
        assert automaton.repeats(asked, doc, width) == want


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 8))
    rows = []
    for k in range(400):
        b = base[rng.integers(60)]
        noise = rng.standard_normal(8) * rng.choice([0, 0.05, 0.2, 0.3]) * np.linalg.norm(b) / 3
        rows.append((k, [float(x) for x in (b + noise) * rng.choice([1.0, 2.0])]))
    rows += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [None] + [1.0] * 7), (5004, [float("nan")] + [1.0] * 7)]
    rows += [(5005, [float("-inf")] + [1.0] * 7), (None, [1.0] * 8), (5006, [1e300] * 8), (5007, [1e-300] * 8)]
    rows += [(5008, [1.0] * 8), (5008, [1.0] * 8)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, unit string, copies long, node long")
    monkeypatch.setattr(codes, "BLOCK", 16)
    got = codes.near_vectors(table).collect()
    assert len(got) == len(rows)
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    x = np.array([v for _, v in good])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    label = least_label(set(ids), [(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked), strict=True)])
    links = dict(zip(ids, (linked.sum(1) - 1).tolist(), strict=True))
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            want = label.get(r.vec_id, r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), want, want == r.vec_id)


def test_near_vectors_of_nothing(spark):
    assert codes.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_code_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    turned, signs, f = codes.encode(x / np.linalg.norm(x, axis=1, keepdims=True), codes.rotation(64, 256))
    bits = signs.shape[1]
    estimate = turned @ np.where(signs, 1, -1).T / np.sqrt(bits) / f
    error = estimate - turned @ turned.T
    margin = codes.EPSILON * np.sqrt((1 - f * f) / (f * f * (bits - 1)))
    off = ~np.eye(300, dtype=bool)
    assert abs(error[off].mean()) < 0.003
    assert (np.abs(error) <= margin)[off].mean() > 0.9999


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = [" a b c\n", "", "é\x0bf", "\x1cx y\x85", None, "ends"]
    raw, offsets = frames.text_bytes(pa.array(texts))
    starts, ends, rows = words.word_spans(raw, offsets)
    got = [(int(r), bytes(raw[s:e]).decode()) for s, e, r in zip(starts, ends, rows, strict=True)]
    assert got == [(k, w) for k, t in enumerate(texts) for w in WORD.findall(t or "")]
