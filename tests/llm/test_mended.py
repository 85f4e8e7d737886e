"""Words that polynomial hashes take for one another, lengths beyond the first few, and vectors of several widths."""

import numpy as np
import pytest

from tidemark.llm import codes, mix, near, spans, words


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def twins(n=1024):
    """Two words whose polynomial hashes modulo 2^64 agree at any base."""
    return thue_morse(n, "ab"), thue_morse(n, "ba")


def test_words_of_regular_patterns_have_their_own_hashes():
    texts = [*twins(), *twins(2048), "a" * 1024, "b" * 1024, "ab", "ba", "a", "aa"]
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    starts, ends, _ = words.word_spans(raw, np.array([0, len(raw)]))
    hashes = words.word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == len(texts)
    # The same word has the same hash anywhere, and A-Z may count as a-z.
    again = np.frombuffer(b"x  AB\nab", np.uint8)
    starts, ends, _ = words.word_spans(again, np.array([0, len(again)]))
    own = words.word_hashes(again, starts, ends, lower=True)
    assert own[1] == own[2] == hashes[6]
    assert words.word_hashes(again, starts, ends)[1] != own[1]


def test_near_duplicates_and_spans_tell_such_words_apart(spark):
    a, b = twins()
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near.near_duplicates(docs).collect()} == {(1, 1), (2, 2)}
    common = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"{common} {a}"), (2, f"{common} {b}")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in spans.remove_repeated_spans(docs).collect()} == {(1, 0), (2, 0)}


@pytest.mark.parametrize(("step", "target"), [(7, 5_528_213), (13, 9_200_001), (200, 140_000_153)])
def test_all_lengths_serve_where_a_few_fall_short(monkeypatch, step, target):
    counts = {3 + step * k: 1 for k in range(849)}

    def missing():
        plan = mix.plan_source(counts, float(target))
        assert all(copies + more <= 3 and more <= 1 for copies, more in plan.values())
        return target - sum(length * (copies + more) for length, (copies, more) in plan.items())

    short = missing()
    monkeypatch.setattr(mix, "KNAPSACK_LENGTHS", 10**9)
    assert 0 <= short == missing()


def test_common_divisors_shorten_the_bitmap():
    counts = {14: 3, 21: 2, 35: 1}
    for budget in range(200):
        best = max(
            s
            for a in range(4)
            for b in range(3)
            for c in range(2)
            if (s := 14 * a + 21 * b + 35 * c) <= budget
        )
        found = mix.reachable(budget, counts)
        assert sum(k * n for k, n in found.items()) == best and all(n <= counts[k] for k, n in found.items())


def test_vectors_of_several_widths_are_an_error_wherever_they_lie(spark, tmp_path):
    kinds = "vec_id long, embedding array<float>"
    for k, width in enumerate((2, 1, 3)):
        spark.createDataFrame([(k, [1.0] * width)], kinds).write.mode("append").parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="several widths.* 1 and 3"):
        codes.near_vectors(spark.read.parquet(str(tmp_path / "v")))
    # Vectors that link with nothing may have any width.
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [float("nan")]), (5, [2.0, 0.0]), (6, [])]
    got = {r.vec_id: r.component_id for r in codes.near_vectors(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6}
