"""Feeds, tables, text, vectors, merges and streams on small literal inputs."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import textfn
from tidemark.operators import checks, corpus, extract, merges, ordered, vectors
from tidemark.sources import contracts, corpora, feeds, tables
from tidemark.sources.contracts import ContractError
from tidemark.sources.tables import CacheMissing, CachePolicy
from tidemark.streaming import live


def payloads(spark, *docs, **columns):
    rows = [(json.dumps(d),) for d in docs]
    df = spark.createDataFrame(rows, "payload string")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def now():
    return F.lit("2024-01-01").cast("timestamp")


def page(*records, success=True):
    return {"success": success, "result": {"records": list(records), "total": len(records)}}


def demand(day, period):
    return {"SETTLEMENT_DATE": day, "SETTLEMENT_PERIOD": period, "ND": 1, "TSD": 2, "EXTRA": 9}


def test_demand_pages(spark):
    out = feeds.demand_rows(payloads(spark, page(demand("01-Jan-23", 1)), page(demand("02-Jan-23", 48))), now())
    assert out.schema.names == schemas.DEMAND.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.DEMAND]
    assert sorted(r["source_year"] for r in out.collect()) == [2023, 2023]
    for bad in (page(demand("01-Jan-23", 1), success=False), page(demand("01-Jan-23", 49))):
        with pytest.raises(Exception):
            feeds.demand_rows(payloads(spark, bad), now()).collect()
    with pytest.raises(ContractError, match="unrecognised"):
        feeds.demand_rows(payloads(spark, page(demand("01-Jan-23", 1), demand("2023-01-02", 1))), now())


@pytest.mark.parametrize("text,year", [("01-Jan-68", 2068), ("01-Jan-69", 1969), ("29-Feb-96", 1996), ("01-Jan-2023", 2023), ("2023-05-06T00:00:00", 2023)])
def test_date_formats(spark, text, year):
    df = spark.createDataFrame([(text,), (None,)], "d string")
    assert {r[0].year for r in feeds.parse_dates(df, "d").collect() if r[0]} == {year}


def test_weather_arrays(spark):
    good = {"hourly": {"time": ["2023-01-01T00:00", "2023-01-01T01:00"], "temperature_2m": [1.5, None], "cloud_cover": [40, None]}}
    out = feeds.weather_rows(payloads(spark, good, station="s"), now(), ("temperature_2m", "cloud_cover"))
    rows = out.orderBy("timestamp_utc").collect()
    assert [(r["temperature_2m"], r["cloud_cover"], r["wind_speed_10m"]) for r in rows] == [(1.5, 40, None), (None, 0, None)]
    short = {"hourly": {"time": ["2023-01-01T00:00"], "temperature_2m": [1.0, 2.0], "cloud_cover": [1]}}
    for bad in (short, {"hourly": {"time": ["2023-01-01T00:00"], "temperature_2m": [1.0]}}, {}):
        with pytest.raises(Exception, match="unequal"):
            feeds.weather_rows(payloads(spark, bad, station="s"), now(), ("temperature_2m", "cloud_cover")).collect()


def division(*events):
    return {"division": "x", "events": list(events)}


def test_holiday_feed(spark):
    event = {"title": "New Year", "date": "2024-01-01", "notes": "", "bunting": True}
    bare = {"title": "Other", "date": "2024-01-02"}
    feed = {"england-and-wales": division(event), "scotland": division(event, bare), "northern-ireland": division()}
    rows = feeds.holiday_rows(payloads(spark, feed), now()).collect()
    assert len(rows) == 3 and {(r["notes"], r["bunting"]) for r in rows} == {("", True), ("", False)}
    unknown = {**feed, "wales": division()}
    missing = {k: v for k, v in feed.items() if k != "scotland"}
    no_date = {**feed, "scotland": division({"title": "x"})}
    for bad in (unknown, missing, no_date):
        with pytest.raises(Exception):
            feeds.holiday_rows(payloads(spark, bad), now()).collect()


def test_outage_feed(spark):
    message = {"mrid": "A", "revisionNumber": 1, "publishTime": "2024-01-01T23:54:02Z", "eventStartTime": "2024-01-01T00:00:00+01:00", "eventEndTime": "", "unavailableCapacity": 5}
    row = feeds.outage_rows(payloads(spark, [message]), now()).first()
    assert row["message_status"] == "Unknown" and row["effective_to"] is None and row["affected_mw"] == 5.0
    assert row["effective_from"].isoformat() == "2023-12-31T23:00:00"
    naive = {**message, "publishTime": "2024-01-01T00:00:00"}
    short = {k: v for k, v in message.items() if k != "mrid"}
    for bad in ([naive], [short]):
        with pytest.raises(Exception):
            feeds.outage_rows(payloads(spark, bad), now()).collect()


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(page(demand("2024-01-01", 1))))
    (tmp_path / "b.json").write_text(json.dumps(page(demand("2024-01-02", 1)), indent=1))
    assert feeds.demand_rows(feeds.read_payloads(spark, str(tmp_path)), now()).count() == 2


def test_a_stream_of_demand_pages_names_its_date_format(spark, tmp_path):
    for day in (1, 2):
        (tmp_path / f"{day}.json").write_text(json.dumps(page(demand(f"2024-01-0{day}", 1))))
    stream = spark.readStream.schema("value string").option("wholetext", True).text(str(tmp_path))
    payloads = stream.withColumnRenamed("value", "payload")
    with pytest.raises(ContractError, match="one date format"):
        feeds.demand_rows(payloads, now())
    rows = feeds.demand_rows(payloads, now(), formats=["yyyy-MM-dd"])
    days = {str(r.settlement_date) for r in live.drain(rows, "demand").collect()}
    assert days == {"2024-01-01", "2024-01-02"}


def test_narrowing_overflow_fails(spark):
    big = spark.range(1).select(F.lit(300).alias("settlement_period"))
    contract = schemas.T.StructType([schemas.DEMAND["settlement_period"]])
    with pytest.raises(Exception, match="OVERFLOW"):
        contracts.cast_to_contract(big, contract).collect()


def test_materialise_policies_and_failed_write(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(CacheMissing):
        tables.materialise(spark, path, lambda: spark.range(1), CachePolicy.OFFLINE)
    assert tables.materialise(spark, path, lambda: spark.range(3)).count() == 3
    assert tables.materialise(spark, path, lambda: spark.range(9)).count() == 3
    assert tables.materialise(spark, path, lambda: spark.range(5), CachePolicy.REFRESH).count() == 5
    broken = spark.range(4).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        tables.replace_table(broken, path)
    assert spark.read.parquet(path).count() == 5


def test_a_crash_between_the_renames_leaves_a_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    real = tables._filesystem

    class Failing:
        """A file system that stops at its second rename."""

        def __init__(self, fs):
            self.fs, self.renames = fs, 0

        def rename(self, *names):
            self.renames += 1
            if self.renames == 2:
                raise OSError("power cut")
            return self.fs.rename(*names)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    failing = Failing(real(spark, path)[0])
    monkeypatch.setattr(tables, "_filesystem", lambda spark, path: (failing, real(spark, path)[1]))
    with pytest.raises(OSError, match="power cut"):
        tables.replace_table(spark.range(5), path)
    monkeypatch.undo()
    assert not (tmp_path / "t").exists()
    assert tables.materialise(spark, path, lambda: spark.range(9), CachePolicy.OFFLINE).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    # A first write that stops half way is no table.
    spark.range(2).write.parquet(str(tmp_path / "u.incoming-x"))
    assert not tables.table_exists(spark, str(tmp_path / "u"))


def test_unique_keys_and_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x")], "k int, w string")
    assert checks.checked_join(left, right, ["k"], "left", "many_to_one").count() == 2
    with pytest.raises(checks.KeyViolation):
        checks.checked_join(left, right, ["k"], "left", "one_to_one")
    with pytest.raises(checks.KeyViolation):
        checks.checked_join(right, left, ["k"], "left", "many_to_one")


def test_feature_resolution(spark):
    assert len(checks.feature_set_columns("with_remit")) == 5 + 45 + 3
    assert "remit_unavail_mw_next_24h" not in checks.feature_set_columns("with_remit", drop_forward=True)
    assert checks.single_active(a=None, b=1) == "b"
    with pytest.raises(ContractError):
        checks.single_active(a=1, b=2)
    with pytest.raises(ContractError):
        checks.resolve_features(spark.range(1))
    with pytest.raises(ContractError):
        contracts.require_instants(spark.range(1).select(F.current_date().alias("d")), "d")


def test_fingerprint_is_ordered_and_width_sensitive_only_in_shape(spark):
    def fp(texts, width=3):
        df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
        return tables.corpus_fingerprint(df, "pos", "text", width).first()[0]

    texts = [f"t{i}" for i in range(11)]
    assert fp(texts) == fp(list(texts))
    assert fp(texts) != fp(texts[::-1])
    assert fp(["foo", ""]) != fp(["", "foo"])
    assert fp([]) == hashlib.sha256(b"").hexdigest()


def test_vector_cache_key(spark, tmp_path):
    path, calls = str(tmp_path / "v"), []

    def build():
        calls.append(1)
        return spark.range(2)

    for print_of, model, force, hit in (("a", "m", False, False), ("a", "m", False, True), ("b", "m", False, False), ("b", "n", False, False), ("b", "n", True, False)):
        assert tables.cached_vectors(spark, path, print_of, model, build, force)[1] is hit
    assert len(calls) == 4


def test_hash_vector_matches_hashlib(spark):
    def want(text, dim):
        seed, out = text.encode(), b""
        while len(out) < dim * 4:
            seed = hashlib.sha256(seed).digest()
            out += seed
        v = np.frombuffer(out[:dim], dtype=np.uint8).astype("float32") - 128
        return v / np.linalg.norm(v)

    df = spark.createDataFrame([("héllo",), ("",)], "t string")
    for dim in (8, 40, 70):
        for row in df.select("t", vectors.HashEmbedder(dim).batch(F.col("t")).alias("v")).collect():
            assert row["v"] == pytest.approx(want(row["t"], dim).tolist(), abs=1e-6)
    asked = df.select("t", vectors.HashEmbedder(8).query(F.col("t")).alias("v")).first()
    assert asked["v"] == pytest.approx(want("query: héllo", 8).tolist(), abs=1e-6)


def test_text_synthesis(spark):
    fields = "message_description string, event_type string, cause string, fuel_type string, affected_unit string"
    rows = [("  note ", "a", "b", "c", "d"), ("  ", "a", None, " c ", ""), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, fields)
    assert [r[0] for r in df.select(textfn.embeddable_text()).collect()] == ["note", "a c", ""]


def test_top_k_contract(spark, monkeypatch):
    corpus_rows = [(i, [float(i % 3), 1.0, float(i == 7)]) for i in range(30)]
    df = spark.createDataFrame(corpus_rows, "id int, vector array<float>").repartition(4)
    asked = spark.createDataFrame([("q", [1.0, 1.0, 0.0]), ("zero", [0.0, 0.0, 0.0])], "query_id string, vector array<float>")
    def brute(q, k):
        v = np.array([r[1] for r in corpus_rows])
        n = np.linalg.norm(q) or 1.0
        s = np.round(v @ np.array(q) / np.linalg.norm(v, axis=1) / n, 6)
        return sorted(zip(-s, range(30), strict=True))[:k]
    for k in (3, 11, 99):
        got = vectors.top_k(df, asked, k).orderBy("query_id", "rank").collect()
        for qid, q in (("q", [1.0, 1.0, 0.0]), ("zero", [0.0, 0.0, 0.0])):
            assert [(r["id"]) for r in got if r["query_id"] == qid] == [i for _, i in brute(q, k)]
    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 1)
    assert vectors.top_k(df, asked, 3).count() == 6
    assert vectors.top_k(df, asked, 0).count() == 0
    with pytest.raises(Exception, match="query 2"):
        vectors.top_k(df, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>"), 1).collect()
    with pytest.raises(Exception, match="vector length"):
        vectors.index_rows(df, "vector", 4).collect()


PATTERN = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
TEXTS = [
    "it's  they'll\n\nGo 42x!!  end  ",
    "naïve café  x y 的中文 ١٢",
    "aaaa aaaa abab ababab", "", " \t ",
]


def test_pretokens_match_regex(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").union(docs)
    texts = [r[0] for r in df.collect()]
    want = Counter(t for text in texts for t in PATTERN.findall(text))
    got = {r["token"]: r["freq"] for r in corpus.pretoken_counts(df).collect()}
    assert got == dict(want)


def plain_merges(freqs, steps):
    words = {tuple(bytes([b]) for b in w.encode()): f for w, f in freqs.items()}
    out = []
    for _ in range(steps):
        pairs = Counter()
        for w, f in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += f
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        merged = {}
        for w, f in words.items():
            new, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    new.append(w[i] + w[i + 1])
                    i += 2
                else:
                    new.append(w[i])
                    i += 1
            merged[tuple(new)] = merged.get(tuple(new), 0) + f
        words = merged
        total = sum(len(w) * f for w, f in words.items())
        out.append((best[0].hex().upper(), best[1].hex().upper(), pairs[best], total))
    return out


@pytest.mark.parametrize("source", ["literal", "documents"])
def test_merges_match_a_plain_loop(spark, sf, source):
    if source == "literal":
        df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
        steps = 500
    else:
        df = spark.read.parquet(f"{sf}/documents.parquet").select("text")
        steps = 25
    counts = corpus.pretoken_counts(df)
    freqs = {r["token"]: r["freq"] for r in counts.collect()}
    trained = merges.train_merges(counts, steps)
    assert [h[1:] for h in trained.history] == plain_merges(freqs, steps)
    vocabulary = trained.vocabulary()
    assert len(vocabulary) == 257 + len(trained.pairs) and vocabulary[256] == b"<|endoftext|>"


@pytest.mark.parametrize("held", [2, 20])
def test_merges_with_few_held_pairs(spark, held):
    # "aab" and "ab" lead to one symbol on two ways; "aaaa" overlaps itself.
    words = {"aab": 9, "ab": 8, "aaaa": 7, "abab": 5, "baab": 5, "cd": 5, "cdcd": 4, "é": 3, "x": 50, "aabaab": 2}
    counts = spark.createDataFrame(list(words.items()), "token string, freq long")
    trained = merges.train_merges(counts, 14, held=held)
    assert [h[1:] for h in trained.history] == plain_merges(words, 14)
    assert held == 20 or trained.rankings > 1


def test_merges_of_many_short_words(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abc"), rng.integers(1, 9))): int(rng.integers(1, 9)) for _ in range(200)}
    counts = spark.createDataFrame(list(words.items()), "token string, freq long")
    trained = merges.train_merges(counts, 25, held=15)
    assert [h[1:] for h in trained.history] == plain_merges(words, 25)
    # A pass ends with a merge whose symbol was there before, and at the floor.
    ranked = [("61", "62", 9), ("63", "64", 8), ("65", "66", 7), ("67", "68", 3)]
    assert merges.independent_head(ranked, 3, {"61", "6162"}) == ranked[:1]
    assert merges.independent_head(ranked, 3, {"61", "6364"}) == ranked[:2]
    assert merges.independent_head(ranked, 3, set()) == ranked[:3]


def test_words_are_spelled_alike_by_text_and_by_symbols(monkeypatch):
    hexed = lambda text: "".join(f"{b:02X}" for b in text.encode())
    made = [(hexed(a), hexed(b)) for a, b in [("a", "a"), ("aa", "a"), ("a", "b"), ("b", "aa"), ("ab", "ab"), ("aa", "aa")]]
    words = ["".join(f"|{b:02X}|" for b in w.encode()) for w in ["a", "aaaaa", "aaaaaaaa", "abab", "baab", "aabaaab", "ababababab"]]
    speller = merges.Speller(made)
    by_text = [speller.spell(w) for w in words]
    monkeypatch.setattr(merges, "FEW_MERGES", 0)
    assert by_text == [speller.spell(w) for w in words]
    assert [speller.fenced(w)[1:-1].split("||") for w in words] == by_text


def test_changes_of_a_merge_are_those_of_its_surroundings():
    import pyarrow as pa

    words = ["".join(f"|{b:02X}|" for b in w) for w in (b"xabyz", b"aaaa", b"zzab", b"q")]
    rows = pa.RecordBatch.from_arrays([pa.array(words * 2), pa.array([3, 5, 7, 1] * 2)], names=["word", "freq"])
    out = [r for b in merges._merge([rows], [], [("61", "62")]) for r in b.to_pylist()]
    moved = {(r["left"], r["right"]): r["n"] for r in out if r["left"] and r["word"] is None}
    assert moved == {("78", "61"): -3, ("61", "62"): -10, ("62", "79"): -3, ("78", "6162"): 3, ("6162", "79"): 3, ("7A", "61"): -7, ("7A", "6162"): 7}
    assert {(r["left"], r["right"], r["freq"]) for r in out if r["word"]} == {("78", "6162", 3), ("6162", "79", 3), ("7A", "6162", 7)}
    assert [(r["merge"], r["saved"]) for r in out if r["merge"] is not None] == [(0, 10)]
    # Each word is met once; two do not hold the pair.
    assert [(r["n"], r["saved"]) for r in out if r["left"] is None and r["merge"] is None] == [(4, 2)]


def test_the_report_cuts_its_texts_once(spark):
    from tidemark.plans import reports

    docs = spark.createDataFrame([("the cat the hat",), ("",)], "text string")
    report = reports.corpus_report(docs, 2)
    assert "regexp_extract_all" not in report["pretokens"]._jdf.queryExecution().toString()
    assert {tuple(r) for r in report["pretokens"].collect()} == {("the", 1), (" cat", 1), (" the", 1), (" hat", 1)}


def test_a_pass_reads_the_words_of_its_pairs_only(spark, sf):
    counts = corpus.pretoken_counts(spark.read.parquet(f"{sf}/documents.parquet").select("text")).cache()
    trained = merges.train_merges(counts, 40)
    freqs = {tuple(bytes([b]) for b in r["token"].encode()): r["freq"] for r in counts.collect()}
    at, read = 0, 0
    for one in trained.passes:
        pairs = [tuple(bytes.fromhex(x) for x in p) for p in trained.pairs[at : at + one.merges]]
        touched = sum(any(p in pairs for p in zip(w, w[1:], strict=False)) for w in freqs)
        assert one.words_touched == touched
        # Void postings are few: pairs that other merges took from a word.
        assert one.postings_read <= 3 * touched + 20
        for a, b in pairs:
            merged = {}
            for w, f in freqs.items():
                new = []
                for s in w:
                    if new and new[-1] == a and s == b:
                        new[-1] = (a + b, "joined")
                    else:
                        new.append(s)
                new = tuple(x[0] if isinstance(x, tuple) else x for x in new)
                merged[new] = merged.get(new, 0) + f
            freqs = merged
        at += one.merges
        read += one.postings_read
    assert read < len(trained.passes) * len(freqs) / 4
    counts.unpersist()


def test_merge_pair_does_not_overlap(spark):
    row = spark.range(1).select(
        textfn.merge_pair(F.array(*(F.lit("61") for _ in range(5))), "61", "61").alias("a"),
        textfn.merge_pair(F.array(F.lit("6161"), F.lit("61")), "61", "61").alias("b"),
        textfn.merge_pair(F.array().cast("array<string>"), "61", "61").alias("c"),
    ).first()
    assert row["a"] == ["6161", "6161", "61"] and row["b"] == ["6161", "61"] and row["c"] == []


def test_separated_corpus(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("one\ntwo\n<|endoftext|>\n  \n<|endoftext|>\nthrée \n<|endoftext|>\n", encoding="utf-8")
    assert sorted(r[0] for r in corpora.read_documents(spark, str(path)).collect()) == ["one\ntwo", "thrée"]
    profile = corpus.profile(corpora.read_pieces(spark, str(path))).first()
    assert (profile["documents"], profile["bytes"], profile["len_max"]) == (2, 13, 7.0)


def test_sample_is_repeatable(spark):
    df = spark.range(4000)
    texts = df.withColumn("text", F.repeat(F.lit("é"), 5))
    sized = corpora.sample_to_bytes(texts, "id", "text", 10_000, seed=2).agg(F.sum(F.octet_length("text"))).first()[0]
    assert 8_500 < sized < 11_500 and corpora.sample_to_bytes(texts, "id", "text", 10**9).count() == 4000
    a = {r[0] for r in corpora.bernoulli_sample(df, "id", 0.3, 1).collect()}
    assert a == {r[0] for r in corpora.bernoulli_sample(df.repartition(3), "id", 0.3, 1).collect()}
    assert 1000 < len(a) < 1400
    assert a != {r[0] for r in corpora.bernoulli_sample(df, "id", 0.3, 2).collect()}


def test_plug_in_model_never_raises(spark):
    log = spark.createDataFrame([], schemas.OUTAGES)
    row = spark.createDataFrame(
        [("A", 1, "Planned stop"), ("B", 1, "boom")], "mrid string, revision_number int, message_description string"
    )
    log = log.unionByName(
        row.select(*(F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.OUTAGES)).withColumn("effective_from", now())
    )

    def load():
        def answer(texts):
            return [None if "boom" in t else {"event_type": "Outage", "confidence": 0.5} for t in texts]

        return answer

    out = {r["mrid"]: r for r in extract.extracted_table(log, extract.ModelExtractor(load, "m1", "p"), now()).collect()}
    assert (out["A"]["event_type"], out["A"]["model_id"]) == ("Outage", "m1")
    assert (out["B"]["event_type"], out["B"]["confidence"], out["B"]["model_id"]) == ("Other", 0.0, None)

    def broken():
        def answer(texts):
            raise RuntimeError("down")

        return answer

    rows = extract.ModelExtractor(broken, "m1", "p").extract(log).collect()
    assert {r["event_type"] for r in rows} == {"Other"}


def test_plug_in_embedder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    model = vectors.ModelEmbedder(2, "len", load)
    row = spark.createDataFrame([("abc",)], "t string").select(
        model.batch(F.col("t")).alias("b"), model.query(F.col("t")).alias("q")
    ).first()
    assert row["b"] == [3.0, 1.0] and row["q"] == [10.0, 1.0]


def test_stream_state_keeps_highest_revision(spark, tmp_path):
    """A late low revision must not replace a higher one that came before it."""
    schema = "mrid string, revision_number int, message_status string"
    source = str(tmp_path / "in")
    for batch in ([("A", 2, "Active"), ("B", 0, "Active")], [("A", 1, "Active"), ("B", 1, "Withdrawn")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    updates = live.drain(live.current_state(stream), "state", "update")
    state = live.newest(updates, ["mrid"])
    assert [(r["mrid"], r["revision_number"]) for r in live.known(state).collect()] == [("A", 2)]


def test_row_index_over_documents_is_dense(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    placed = ordered.row_index(docs, "doc_id", cut=ordered.width(64), name="pos")
    assert sorted(r["pos"] for r in placed.collect()) == list(range(docs.count()))
