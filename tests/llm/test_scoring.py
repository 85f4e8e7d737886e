"""Mixing, packing, token counts, quality, language and main text."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_duplicates import least_label, normal, shingle_set
from tidemark.llm import html, langid, mix, pack, quality, queries, tokens
from tools_check import canonical

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, size long, pieces string, lang string"


def doc(k, text, source="s", lang="en"):
    return (k, text, source, 1, "p", lang)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def odd_texts(n):
    rng = random.Random(n)
    parts = ["a", "b", "'s", "'re", "'ll", "'", "s", " ", "  ", "\n", "\t", "1", "23", "!", "?!", "é", "中", "😀", "²", "Ⅷ"]
    parts += ["don't", "<|endoftext|>", "<|", "\x00", "\x85", "\x1c", "'S", "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return texts + ["", " " * 3000, "a" * 3000, "ab" * 2000, "'" * 500, "the the " * 4000, "\n" * 700 + "x"]


def test_token_counts_are_the_librarys(spark):
    texts = [None, *odd_texts(3000)]
    rows = [doc(k, t) for k, t in enumerate(texts)] + [doc(None, "null id"), doc(1, texts[1])]
    got = tokens.token_counts(spark.createDataFrame(rows, DOCS)).collect()
    want = [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), want[r.doc_id])
            assert r.over_limit == (want[r.doc_id] > 512)
    assert tokens.token_counts(spark.createDataFrame([], DOCS)).collect() == []


def test_prefix_scan_gives_the_states_of_a_sequential_run():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 8, (77, 8)).astype(np.uint8)
    state, want = tokens.CLOSED, []
    for row in maps:
        want.append(state)
        state = row[state]
    assert tokens.entry_states(maps).tolist() == want


def test_packing_places_every_piece_once_and_without_gaps(spark):
    texts = odd_texts(400)
    rows = [doc(k, t) for k, t in enumerate(texts)] + [doc(900, None), doc(None, "null id"), doc(901, "again"), doc(901, "again")]
    got = pack.pack_documents(spark.createDataFrame(rows, DOCS)).toPandas()
    encode = library()
    want = []
    for r in rows:
        ids = np.array(encode.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    mine = [
        (None if np.isnan(d) else int(d), *map(int, rest))
        for d, *rest in got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(float).itertuples(index=False)
    ]
    assert sorted(mine, key=str) == sorted(want, key=str)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * sum(w[3] for w in want) / 2048 + 1
    assert pack.pack_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_packing_takes_texts_with_very_long_white_space(spark):
    texts = ["a" + " " * 1_000_100 + "b", "\n" * 1_000_100 + "x", "\t" * 1_000_100, "<|endoftext|>" + " " * 1_000_100 + "x", "short"]
    got = pack.pack_documents(spark.createDataFrame([doc(k, t) for k, t in enumerate(texts)], DOCS)).toPandas()
    encode = library()
    want = set()
    for k, text in enumerate(texts):
        ids = np.array(encode.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for piece, (start, n) in enumerate(pack.piece_bounds(len(ids))):
            want.add((k, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
    mine = list(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert len(mine) == len(want) and set(mine) == want


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, n = pack.best_fit(np.array([6, 5, 4, 3, 2]), room=10)
    assert n == 2
    assert bins.tolist() == [0, 1, 0, 1, 1]
    assert offsets.tolist() == [0, 0, 6, 5, 8]


def test_targets_reshare_what_a_small_source_cannot_take():
    assert mix.targets([]) == []
    assert mix.targets([0, 0]) == [0, 0]
    assert mix.targets([10, 90]) == [30, 70]
    got = mix.targets([10, 10, 980])
    assert got == [30, 30, 940] and sum(got) == 1000


def test_reachable_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        budget = rng.randint(0, 80)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = mix.reachable(budget, counts)
        assert all(taken[k] <= counts[k] for k in taken)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= budget)


def test_mix_meets_its_targets_and_repeats_itself(spark):
    rng = random.Random(7)
    rows = [doc(k, "w " * rng.randint(0, 60), rng.choice(["a", "b", "ü", "b", "b", None, "Z"])) for k in range(1500)]
    rows += [doc(2000, None, "a"), doc(None, "w " * 9, "a"), doc(2001, "", "empty"), doc(3, rows[3][1], rows[3][2])]
    table = spark.createDataFrame(rows, DOCS)
    got = mix.mix_sources(table).toPandas()
    assert len(got) == len(rows)
    total, sizes = 0, {}
    for r in rows:
        n = len((r[1] or "").split())
        sizes[r[2]] = sizes.get(r[2], 0) + n
        total += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mix.targets([sizes[s] for s in order]), strict=True))
    assert abs(sum(goals.values()) - total) < 1e-6
    for source, part in got.groupby("source", dropna=False):
        source = source if isinstance(source, str) else None
        assert (part.source_size == sizes[source]).all()
        assert np.allclose(part.target, goals[source])
        assert abs(part.taken.sum() - goals[source]) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    again = mix.mix_sources(table.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert mix.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    assert mix.take_mix(table).count() == got.repeats.sum()


def test_quality_on_the_held_out_fold(spark):
    # Over 800 labelled documents of the larger table are held out.
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op3_quality_classifier"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (out.predicted == out.quality).mean() > 0.95


def test_quality_of_odd_rows_and_without_labels(spark):
    rows = [doc(1, None), doc(2, ""), doc(3, " \n"), doc(None, "a b c"), doc(4, "x" * 100_000), doc(4, "x"), doc(5, "a a a " * 5000)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(docs, none).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 for r in got)
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 0), (5, 0), (5, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs, some).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(spark.createDataFrame([], DOCS), some).collect() == []


def test_newton_finds_the_posterior():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((4000, 1)), rng.standard_normal((4000, 1))], 1)
    truth = np.array([0.7, 1.5])
    y = rng.random(4000) < 1 / (1 + np.exp(-x @ truth))
    positives = x[y]

    def passes(w):
        z = x @ w
        s = 1 / (1 + np.exp(-z))
        zp = positives @ w
        up, down = np.logaddexp(0, zp).mean(), np.logaddexp(0, -zp).mean()
        return positives.mean(0), s @ x / 4000, (x * (s * (1 - s))[:, None]).T @ x / 4000, np.logaddexp(0, z).mean(), up, down

    assert np.allclose(quality.newton(passes, 2, y.mean()), truth, atol=0.2)


def test_language_on_the_held_out_fold(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"), "text").toPandas()
    both = got[got.doc_id.notna()].merge(docs, on="doc_id")
    out = both[[zlib.crc32(str(int(d)).encode()) % 5 == 0 for d in both.doc_id]]
    assert (out.lang == out.truth).mean() > 0.97
    assert both.kept.mean() > 0.99
    assert got.page_id.notna().sum() == 250 and got[got.page_id.notna()].kept.all()


def test_languages_of_odd_rows(spark):
    known = [doc(k, t * 30, lang=lang) for k in range(40) for t, lang in (("the of and then ", "en"), ("der und die nicht ", "de"))]
    odd = [doc(900, None), doc(901, ""), doc(902, "12 34 !!"), doc(None, "the"), doc(903, "the of", source=None), doc(0, known[0][1])]
    docs = spark.createDataFrame(known + odd, DOCS)
    model = langid.train_text_model(docs.select("doc_id", "text", "lang"))
    got = langid.identify(langid.document_evidence(docs), model, ["doc_id"]).collect()
    assert len(got) == len(known) + len(odd)
    verdict = {r.doc_id: r for r in got}
    assert not any(verdict[k].kept for k in (900, 901, 902))
    assert verdict[903].kept and verdict[903].lang == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in known} | {None, 903}
    none = spark.createDataFrame([], DOCS)
    assert langid.keep_identified(none).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == docs.count()


def test_main_text_of_the_pages(spark):
    import html as entities
    import re

    got = queries.QUERIES["op10_html_main_text"](spark, SF).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    right = 0
    for page in pages.itertuples():
        body = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        lines = [entities.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?(?:p|h1)>", body)]
        lines = [re.sub(r"\s+", " ", x).strip() for x in lines]
        text = got.text[page.page_id]
        right += text == "\n".join(x for x in lines if x)
        assert got.n_chars[page.page_id] == len(text)
    assert len(got) == len(pages) and right / len(pages) > 0.97


def test_main_text_of_odd_pages(spark):
    kind = "page_id long, url string, html string, text string"
    article = "<html><body><nav><a href=1>Home</a></nav><article><h1>T{0}</h1><p>{1}</p></article></body></html>"
    rows = [(k, "u", article.format(k, "some words of a text. " * 8), "x") for k in range(30)]
    rows += [(100, None, None, "x"), (101, "u", "", "x"), (None, "u", "<p>a", "x"), (102, "u", "<" * 3000, "x"), (3, "u", rows[3][2], "x")]
    rows += [(103, "u", "<script>if (a<b) x('</p>')</script>" + "<div>" * 300 + "a", "x")]
    got = html.extract_main_text(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[100] == texts[101] == ""
    assert html.extract_main_text(spark.createDataFrame([], kind)).collect() == []


@pytest.mark.parametrize("mark, least", [(' class="{}"', 0.9), ("", 0.4)])
def test_main_text_of_pages_without_article_elements(spark, mark, least):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    as_given = queries.QUERIES["op10_html_main_text"](spark, SF).toPandas().set_index("page_id").text
    names = {"article": "content", "nav": "nav", "footer": "footer"}
    for name, said in names.items():
        pages["html"] = [re.sub(f"<{name}>", f"<div{mark.format(said)}>", x).replace(f"</{name}>", "</div>") for x in pages.html]
    assert not pages.html.str.contains("<article|<main").any()
    got = html.extract_main_text(spark.createDataFrame(pages)).toPandas()
    assert len(got) == len(pages)
    assert (got.text == as_given[got.page_id].to_numpy()).mean() > least
    assert (got.text != "").mean() > 0.9


def test_main_text_where_every_id_is_null(spark):
    page = "<html><body><nav><a href=1>Home</a></nav><article><h1>T{0}</h1><p>{1}</p></article></body></html>"
    rows = [(None, "u", page.format(k, "some words of a text. " * 8)) for k in range(60)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 60 and all("some words of a text." in r.text for r in got)


def test_dom_closes_what_pages_leave_open():
    dom = html.Dom("<p>a<b>b<p>c</b> &amp d&eacute;<ul><li>x<li>y</ul><style>p{}</style>z<!-- no --><br>q")
    assert html.block_text(dom, np.ones(len(dom.names), bool)) == "ab\nc & dé\nx\ny\nz q"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=it's>Hello world</p><p>it's fine</p>", "Hello world\nit's fine"),
        ('<a href="x"">one</a> two', "one two"),
        ('<p title="abc>Hello</p><p>x', "Hello\nx"),
        ('<a b = "c>d" e>f', "f"),
        ("<script src=/x/>code()</script>k", "k"),
        ('<script>var a = "<!--", b = a<c && "</p>";</script>text', "text"),
        ("<!-->x<!-- y -->z", "xz"),
        ("<p>E is <math><mi>m</mi><mo>c</mo></math> so</p>", "E is mc so"),
        ("<p>u <object data=x>v</object> <noscript>n</noscript> w</p>", "u v n w"),
        ('<div><svg><path d="1">in</div><p>after</p>', "after"),
        ('<div><svg><path d="1"/><p>out</p></div>', "out"),
        ("<p>a<select><option>x</p><p>b</p>", "a\nb"),
        ("<div><object>a</div>b", "a\nb"),
        ("<head><title>abc</head><p>x", "x"),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>yes", "yes"),
    ],
)
def test_malformed_markup_loses_no_text(page, want):
    dom = html.Dom(page)
    assert html.block_text(dom, np.ones(len(dom.names), bool)) == want


def test_unfinished_markup_takes_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 200_000, '<a b="' * 100_001, "<title>" * 50_000, "<p '" * 100_000 + ">", "<script" * 50_000, "<!--" * 100_000):
        html.Dom(page)
    assert time.time() - began < 20


def test_decoding_keeps_below_what_is_kept():
    parent = np.array([-1, 0, 1, 1, 0])
    main, mixed = np.array([0.5, 0.9, 0.9, 0.2, 0.1]), np.array([0.9, 0.01, 0, 0, 0])
    assert html.decode(main, mixed, parent).tolist()[1:] == [True, True, True, False]


def test_exact_dedup_agrees_with_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op8_exact_dedup"](spark, SF).toPandas()
    assert canonical(got) == canonical(con.execute(queries.ORACLES["op8_exact_dedup"]).df())


def test_pipeline_stages_against_plain_loops(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {}
    frame = source
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF).persist()
        docs[name] = frame
        if name != "pack_sequences":
            assert frame.columns == source.columns
    identified = docs["language_id"].collect()
    assert len(identified) >= 0.99 * source.count()
    first = {}
    for r in sorted(identified, key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r.doc_id)
    exact = docs["exact_dedup"].collect()
    assert sorted(r.doc_id for r in exact) == sorted(first.values())
    sets = {r.doc_id: shingle_set(r.text) for r in exact}
    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    common = {}
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [p for p, n in common.items() if 100 * n >= 80 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    label = least_label(set(sets), links)
    near = docs["near_dedup"].collect()
    assert sorted(r.doc_id for r in near) == sorted(k for k, v in label.items() if k == v)
    size = {r.doc_id: len(r.text.split()) for r in near}
    by_source = {}
    for r in near:
        by_source[r.source] = by_source.get(r.source, 0) + size[r.doc_id]
    taken = {}
    mixed = docs["mix_sources"].collect()
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    goals = mix.targets([by_source[s] for s in sorted(by_source)])
    for s, goal in zip(sorted(by_source), goals, strict=True):
        assert abs(taken.get(s, 0) - goal) < 0.02 * goal + 100
    packed = docs["pack_sequences"].toPandas()
    assert (packed.piece == 0).sum() == len(mixed)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_their_columns(spark, name):
    want = {
        "op1": "doc_id n_shingles component_id kept",
        "op2": "doc_id size source_size target taken",
        "op3": "doc_id held_out score predicted",
        "op4": "doc_id n_bytes n_tokens over_limit",
        "op5": "doc_id piece start length ids_crc32 sequence_id offset",
        "op6": "doc_id page_id lang kept",
        "op7": "vec_id n_links component_id kept",
        "op8": "doc_id keep_id group_size kept text_sha256",
        "op9": "doc_id n_words n_removed kept_sha256",
        "op10": "page_id url text n_chars",
        "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
        "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
        "op13": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    }[name.split("_")[0]]
    assert set(want.split()) <= set(queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns)


def test_slices_hold_whole_rows():
    from tidemark.llm import frames

    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "b" * 50, "", "c"])})
    parts = list(frames.text_slices(batch, "text", 20))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) == 3
