"""Merkle manifests, aligned tokenizers, templates and formatted conversations."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import align, chat, merkle
from tidemark.llm.template import Constant, TemplateError, Write, compile_template

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, key string, at long, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest ---------------------------------------------------------------------------


def leaf(row, more=0):
    n = row.n_chars if row.n_chars is None or row.n_chars + more >= 2**63 else row.n_chars + more
    if row.n_chars is not None and row.n_chars + more >= 2**63:
        n = None
    fields = (row.doc_id, row.source, row.lang, n, row.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return levels


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {g: levels_of([leaf(r) for r in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for k, r in enumerate(groups[g]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node, siblings = leaf(r, 1 if hit else 0), []
            for tree, at in ((trees[g], k), (top, place)):
                for level in tree[:-1]:
                    first = at - at % 2
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 2])
                    siblings.append(left + right)
                    node = sha(left + node + right)
                    at //= 2
            root = top[-1][0]
            out.append((r.doc_id, leaf(r), trees[g][-1][0], root, sha("".join(siblings)), node, node == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def odd_documents():
    rng = random.Random(4)
    texts = [None, "", "a", "é😀", "x" * 300_000, "1:a2:b"]
    rows = [
        (k, rng.choice(texts), rng.choice([None, "web", "books"]), rng.choice(["en", None, "", "de", "é", "zz"]), rng.choice([None, 0, 5, 2**63 - 1]))
        for k in range(700)
    ]
    rows += [(k, "only", "s", f"lone-{k}", 1) for k in range(20)]
    rows += [(None, t, "s", "en", 1) for t in "abc"] + [(3, f"again {k}", "s", "en", 1) for k in range(9)]
    rows += [(5, "repeated", "s", "de", 7)] * 40
    return [(*r, "key", 1, "other") for r in rows]


def test_every_leaf_is_proved_like_in_one_plain_tree(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).repartition(6)
    got = merkle.proved_leaves(docs).collect()
    assert ordered(got) == ordered(plain_manifest(docs.collect()))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_more_stored_levels_give_the_same_proofs(spark, levels):
    docs = spark.createDataFrame(odd_documents()[:400], DOCS)
    want = ordered(plain_manifest(docs.collect()))
    assert ordered(merkle.proved_leaves(docs, apart=levels).collect()) == want


def test_only_every_few_levels_are_stored(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = merkle.build_manifest(docs, "lang", "doc_id", {"doc_id": F.col("doc_id")}, str(tmp_path / "m"))
    stored = sum(level.selectExpr("sum(size(nodes)) as n").first().n for level in manifest.groups.levels)
    rows = docs.count()
    assert rows <= stored <= rows * (1 + 2 / merkle.FANOUT**merkle.APART) + docs.select("lang").distinct().count() * 2
    # Opened again, the stored levels prove the same leaves.
    again = merkle.open_tree(spark, str(tmp_path / "m" / "groups"), len(manifest.groups.levels))
    reopened = merkle.Manifest(again, manifest.top, manifest.root).proofs().select("doc_id", "proof")
    assert ordered(reopened.collect()) == ordered(manifest.proofs().select("doc_id", "proof").collect())


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "t", "s", "en", 1, "k", 1, "d")], DOCS)
    row = merkle.proved_leaves(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert merkle.proved_leaves(one.limit(0)).collect() == []


# --- aligned tokenizers ------------------------------------------------------------------------


def plain_alignment(texts):
    """Zeros where nothing is aligned, else counts found by walking both token lists."""
    v = align.vocabularies(*align.default_paths())
    found, counts, best = [], Counter(), Counter()
    for text in texts:
        a = v.a.encode(f" {text or ''}", add_special_tokens=False).ids
        b = v.b.encode(text or "")
        want = f" {text or ''}".encode()
        if not text or b"".join(v.a_bytes[k] for k in a) != want or b"".join(v.b_bytes[k] for k in b) != want:
            found.append(None)
            continue
        ends, at = {}, 0
        for k in b:
            at += len(v.b_bytes[k])
            ends[at] = k
        groups, links, at, done = [([], [])], [], 0, 0
        b_left = list(b)
        for k in a:
            at += len(v.a_bytes[k])
            groups[-1][0].append(k)
            if at in ends:
                while done < at:
                    groups[-1][1].append(b_left.pop(0))
                    done += len(v.b_bytes[groups[-1][1][-1]])
                links.append((k, ends[at]))
                groups.append(([], []))
        groups.pop()
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((len(a), len(b), len(groups), links, sha(text_of)))
        counts.update(links)
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if f is None
        else (f[0], f[1], f[2], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4])
        for f in found
    ], counts


def odd_texts(n):
    rng = random.Random(n)
    parts = ["a", "b", "'s", " ", "  ", "\n", "\t", "1", "23", "é", "中", "😀", "²", "<s>", "</s>", "<unk>", "<|endoftext|>"]
    parts += ["<0x41>", "▁", "word", "\x00", "\x85", "the", "ing", "Q", "~"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [*texts, None, "", " ", "the the", "the the", "q" * 5000, "the word " * 3000 + "end", "\x01\x02", "A"]


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_alignment_is_that_of_walking_both_lists(spark, chunk):
    texts = odd_texts(500)
    rows = [(k, t, "x", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, a int")
    got = {r.doc_id: tuple(r)[1:] for r in align.aligned_documents(docs, chunk_bytes=chunk).collect()}
    want, _ = plain_alignment(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert any(w[4] < w[3] for w in want) and any(w[0] == 0 for w in want)


def test_pair_counts_of_the_corpus(spark):
    texts = odd_texts(200)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.a, r.b): r.total for r in align.link_counts(docs).collect()}
    assert got == plain_alignment(texts)[1]


def test_alignment_with_odd_ids_and_without_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "some words"), (None, "some words"), (4, "some words"), (4, None)]
    got = align.aligned_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.n_a > 0) for r in got) == [(False, False), (False, True), (True, True), (True, True)]
    assert align.aligned_documents(spark.createDataFrame([], schema)).collect() == []


def test_only_unequal_tokens_enter_the_pair_shuffle(spark):
    v = align.vocabularies(*align.default_paths())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chunks = align.encode_chunks(docs, *align.default_paths()).cache()
    pairs = align.pair_counts(chunks).collect()
    assert all(v.same[r.a] != r.b for r in pairs)
    fast = align.same_counts(chunks).agg(F.sum("total")).first()[0]
    slow = sum(r.total for r in pairs)
    groups = chunks.selectExpr("sum(aggregate(n_groups, 0L, (x, y) -> x + y))").first()[0]
    assert fast + slow == groups and fast > slow
    chunks.unpersist()


# --- templates ---------------------------------------------------------------------------------


def render(source, **values):
    return compile_template(source, tuple(values)).render(**values)


@pytest.mark.parametrize(
    ("source", "values", "want"),
    [
        ("a {{ x }} b", {"x": "<&>"}, "a <&> b"),
        ("{{ x.y['z'] | upper }}{# gone #}", {"x": {"y": {"z": "q"}}}, "Q"),
        ("{% for m in ms %}{{ loop.index }}{{ m }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": ["a", "b"]}, "1a,2b"),
        ("{% if x == 1 %}one{% elif x == 2 %}two{% else %}more{% endif %}", {"x": 2}, "two"),
        ("{{ 'yes' if x is_ else 'no' }}", {"x": 1, "is_": 1}, None),
        ("{{ 'yes' if x and not y else 'no' }}", {"x": 1, "y": 0}, "yes"),
        ("{{ 'yes' if not not x else 'no' }}", {"x": 1}, "yes"),
        ("{{ x[-1] ~ x[0] ~ x[9] }}", {"x": ["a", "b"]}, "ba"),
        ("{% set y = x ~ '!' %}{{ y }}{{ y | length }}", {"x": "hi"}, "hi!3"),
        ("  {%- if true -%}  t  {%- endif -%}  ", {}, "t"),
        ("{{ 2 - 5 + 1 }}{{ -1 < 0 }}{{ none }}{{ 'a' in 'abc' }}{{ 'z' not in 'abc' }}", {}, "-2truetruetrue"),
        ("{{ '\\n\\'' }}", {}, "\n'"),
        ("{% for k in ks %}{% set x = k %}{% endfor %}{{ x }}", {"ks": [1, 2], "x": 0}, "0"),
    ],
)
def test_templates(source, values, want):
    if want is None:
        with pytest.raises(TemplateError):
            render(source, **values)
    else:
        assert render(source, **values)[0] == want


@pytest.mark.parametrize(
    "source",
    [
        "{{ y }}",
        "{{ x.__class__() }}",
        "{{ x | nothing }}",
        "{% for m in x %}",
        "{% endif %}",
        "{% while x %}{% endwhile %}",
        "{{ x",
        "{{ 'open }}",
        "{{ x x }}",
        "{% set loop = 1 %}",
        "{{ " + "(" * 100 + "x" + ")" * 100 + " }}",
        "{% if x %}" * 60 + "{% endif %}" * 60,
    ],
)
def test_bad_templates_do_not_compile(source):
    with pytest.raises(TemplateError):
        compile_template(source, ("x",))


def test_templates_reach_nothing_but_their_values():
    for source in ("{{ x.__class__ }}", "{{ x['__dict__'] }}"):
        with pytest.raises(TemplateError):
            render(source, x=object())
    assert render("{{ x.__class__ }}", x={"a": 1})[0] == ""


def test_constants_are_folded():
    t = compile_template("a{{ 'b' ~ 'c' | upper }}{% if 1 < 2 %}d{{ x }}{% else %}{{ x }}{% endif %}{{ 1 + 1 }}", ("x",))
    assert t.body == (Write(Constant("abCd")), t.body[1], Write(Constant("2")))
    # What fails on constants fails when it runs, not when it is compiled.
    late = compile_template("{% if x %}{{ 'a' - 1 }}{% endif %}", ("x",))
    assert late.render(x=False)[0] == ""
    with pytest.raises(TypeError):
        late.render(x=True)


def test_generation_marks():
    text, spans = render("{% for m in ms %}[{% generation %}{{ m }}{% endgeneration %}]{% endfor %}", ms=["ab", "", "c"])
    assert text == "[ab][][c]" and [text[a:b] for a, b in spans] == ["ab", "", "c"]


# --- conversations -----------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, part int, segment string, loss string"


def odd_turns(n):
    rng = random.Random(n)
    parts = [*chat.CONTROLS, "\\", "<", "s>", "/", "[", "INST", "ok", " ", "\n", "é", "😀"]
    roles = ["user", "assistant", "system", None, "tool", "a[ROLE]\n", ""]

    def said():
        return rng.choice([None, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3)]])

    rows = [(rng.randint(0, 60), rng.randint(0, 5), rng.choice(roles), said()) for _ in range(n)]
    # A third of all rows is one conversation, with ties and repeated rows.
    rows += [(7, k // 3, "assistant" if k % 2 else "user", said()) for k in range(n // 2)] + [(7, 1, "user", "same")] * 300
    rows += [(None, 1, "user", "x"), (99, None, "assistant", None), (98, 0, "assistant", "w" * 200_000)]
    return [(*r, 1, "s", "l") for r in rows]


def plain_summaries(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, (role or ""), (text or "")))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def test_escaped_texts_have_no_control_strings_and_come_back():
    for row in odd_turns(6000):
        text = row[3] or ""
        out = chat.escape(text)
        assert chat.unescape(out) == text
        assert not any(c in out for c in chat.CONTROLS)


@pytest.mark.parametrize("turns", [3, 256])
def test_conversations_are_read_back_as_they_were(spark, turns):
    rows = odd_turns(2000)
    segments = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(5), most_turns=turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == plain_summaries(rows)
    whole = {r.conv_id: r for r in chat.whole_conversations(segments).collect()}
    for conv, r in whole.items():
        assert (r.n_turns, len(r.text)) == (got[conv].n_turns, got[conv].formatted_chars)
        assert sha("".join(chat.unescape(r.text[a:b]) for a, b in r.loss)) == got[conv].loss_sha256
        assert len(chat.read_turns(r.text)) == r.n_turns


def test_long_conversations_leave_their_task_as_segments(spark):
    rows = odd_turns(600)
    frame = spark.createDataFrame(rows, TURNS).orderBy("conv_id", "turn", "role", "text").coalesce(1)
    turns = frame.selectExpr("conv_id", "coalesce(role, '') as role", "coalesce(text, '') as text").toArrow()
    segments = list(chat._segments(turns.to_batches(max_chunksize=64), chat.TEMPLATE, 8))
    mixed = [r for b in chat._read_back(iter(segments), 50) for r in b.to_pylist()]
    done = {r["conv_id"]: r for r in mixed if r["text"] is None}
    rest = sorted((r for r in mixed if r["text"] is not None), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["segment"]))
    assert 7 not in done and sum(r["conv_id"] == 7 for r in rest) > 10
    import pyarrow as pa

    table = pa.RecordBatch.from_pylist(rest, chat._MIXED)
    done |= {r["conv_id"]: r for b in chat._streamed(iter([table])) for r in b.to_pylist()}
    assert set(done) == {r[0] for r in rows}
    assert sum(r["n_turns"] for r in done.values()) == len(rows)


def test_a_marked_conversation_and_none(spark):
    marked = chat.marked_conversation(spark)
    row = chat.read_back(chat.format_conversations(marked)).first()
    said = "</s>[INST] ok [/INST]"
    assert row.loss_sha256 == sha(said) and row.turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n")
    assert chat.read_back(chat.format_conversations(marked.limit(0))).collect() == []


def test_templates_that_need_other_turns_are_refused(spark):
    for source in ("x{% for m in messages %}{{ m.text }}{% endfor %}", "{% for m in messages %}{{ loop.index }}{% endfor %}"):
        with pytest.raises(TemplateError):
            chat.format_conversations(chat.marked_conversation(spark), source)


def test_another_template(spark):
    source = "{% for m in messages %}{{ m.role | upper }}: {% generation %}{{ m.text }}{% endgeneration %};{% endfor %}"
    row = chat.whole_conversations(chat.format_conversations(chat.marked_conversation(spark), source)).first()
    assert row.text == "USER: </s>[INST] ok [/INST];ASSISTANT: </s>[INST] ok [/INST];"
    assert [row.text[a:b] for a, b in row.loss] == ["</s>[INST] ok [/INST]"] * 2
