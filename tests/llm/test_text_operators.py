"""Token output, fingerprints, main text, language and quality against plain Python."""

import hashlib
import random
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from agronimbus.llm import fingerprints, html_extract, language_id, quality, text, token_output
from agronimbus.plans.storage import new_folder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string"
LONG = "word " * 30_000
ODD = [
    (5, "Hello, hello world! don't stop 42"), (1, None), (9, ""), (2, "   \n\t "), (7, "a<|endoftext|>b C"), (7, "a<|endoftext|>b C"),
    (3, "é́x İstanbul. 中文字。 **bold** x- 'll"), (4, "one two three four"), (None, "no id"), (6, LONG),
]


@pytest.fixture
def odd(rows):
    clash = "doc_id bigint, text string, start bigint, score string, lang string, held_out int, tie int, ids int"
    return rows([(i, t, 1, "x", "en", 0, 1, 2) for i, t in ODD], clash)


# --- memory of workers ------------------------------------------------------------


class Caught:
    """Stands for a DataFrame and keeps the function that Spark's tasks would run."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(_agronimbus_shipped=True))
    schema, dtypes = "", [("doc_id", "bigint")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def withColumnRenamed(self, *_):
        return self


@pytest.mark.parametrize("operator", ["keep_good", "score", "keep_known", "identify"])
def test_texts_of_a_batch_are_taken_a_few_at_a_time(operator):
    n = 3 * text.TEXTS_AT_ONCE + 5
    batch = pa.record_batch([pa.array(range(n)), pa.array([None, "", "a word"] * (n // 3) + ["b"] * (n % 3))], ["doc_id", "text"])
    caught = Caught()
    if operator in ("keep_good", "score"):
        getattr(quality, operator)(caught, quality.Network(bias=1.0))
    else:
        getattr(language_id, operator)(caught, language_id.Model())
    found = list(caught.run(iter([batch, batch.slice(0, 0), batch.slice(0, 7)])))
    assert max(b.num_rows for b in found) <= text.TEXTS_AT_ONCE
    every = [*range(n), *range(7)]
    wanted = [i for i in every if batch.column(1)[i].as_py()] if operator == "keep_known" else every
    assert [i for b in found for i in b.column(0).to_pylist()] == wanted


def test_remembered_words_stay_few_and_ids_right():
    token_output._memo.forget()
    texts = [" ".join(f"w{i}x{j}," for j in range(50)) + " the the" for i in range(40)]
    for t in texts:
        assert token_output.encode([t], WORD_BPE, 2, memo_words=120) == expected_ids([(0, t)])
        assert len(token_output._memo) <= 120 + 60
    token_output._memo.forget()


# --- words ------------------------------------------------------------------------


@given(st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85\xa0éÉ,", max_size=40))
def test_words_split_at_just_the_six_blanks(s):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), s)
    assert [w.decode() for w in text.words(s)] == re.findall(r"[^\x20\x09-\x0D]+", lowered)


def test_shingles_are_distinct_and_short_texts_are_one():
    assert len(text.shingles(None)) == len(text.shingles(" \n")) == 0
    assert len(text.shingles("a b c d")) == len(text.shingles("a b c d e")) == 1
    assert len(text.shingles("a b c d e " * 9)) == 5
    assert text.shingles("A b c d")[0] == text.shingles("a  B c\nd")[0] != text.shingles("a b d c")[0]


# --- token output -------------------------------------------------------------------


def expected_ids(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    return [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in docs]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abYZéÉßİ中ק̧́ .,'\"’-_*1२ \t\n<|>endoftxsrvlm", max_size=30), max_size=4))
def test_encoding_word_by_word_equals_encoding_the_text(texts):
    assert token_output.encode(texts, WORD_BPE, 2) == expected_ids([(0, t) for t in texts])


def test_tokens_come_back_as_written(spark, odd):
    folder = new_folder(spark)
    token_output.write_tokens(odd, folder, WORD_BPE, 2, block_docs=3, sample_rows=5)
    back = token_output.read_tokens(spark, folder).orderBy("start").collect()
    wanted = dict(zip([i for i, _ in ODD], expected_ids(ODD)))
    assert [r.doc_id for r in back] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 9]
    assert all(bytes(r.ids) == wanted[r.doc_id] and r.n_tokens == len(r.ids) // 4 for r in back)
    assert [r.start for r in back] == np.cumsum([0, *[r.n_tokens for r in back]])[:-1].tolist()
    some = token_output.read_tokens(spark, folder, [7, 4, 100]).collect()
    assert sorted(r.doc_id for r in some) == [4, 7, 7]
    crc = token_output.read_tokens(spark, folder).selectExpr("doc_id", "crc32(ids) c").collect()
    assert {(r.doc_id, r.c) for r in crc} == {(i, zlib.crc32(b)) for i, b in wanted.items()}


def test_tokens_of_an_empty_table(spark, rows):
    folder = new_folder(spark)
    token_output.write_tokens(rows([], DOCS), folder, WORD_BPE, 2)
    assert token_output.read_tokens(spark, folder).count() == 0


def test_a_foreign_dictionary_is_refused(spark, rows):
    folder, other = new_folder(spark), new_folder(spark)
    token_output.write_tokens(rows([(1, "some words here")], DOCS), folder, WORD_BPE, 2)
    spark.read.parquet(f"{folder}/blocks").write.parquet(f"{other}/blocks")
    spark.read.parquet(f"{folder}/shards").write.parquet(f"{other}/shards")
    held = spark.read.parquet(f"{folder}/dictionary")
    held.selectExpr("'0' as hash", "width", "body").write.parquet(f"{other}/dictionary")
    with pytest.raises(Exception, match="needs dictionary"):
        token_output.read_tokens(spark, other).count()


# --- fingerprints ---------------------------------------------------------------------


def edited(docs):
    order = sorted(docs, key=lambda d: d[0], reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        ahead = order[(k + 1) % len(order)][1] or ""
        n = len(t or "") // 3
        out[i] = (t or "")[: len(t or "") - n] + ahead[:n]
    return out


def spark_xxhash64(parts):
    """Spark's hash of several strings: each one's is the seed of the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed


def plain_sketch(text, fraction=fingerprints.FRACTION):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    hashes = {spark_xxhash64(found[i : i + 5]) >> 16 for i in range(max(len(found) - 4, 1))} if found else set()
    some = {h for h in hashes if h < int(fraction * (1 << 48))}
    return some or set(sorted(hashes)[:1])


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_texts_and_likeness(spark, rows):
    rng = random.Random(1)
    docs = [(7 * i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    docs += [(1000, None), (2000, ""), (-5, docs[3][1]), (3000, "😀 " * 100)]
    found = fingerprints.fingerprint_edits(rows(docs, DOCS).repartition(5)).collect()
    wanted, texts = edited(docs), dict(docs)
    assert len(found) == len(docs)
    order = [i for i, _ in sorted(docs, reverse=True)]
    plain = {i: plain_sketch(t or "") for i, t in docs}
    for r in found:
        changed, ahead = plain_sketch(wanted[r.doc_id]), plain[order[(order.index(r.doc_id) + 1) % len(order)]]
        assert r.near_edited == plain_likeness(plain[r.doc_id], changed) and r.near_next == plain_likeness(plain[r.doc_id], ahead)
        assert r.fingerprint == "".join(f"{h:012X}" for h in sorted(plain[r.doc_id]))
        assert r.edited_sha256 == hashlib.sha256(wanted[r.doc_id].encode()).hexdigest()
        assert r.n_chars == len(texts[r.doc_id] or "")
        assert all(x is None or 0 <= x <= 1 for x in (r.contained_edited, r.contained_next))
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert {r.fingerprint for r in found if not texts[r.doc_id]} == {""}


def test_fingerprints_of_repeated_rows_null_ids_and_one_row(spark, odd, rows):
    found = fingerprints.fingerprint_edits(odd).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in ODD)
    one = fingerprints.fingerprint_edits(rows([(1, "a b c d e f g h i")], DOCS)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c d e f a b c").hexdigest()
    assert fingerprints.fingerprint_edits(rows([], DOCS)).count() == 0


def test_sketches_merge(rows):
    a, b = "a b c d e f g h", "x y z u v w q r s"
    df = rows([(a, b, "")], "a string, b string, none string").select(
        *[fingerprints.sketch(c, fraction=1.0).alias(c) for c in ("a", "b", "none")]
    )
    df = df.withColumn("both", fingerprints.merged("a", "b", 1.0))
    r = df.select("*", fingerprints.containment("a", "both", 1.0).alias("c"), fingerprints.likeness("a", "b").alias("l")).first()
    assert len(r.a) == 4 and len(r.b) == 5 and len(r.both) == 9 and r.c == 1.0 and r.l == 0.0 and r.none == []


def test_short_texts_held_whole_and_unions_of_sketches(rows):
    rng, held = random.Random(4), []
    for i in range(400):
        words = [f"w{i}x{j}" for j in range(608)]
        at = rng.randrange(600)
        held.append((i, " ".join(words[at : at + 8]), " ".join(words), " ".join(words[:at]), " ".join(words[max(at - 4, 0) :])))
    df = rows(held, "i int, short string, whole string, head string, tail string")
    df = df.select("*", *[fingerprints.sketch(c).alias(f"{c}_s") for c in ("short", "whole", "head", "tail")])
    df = df.withColumns({"both": fingerprints.merged("head_s", "tail_s"), "c": fingerprints.containment("short_s", "whole_s")})
    found = df.collect()
    told = [r for r in found if r.c is not None]
    assert len(told) > 200 and all(r.c == 1.0 for r in told)
    # Null just where no shingle of the short text has a hash below the fraction.
    low = int(fingerprints.FRACTION * (1 << 48))
    assert all((r.c is None) == (min(r.short_s) >= low) for r in found)
    assert all(r.both == r.whole_s for r in found if len(r.head.split()) > 4)


def test_fingerprints_use_no_python(spark, rows):
    plan = fingerprints.fingerprint_edits(rows([(1, "a b"), (2, "c d")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- main text ----------------------------------------------------------------------------

ARTICLE = (
    '<!DOCTYPE html><html><head><title>T, t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">'
    '<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>gone</p> --><div class="ad">Buy, buy.</div>'
    '<div class="cookie-notice"><p>We use cookies, and more, and more.</p></div>'
    "<article><h1>Head  line</h1><p><b>First,  para&amp;graph\n here.<br><p>Second &lt;one&gt; &eacute;&#233;.</p>"
    "<ul><li>point <a href=x>link</a><li>two</ul><form><p>Mail</p><input name=q></form><footer>by X</footer></article>"
    '<aside><p>Other, story.</p></aside><div id="comments"><article><p>First, nice, one.</p></article></div><footer>&copy; x</footer></body></html>'
)


def test_main_text_of_an_article():
    assert html_extract.main_text(ARTICLE).split("\n\n") == ["Head line", "First, para&graph here.", "Second <one> éé.", "point link", "two"]


@pytest.mark.parametrize("page, wanted", [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain, text only", "plain, text only"),
    ("<div><div class=x><p>" + "Long, text. " * 20 + "</p><p>End.</p></div><div class='links'><a href=1>one</a> <a href=2>two</a></div></div>",
     ("Long, text. " * 20).strip() + "\n\nEnd."),
    ("<p>a < b & c", "a < b & c"), ("</p></div><p>x<p>y", "x\n\ny"), ("<article><p>a</p><script>x", "a"),
    ("<main><section><h2>A</h2><p>one, two</p></section><section><p>three, four</p></section></main>", "A\n\none, two\n\nthree, four"),
    ("<article>" + "<div>" * 3000 + "deep, text" + "</div>" * 3000 + "</article>", "deep, text"),
    ('<article><p title="a > b">q</p><p hidden>h</p><p style="display: none">n</p></article>', "q"),
])
def test_main_text_of_odd_pages(page, wanted):
    assert html_extract.main_text(page) == wanted


LONG = ("Long, text. " * 20).strip()


@pytest.mark.parametrize("page, wanted", [
    (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG), (f'<div id="page" class="no-sidebar"><p>{LONG}</p></div>', LONG),
    (f'<article class="side-by-side"><p>{LONG}</p></article>', LONG), (f'<div class="widget"><article><p>{LONG}</p></article></div>', LONG),
    (f'<div class="banner"><p>{LONG}</p></div><div><p>x</p></div>', LONG), ('<p class="notice">one</p>', "one"),
    (f'<article><p>{LONG}</p><section class="related-work"><p>b, c</p></section></article>', f"{LONG}\n\nb, c"),
    (f'<article><p>{LONG}</p><div class="left-sidebar"><p>no</p></div><div id="post-comments"><p>{LONG * 3}</p></div></article>', LONG),
    ("<article><p>as <math><mi>x</mi><annotation>\\x</annotation></math> is</p></article>", "as x is"),
])
def test_names_do_not_cut_the_article(page, wanted):
    assert html_extract.main_text(page) == wanted


@pytest.mark.parametrize("page", [
    "<div>x" * 5_000, "<b>x" * 10_000 + "</i>" * 10_000, "<a " * 50_000, "<b>" * 5_000 + "<h1>t</h1>" * 5_000,
    "<div>" * 5_000 + "<header>x</header>" * 5_000, "<p><button>" + "<b>" * 5_000 + "<h1>x</h1>" * 5_000,
], ids=["nested", "stray", "no end", "inline", "headers", "open paragraph"])
def test_broken_pages_take_time_by_their_length(page):
    start = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - start < 2  # quadratic code took 7 to 60 seconds


@pytest.mark.parametrize("page, wanted", [
    ("<p>one, two<!-- cut", "one, two"), ("<p>one<!-- cut --> two", "one two"), ("<p>a > b <!--", "a > b"),
    ("<p>x<!-->y", "x"), ("<p>x <c", "x <c"), ("<p>one</b></html> two", "one two"),
    ("<div><p>one<ul><li>two<li>three</ul>four</div>", "one\n\ntwo\n\nthree\n\nfour"),
])
def test_comments_and_implied_ends(page, wanted):
    assert html_extract.main_text(page) == wanted


def test_pages_keep_their_number(rows):
    pages = rows([(1, "u", ARTICLE, 3), (1, "u", ARTICLE, 3), (2, None, None, 4), (None, "v", "<p>x" * 20_000, 5)], "page_id bigint, url string, html string, n_chars int")
    found = html_extract.extract_pages(pages).collect()
    assert len(found) == 4 and all(r.n_chars == len(r.text) for r in found)
    assert next(r for r in found if r.page_id is None).text == "\n\n".join(["x"] * 20_000)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# --- language --------------------------------------------------------------------------------

WORDS = {
    "en": "the and of that with which from they would there about house water", "de": "der die und nicht auch eine werden über zwischen haus wasser schön",
    "fr": "le les des dans pour avec une être maison très eau plusieurs", "es": "los las para con una está casa agua también señor niño",
}


def speech(lang, rng, n=60):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(2)
    data = [(i, speech(lang, rng), lang) for i, lang in enumerate(list(WORDS) * 30)]
    docs = spark.createDataFrame([*data, (900, None, "en"), (901, "123", "de"), (902, speech("en", rng), None)], DOCS + ", lang string")
    return language_id.train(docs)


def test_language_in_two_levels(spark, taught, odd):
    rng = random.Random(3)
    assert taught.families == ["germanic", "romance"] and {(a, b) for _, a, b in taught.pairs} == {("de", "en"), ("es", "fr")}
    assert all(language_id.predict(taught, speech(lang, rng)) [0] == lang for lang in WORDS for _ in range(10))
    found = {(r.doc_id, r.lang_pred): r.score for r in language_id.identify(odd, taught).collect()}
    assert len(found) == len({i for i, _ in ODD}) and all(0 <= s <= 1 for s in found.values())
    assert all((i, "und") in found for i in (1, 9, 2)) and (6, "und") not in found


def test_language_is_learned_from_distinct_rows(spark, rows):
    rng = random.Random(8)
    docs = [(i, speech(lang, rng), lang) for i, lang in enumerate(list(WORDS) * 30)]
    table = rows(docs, DOCS + ", lang string")
    copied = table.unionByName(rows([docs[0]], DOCS + ", lang string").crossJoin(spark.range(20_000).select()))
    keys = lambda t: language_id.least_per_language(t.selectExpr("lang", "xxhash64(doc_id, text) as tie"), 10)
    assert sorted(keys(copied).collect()) == sorted(keys(table).collect()) and keys(copied).count() == 10 * len(WORDS)
    one, other = language_id.train(copied.repartition(7), rows=10), language_id.train(table, rows=10)
    assert one.pairs == other.pairs and np.array_equal(one.planes, other.planes)


def test_language_without_or_with_one_language(spark, rows, odd):
    none = language_id.train(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}
    one = language_id.train(rows([(1, "the house", "en"), (2, "of water", "en")], DOCS + ", lang string"))
    assert language_id.predict(one, "agua")[0] == "en" and language_id.predict(one, "42")[0] == "und"


def test_support_vectors_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5)).astype(np.float32)
    y = np.where(x[:, 0] - 2 * x[:, 3] > 0.1, 1.0, -1.0)
    w, b = language_id.separate(x, y, cost=1000.0, rounds=400)
    assert ((x @ w + b) * y > 0).mean() > 0.97


# --- quality ------------------------------------------------------------------------------------


def junk(rng):
    return " ".join(rng.choice("ab cd ef".split()) + rng.choice(["***", "###"]) for _ in range(rng.randint(5, 400)))


def test_quality_learns_and_scores_whole_texts(spark, odd):
    rng = random.Random(4)
    texts = [junk(rng) if i % 2 else speech("en", rng, rng.randint(5, 400)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)] + [(1, None, 1), (500, 1, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    net = quality.train(docs.filter("doc_id < 100"), labels)
    found = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert sum((found[i] >= 0.5) == (i % 2 == 0) for i in range(100, 120)) >= 18
    clean = speech("en", rng, 3_000)
    assert quality.probability(net, clean.encode()) > 0.5 > quality.probability(net, junk(rng).encode())
    scores = quality.score(odd, net).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    kept = quality.keep_good(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s >= 0.5}


def test_quality_is_learned_from_a_document_once_and_in_slices(spark, rows, monkeypatch):
    rng = random.Random(9)
    docs = [(i, junk(rng) if i % 2 else speech("en", rng, rng.randint(5, 400))) for i in range(40)]
    table, labels = rows(docs, DOCS), rows([(i, 1 - i % 2) for i in range(40)], "doc_id bigint, quality int")
    copied = table.unionByName(rows([docs[3]], DOCS).crossJoin(spark.range(20_000).select()))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda samples, y: seen.append([x.tobytes() for x in samples]) or quality.Network())
    quality.train(copied.repartition(6), labels, rows=15)
    quality.train(table, labels, rows=15)
    assert seen[0] == seen[1] and len(seen[0]) == 30


def test_gradients_add_up_over_slices():
    rng = np.random.default_rng(2)
    half = quality.STEP * quality.VECTOR
    net = quality.Network(
        rng.normal(size=(256, quality.VECTOR)).astype(np.float32), rng.normal(size=(2 * half, quality.FILTERS)).astype(np.float32),
        np.zeros(quality.FILTERS, np.float32), rng.normal(size=3 * quality.FILTERS).astype(np.float32),
    )
    sizes = [1, 32, 7, 3, 32, 1, 20]
    samples = [rng.integers(1, 256, (n, quality.STEP * (2 * quality.HALF + 1))).astype(np.uint8) for n in sizes]
    y = np.array([0, 1, 0, 1, 1, 0, 1])
    whole, total = quality.gradients(net, samples, y, 7), {}
    parts = list(quality.slices(sizes, 33))
    assert [x for p in parts for x in sizes[p]] == sizes and len(parts) > 2 and all(sum(sizes[p]) <= 33 for p in parts)
    for p in parts:
        for name, d in quality.gradients(net, samples[p], y[p], 7).items():
            total[name] = total.get(name, 0) + d
    for name, d in whole.items():
        assert np.allclose(d, total[name], rtol=1e-3, atol=1e-6), name


def test_quality_of_a_long_text_does_not_depend_on_the_slab(monkeypatch):
    rng = np.random.default_rng(1)
    net = quality.Network(
        rng.normal(size=(256, quality.VECTOR)).astype(np.float32),
        rng.normal(size=(2 * quality.STEP * quality.VECTOR, quality.FILTERS)).astype(np.float32),
        np.zeros(quality.FILTERS, np.float32), rng.normal(size=3 * quality.FILTERS).astype(np.float32),
    )
    data = bytes(rng.integers(1, 255, 5_003).tolist())
    whole = quality.chunk_answers(net, data)
    monkeypatch.setattr(quality, "SLAB", quality.STEP * quality.HALF)
    assert np.allclose(whole, quality.chunk_answers(net, data))
    half = quality.STEP * quality.VECTOR
    padded = np.frombuffer(data + b" ", np.uint8)
    windows = np.stack([net.vectors[padded[i : i + 8]].ravel() for i in range(0, len(padded) - 4, 4)])
    assert half * 2 == windows.shape[1] and np.allclose((windows @ net.filters).max(axis=0).clip(0), whole.max(axis=0), atol=1e-4)


def test_quality_without_labels_of_both_kinds(spark, rows, odd):
    labels = rows([(5, 1), (1, 1)], "doc_id bigint, quality int")
    assert {round(r.score, 6) for r in quality.score(odd, quality.train(odd, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(odd.limit(0), quality.train(odd, labels)).count() == 0


def test_held_out_parts(rows):
    ids = [None, *range(50)]
    found = rows([(i,) for i in ids], "doc_id bigint").select("doc_id", quality.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
