"""Whitening, chat formatting and periodic runs against plain Python."""

import hashlib
import json
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from agronimbus.llm import chat_format, periodic_runs, whitening

# --- periodic runs --------------------------------------------------------------------


def brute_runs(words, min_words=6, min_exponent=4):
    """(start, period, length) of all runs, by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, q, n) for (s, n), q in found.items())


def periodic(rng, n, letters):
    words = [rng.randint(0, letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 12)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("min_words, min_exponent", [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(min_words, min_exponent):
    rng = random.Random(5)
    for _ in range(400):
        group = [periodic(rng, rng.choice([0, 1, 5, 6, 7, 24, 90, 300]), rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 5))]
        doc, *rest = periodic_runs.find_runs(group, min_words, min_exponent)
        found = [[] for _ in group]
        for i, start, length, period in zip(doc.tolist(), *(v.tolist() for v in rest)):
            found[i].append((start, period, length))
        assert found == [brute_runs(w, min_words, min_exponent) for w in group]


def test_extensions_equal_comparing_word_by_word():
    rng = random.Random(6)
    words = periodic(rng, 400, 1)
    symbols = np.array([0, *[w + 2 for w in words], 1])
    grammar = periodic_runs.Grammar(symbols, 2)
    x = np.array([rng.randrange(1, 401) for _ in range(3000)])
    y = np.array([rng.randrange(1, 401) for _ in range(3000)])
    x, y = x[x != y], y[x != y]
    way = np.array([rng.choice([1, -1]) for _ in x])

    def plain(a, b, d):
        n = 0
        while symbols[a] == symbols[b]:
            a, b, n = a + d, b + d, n + 1
        return n

    assert grammar.extensions(x, y, way).tolist() == [plain(*v) for v in zip(x.tolist(), y.tolist(), way.tolist())]


def test_strings_of_the_grammar_shrink():
    rng = random.Random(7)
    words = [rng.randint(0, 50) for _ in range(4000)] * 20
    grammar = periodic_runs.Grammar(np.array([0, *[w + 2 for w in words], 1]), 2)
    sizes = [len(grammar.level(k).symbols) for k in range(120)]
    assert sizes[-1] == 3 and sum(sizes[::2]) < 5 * len(words)


def test_a_long_text_needs_few_strings_and_no_square_time():
    for words in ([b"a"] * 300_000, [b"a", b"b", b"c"] * 100_000):
        doc, start, length, period = periodic_runs.find_runs([words])
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [len(set(words))])


TEXTS = [
    (1, "a b a b a b a b a b tail"), (2, None), (3, ""), (4, " \n\t "), (5, "x " * 7 + "y"), (5, "x " * 7 + "y"), (None, "o o o o o o"),
    (6, "A a A a A a"), (7, "one\x0btwo \x85\x1cthree"), (8, ("p q r " * 4 + "s ") * 5), (9, "long " * 50_000),
]


def test_collapsed_texts_of_odd_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 20)
    docs = rows([(i, t, 1, "x", 3, "k") for i, t in TEXTS], "doc_id bigint, text string, runs int, collapsed string, n_words int, top string")
    found = periodic_runs.collapse_runs(docs, keep=("doc_id", "collapsed", "text")).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")
        wanted = brute_runs(words) if len(words) < 1000 else [(0, 1, 50_000)]
        assert r.n_words == len(words) and [(s.start, s.period, s.length) for s in r.runs] == wanted
        dropped = {i for s, q, n in wanted for i in range(s + q, s + n)}
        assert r[-1] == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_runs_of_an_empty_table(rows):
    assert periodic_runs.collapse_runs(rows([], "doc_id bigint, text string")).collect() == []


def test_the_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in periodic_runs.periodic_documents(spark, folder).collect()}
    given = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(given)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, body in given:
        words = re.findall(r"[^\x20\x09-\x0D]+", body or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, r = brute_runs(words), found[doc_id]
        top = min(runs, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.period, r.length) == (top or (None,) * 3)
        assert r.exponent_milli == (1000 * top[2] // top[1] if top else None)
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, q, n in runs))
        dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == digest(" ".join(w for i, w in enumerate(words) if i not in dropped))


# --- chat formatting ------------------------------------------------------------------

SIGNS = st.text(alphabet="<>[]/\\sINSTSYROLE \n\"éa", max_size=25)
TRICKY = st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "<", "[", "a", "\n", "]", '"', "<\\", "é"]), max_size=12).map("".join)


@settings(max_examples=500)
@given(SIGNS | TRICKY)
@example("<\\\\/s><<<SYS>><</SYS>>[/INST] \\")
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)
    assert chat_format.unescape(chat_format.escape(text)) == text


@settings(max_examples=300)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | SIGNS | TRICKY, SIGNS | TRICKY), max_size=5))
def test_formatted_turns_are_read_back(turns):
    whole = "".join(o + chat_format.escape(t) + c for (o, c), t in ((chat_format.marks(r), t) for r, t in turns))
    back = chat_format.parse(whole)
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [chat_format.unescape(whole[a:b]) for _, _, a, b in back] == [t for _, t in turns]


TURNS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "user", None), (2, 0, None, "no role"), (2, 0, None, "no role"), (None, None, "user", "x"),
    (None, 5, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "tool \"x\"]\n", "[ROLE \"user\"]\n"), (4, 0, "assistant", ""),
]


@pytest.mark.parametrize("piece_chars", [1, 30, 1 << 20])
def test_digests_equal_plain_python(spark, rows, piece_chars):
    given = rows([(*t, "e", 9, "l") for t in TURNS + [(9, i, "user" if i % 2 else "assistant", f"t{i} " * 50) for i in range(300)]],
                 "conv_id bigint, turn bigint, role string, text string, empty string, piece int, layout string")
    formatted = chat_format.format_turns(chat_format.canonical_turns(given), piece_chars)
    assert formatted.filter("n_turns > 1").count() == 0 or piece_chars > 1
    found = {r.key: r for r in chat_format.digests(formatted).collect()}
    wanted = {}
    for r in sorted(given.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        wanted.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert found.keys() == wanted.keys()
    for key, turns in wanted.items():
        r, learned = found[key], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_format.escape(t)) + len("".join(chat_format.marks(a))) for a, t in turns)
    back = chat_format.read_turns(formatted).collect()
    assert sorted((r.role, r.text, r.in_loss) for r in back) == sorted((a, b, a == "assistant") for turns in wanted.values() for a, b in turns)


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from and value", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "completion": "a"}, "prompt and completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": None, "system": "s"}, "prompt and response", [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"instruction": "q", "input": "i", "output": "a"}, "instruction", [("user", "q\n\ni"), ("assistant", "a")]),
    ({"instruction": "q", "input": "", "output": "a"}, "instruction", [("user", "q"), ("assistant", "a")]),
    ({"question": "q", "answer": "a", "meta": {"x": [1]}}, "question and answer", [("user", "q"), ("assistant", "a")]),
    ({"system": "s", "history": [{"question": "q", "answer": "a"}, {"question": "r", "answer": "b"}]}, "pairs",
     [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")]),
    ({"messages": []}, "messages", []),
]


@pytest.mark.parametrize("record, layout, turns", RECORDS)
def test_tables_and_json_records_of_many_layouts_give_the_same_turns(spark, rows, record, layout, turns):
    if all(record.values()):
        table = spark.read.json(spark.createDataFrame([(json.dumps({**record, "conv_id": 7}),)], "value string").rdd.map(lambda r: r.value))
        found = chat_format.canonical_turns(table).orderBy("turn").collect()
        assert [(r.role, r.text) for r in found] == turns and {r.layout for r in found} == {layout}
    found = chat_format.json_turns(rows([(7, json.dumps(record))], "k int, body string"), "k", "body").orderBy("turn").collect()
    assert {r.layout for r in found} == {layout}
    assert [(r.role, r.text) for r in found if not r.empty] == turns


def test_records_of_different_layouts_in_one_column(spark, rows):
    bodies = [json.dumps(r) for r, _, _ in RECORDS] + [None, "", "no json", "[1]", '{"a": 1}', '{"prompt": "q", "completion": "a", "text": "t"}']
    table = rows([(i, b, "x") for i, b in enumerate(bodies)], "k int, body string, role string")
    turns = chat_format.json_turns(table, "k", "body")
    found = {r.key: r for r in chat_format.format_turns(turns).collect()}
    assert sorted(found) == list(range(len(bodies)))
    assert [found[i].n_turns for i in range(len(bodies))] == [len(t) for _, _, t in RECORDS] + [0] * 6
    assert {r.key for r in turns.filter("layout is null").collect()} == set(range(len(RECORDS), len(bodies)))


def test_unknown_tables_are_refused_and_empty_ones_give_nothing(rows):
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical_turns(rows([], "conv_id int, words string"))
    empty = rows([], "conv_id int, turn int, role string, text string")
    assert chat_format.digests(chat_format.format_turns(chat_format.canonical_turns(empty))).collect() == []


# --- whitening ------------------------------------------------------------------------


def brute_whitening(vectors):
    """By exact fractions: n, deviations, covariance of the distinct whole-number vectors."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(x[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    y = [[n * v[i] - s[i] for i in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in y), n**3)) for j in range(d)] for i in range(d)])
    deviation = [sum((n * v[i] - s[i]) ** 2 for i in range(d)) for v in x]
    return n, deviation, cov, np.array([[v[i] - Fraction(s[i], n) for i in range(d)] for v in x], float)


def of(spark, data):
    vectors = spark.createDataFrame([(i, v, 1, "w", 2.0) for i, v in data], "vec_id bigint, embedding array<double>, n int, whitened string, deviation double")
    models, distinct = whitening.fit(vectors)
    return models, whitening.identity_errors(distinct, models), whitening.whiten(vectors, models).collect()


@pytest.mark.parametrize("size", [1.0, 1e6, 1e15])
def test_whitening_equals_exact_fractions(spark, size):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * size).tolist()
    data = list(enumerate(v + v[:20] + v[:1] * 50))
    n, deviation, cov, centred = brute_whitening([x for _, x in data])
    models, errors, found = of(spark, data)
    model = models[5]
    values, axes = np.linalg.eigh(cov)
    assert model.n == n == 60 and errors[5] < 1e-9
    assert np.allclose(model.values, values[::-1], rtol=1e-9)
    assert len(found) == len(data)
    for r in found:
        wanted = centred[r.vec_id] @ axes[:, ::-1] / np.sqrt(values[::-1])
        assert r.n == n and np.allclose(np.abs(r.whitened), np.abs(wanted), rtol=1e-6, atol=1e-9)
        assert np.allclose(r.explained, values[::-1] / np.trace(cov), rtol=1e-9)
        assert r.deviation is None if deviation[r.vec_id] >= 10**38 else int(r.deviation) == deviation[r.vec_id]
    signs = {tuple(np.sign(np.array(r.whitened) * (centred[r.vec_id] @ axes[:, ::-1]))) for r in found}
    assert len(signs) == 1


def test_vectors_that_cannot_be_used_and_components_without_variance(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0]), (7, [3.0, 4.0]), (None, [3.0, 4.0]), (8, [1.5])]
    models, errors, found = of(spark, odd)
    assert sorted(models) == [1, 2] and max(errors.values()) < 1e-9
    # Two vectors vary along one axis only; a single vector along none.
    assert {r.vec_id: len(r.whitened) for r in found} == {6: 1, 7: 1, None: 1, 8: 0}
    assert sorted(abs(r.whitened[0]) for r in found if r.whitened) == pytest.approx([1, 1, 1])
    assert {r.deviation for r in found if r.vec_id == 8} == {0}
    assert of(spark, []) == ({}, {}, [])


def test_small_differences_far_from_zero_are_not_lost(spark):
    rng = np.random.default_rng(4)
    v = (1e12 + rng.integers(-3, 4, size=(300, 3))).tolist()
    models, errors, _ = of(spark, list(enumerate(v)))
    _, _, cov, _ = brute_whitening(v)
    assert np.allclose(models[3].values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12) and errors[3] < 1e-9


def test_hot_vector_counts_once(spark):
    data = [(i, [1.0, 2.0]) for i in range(5_000)] + [(9_000 + i, [float(i), float(i * i)]) for i in range(5)]
    models, _, found = of(spark, data)
    assert models[2].n == 6 and len(found) == 5_005
