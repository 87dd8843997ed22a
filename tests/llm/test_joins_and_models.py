"""Joins, components, language model, mixing, packing and the pipeline against brute force."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from agronimbus.llm import components, embedding_dedup, hidden_markov, jaccard_join, mixing, packing, quality, text

DOCS = "doc_id bigint, text string"


def roots(pairs, nodes):
    """Least node of each component, by brute force."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- components ----------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark, rows):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3)] + [(-2, 9), (9, -2)]
    pairs += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    found = components.connected_components(rows(pairs, "a bigint, b bigint")).collect()
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert len(found) == len(nodes) and {r.node: r.component for r in found} == roots([p for p in pairs if p[0] != p[1]], nodes)
    assert components.connected_components(rows([], "a bigint, b bigint")).count() == 0


@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=30))
def test_local_roots(pairs):
    a, b = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    assert components.local_roots(16, a, b).tolist() == [roots(pairs, range(16))[i] for i in range(16)]


# --- Jaccard join ---------------------------------------------------------------------


def shingle_set(t):
    w = text.words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_components(docs):
    """By brute force: component of each row."""
    sets = [shingle_set(t) for _, t in docs]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(docs)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    root = roots(links, range(len(docs)))
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(docs):
        if i is not None and (least[root[k]] is None or i < least[root[k]]):
            least[root[k]] = i
    return Counter((i, len(s), least[root[k]]) for k, ((i, _), s) in enumerate(zip(docs, sets)))


def corpus(seed, n=160):
    """Copies, chains of near copies, a common passage, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("rstlnxyz")
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.randint(20, 120))] for _ in range(6)]
    docs, ids = [], rng.sample(range(10_000), n)
    for i in ids:
        kind = rng.random()
        if kind < 0.55:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
        elif kind < 0.75:
            w = passage + [word() for _ in range(rng.randint(0, 40))]
        else:
            w = [word() for _ in range(rng.randint(0, 8))]
        docs.append((i, " ".join(w) if rng.random() < 0.9 else " ".join(w).upper()))
    return docs + [(None, docs[0][1]), (20_000, None), (20_001, " "), docs[1], docs[1], (20_002, "x " * 9_000)]


@pytest.mark.parametrize("seed, tile, repeats", [(1, 1024, 4), (2, 8, 4), (3, 64, 2)])
def test_jaccard_components_equal_brute_force(spark, rows, monkeypatch, seed, tile, repeats):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    docs = corpus(seed)
    df = rows([(i, t, 0, 0) for i, t in docs], DOCS + ", cls int, key int").repartition(4)
    found = jaccard_join.jaccard_components(df).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == linked_components(docs)
    worded = [r for r in found if r.n_shingles]
    kept = {(r.component_id, r.row_key) for r in worded if r.kept}
    assert len(kept) == len({r.component_id for r in worded})
    assert all(r.doc_id == r.component_id for r in worded if r.kept) and all(r.kept for r in found if not r.n_shingles)


@given(st.lists(st.sets(st.integers(0, 12)), max_size=12), st.integers(1, 5))
def test_repeated_shingles_are_counted_in_place(sets, least):
    counts = Counter(itertools.chain.from_iterable(sets))
    given_sets = [np.array(sorted(x), np.uint64) for x in sets]
    found, times = jaccard_join.repeated(given_sets, least)
    assert list(zip(found.tolist(), times.tolist())) == sorted((x, n) for x, n in counts.items() if n >= least)
    assert not given_sets


def test_jaccard_of_nothing(spark, rows):
    assert jaccard_join.jaccard_components(rows([], DOCS)).count() == 0
    blank = jaccard_join.jaccard_components(rows([(1, None), (2, "")], DOCS)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in blank} == {(1, 0, 1), (2, 0, 2)}


numbers = st.sets(st.integers(0, 60), min_size=1, max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(numbers, min_size=2, max_size=12))
def test_bounds_never_lose_a_link(sets):
    hashes = [np.unique(text.mixed(np.array(sorted(s), dtype=np.uint64) + np.uint64(77))) for s in sets]
    sizes, vectors = np.array([len(h) for h in hashes]), [jaccard_join.count_vector(h) for h in hashes]
    linked = {
        (i, j) for i, j in itertools.combinations(range(len(sets)), 2)
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    a, b = np.triu_indices(len(sets), 1)
    keep = jaccard_join.bounded(a, b, sizes, vectors)
    assert linked <= set(zip(a[keep].tolist(), b[keep].tolist()))
    all_rows = np.arange(len(sets))
    x, y = jaccard_join.tree_pairs(all_rows, all_rows, sizes, vectors)
    assert linked <= {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    none, rank = np.empty(0, np.uint64), np.empty(0, np.int64)
    filed = [set(jaccard_join.first_shingles(h, none, rank).tolist()) for h in hashes]
    assert all(filed[i] & filed[j] for i, j in linked)


def test_trees_compare_few_pages_and_lose_no_link():
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(64):
        base = rng.integers(1, 1 << 62, rng.integers(40, 900), dtype=np.uint64)
        for _ in range(40):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.02, rng.integers(1, 1 << 62, len(base), dtype=np.uint64), base)))
    sets = [sets[i] for i in rng.permutation(len(sets))]
    sizes, vectors = np.array([len(h) for h in sets]), [jaccard_join.count_vector(h) for h in sets]
    root = jaccard_join.Node(np.arange(len(sets)), sizes, vectors)
    pages = -(-len(sets) // jaccard_join.LEAF)
    assert len(list(jaccard_join.near_pages(root, root))) < 0.2 * pages * (pages + 1) / 2

    def links(pairs):
        out = set()
        for i, j in pairs:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                out.add((min(i, j), max(i, j)))
        return out

    some = np.arange(500)
    rest = np.arange(500, 1_300)
    x, y = jaccard_join.tree_pairs(some, some, sizes, vectors)
    assert len(set(zip(x, y))) == len(x)
    assert links(zip(x.tolist(), y.tolist())) == links(itertools.combinations(range(500), 2))
    x, y = jaccard_join.tree_pairs(some, rest, sizes, vectors)
    assert links(zip(x.tolist(), y.tolist())) == links(itertools.product(range(500), range(500, 1_300)))


def test_large_counts_need_more_bytes():
    many = np.arange(1, 3_000_000, dtype=np.uint64)
    vector = jaccard_join.count_vector(text.mixed(many))
    groups = int(jaccard_join.group_count(len(many)))
    assert len(vector) == 4 * groups and jaccard_join.folded([vector], np.array([len(many)]), groups).sum() == len(many)


# --- embeddings -------------------------------------------------------------------------


@pytest.mark.parametrize("tile, axes", [(1024, 2), (5, 1), (7, 3)])
def test_vector_links_equal_brute_force(spark, rows, tile, axes):
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(6, 24))
    data = []
    for i in range(150):
        v = centres[rng.integers(6)] + rng.normal(size=24) * rng.choice([0, 0.02, 0.1, 0.14, 1.0])
        data.append((i, [float(x) for x in v * rng.choice([1, 3])], int(rng.integers(2))))
    data += [(200, None, 1), (201, [], 1), (202, [0.0] * 24, 1), (203, [float("nan")] + [1.0] * 23, 1), (204, [None] + [1.0] * 23, 1),
             (205, data[0][1], None), (206, data[0][1], data[0][2]), (207, data[0][1], data[0][2]), (208, [float("inf")] + [1.0] * 23, 1),
             (209, data[0][1][:7], data[0][2]), (210, data[0][1][:7], data[0][2]), (None, data[0][1], data[0][2])]
    df = rows([(*r, "x") for r in data], "vec_id bigint, embedding array<double>, label int, cls string")
    found = embedding_dedup.near_duplicates(df, tile_rows=tile, cell_axes=axes).collect()

    def good(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def cosine(a, b):
        return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    links = [
        (a[0], b[0]) for a, b in itertools.combinations(data, 2)
        if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98
    ]
    count = Counter(x for p in links for x in p)
    root = roots(links, [r[0] for r in data if r[0] is not None])
    assert len(links) > 100 and len(found) == len(data)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id)


def test_links_of_very_large_and_very_small_numbers(spark):
    data = [(1, [1e200, 2e200]), (2, [1e200, 2.002e200]), (3, [1e-200, 2e-200]), (4, [1e-200, 2.001e-200]), (5, [1.0, 2.0]), (6, [1e300, -1e300]), (7, [5e-324, 1e-323])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], "vec_id bigint, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == {**{i: (5, 1) for i in (1, 2, 3, 4, 5, 7)}, 6: (0, 6)}


def test_no_vectors(rows):
    assert embedding_dedup.near_duplicates(rows([], "vec_id bigint, embedding array<float>, label int")).count() == 0


# --- language model ------------------------------------------------------------------------


def paths(model, seq):
    """Likelihood and posterior counts over all state paths."""
    k = len(model.start)
    total, starts, moved, given_ = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(model.gives)
    for p in itertools.product(range(k), repeat=len(seq)):
        w = model.start[p[0]] * model.gives[p[0], seq[0]]
        for t in range(1, len(seq)):
            w *= model.moves[p[t - 1], p[t]] * model.gives[p[t], seq[t]]
        total += w
        starts[p[0]] += w
        for t, c in enumerate(seq):
            given_[p[t], c] += w
            if t:
                moved[p[t - 1], p[t]] += w
    return total, starts / total, moved / total, given_ / total


def test_forward_and_baum_welch_equal_all_paths():
    model = hidden_markov.untrained(hidden_markov.Model(np.empty(0, np.int64), np.arange(1.0, 8.0), np.ones(7), 28, 7), states=3)
    seqs = [[0, 1, 2, 6, 3], [4], [5, 5, 0, 1], [6]]
    each = [paths(model, s) for s in seqs]
    lengths = np.array([len(s) for s in seqs])
    assert np.allclose(hidden_markov.forward_log10(model, np.concatenate(seqs), lengths), [math.log10(x[0]) for x in each], rtol=1e-12)
    obs = np.full((4, 5), hidden_markov.NOTHING, "<u2")
    for row, s in zip(obs, seqs):
        row[: len(s)] = s
    starts, moved, given_, loglik = hidden_markov.expected_counts(model, obs)
    for got, i in ((starts, 1), (moved, 2), (given_, 3)):
        assert np.allclose(got, sum(x[i] for x in each), atol=1e-5)
    assert abs(loglik - sum(math.log(x[0]) for x in each)) < 1e-4
    assert len(hidden_markov.forward_log10(model, np.empty(0, np.int64), np.empty(0, np.int64))) == 0


def test_segments_hold_every_move_once(monkeypatch):
    monkeypatch.setattr(hidden_markov, "SEGMENT", 5)
    rng = np.random.default_rng(1)
    lengths = np.array([1, 4, 5, 6, 9, 10, 13, 40, 1])
    seq = rng.integers(0, 7, lengths.sum()).astype("<u2")
    out = hidden_markov.cut_segments(seq, lengths)
    first = (out[:, 0] & hidden_markov.CONTINUED) == 0
    assert first.sum() == len(lengths)
    back = []
    for goes_on, row in zip(~first, out):
        row = [int(x) & (hidden_markov.CONTINUED - 1) for x in row if x != hidden_markov.NOTHING]
        if goes_on:
            assert back[-1][-1] == row[0] and len(row) > 1
            back[-1] += row[1:]
        else:
            back.append(row)
    assert back == [x.tolist() for x in np.split(seq, np.cumsum(lengths)[:-1])]
    # Each token is given once, each text starts once and moves between all its neighbours.
    model = hidden_markov.untrained(hidden_markov.Model(np.empty(0, np.int64), np.arange(1.0, 8.0), np.ones(7), 28, 7), states=3)
    starts, moved, given_, _ = hidden_markov.expected_counts(model, out)
    assert np.isclose(starts.sum(), len(lengths)) and np.isclose(moved.sum(), (lengths - 1).sum())
    assert np.allclose(given_.sum(axis=0), np.bincount(seq, minlength=7))


def test_scores_of_a_small_corpus(spark, rows, monkeypatch):
    monkeypatch.setattr(hidden_markov, "BLOCK_BYTES", 4_000)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["aa bb cc", "dd ee ff"][i % 2].split()) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "Zz unseen AA."), (103, "aa " * 5_000), (104, docs[0][1]), (None, docs[0][1])]
    df = rows([(i, t, 0) for i, t in docs], DOCS + ", word int").repartition(3)
    seen = df.filter("doc_id < 60")
    model, vocabulary = hidden_markov.train(seen, warm_rounds=5)
    found = hidden_markov.score(df, model, vocabulary).collect()
    counts = Counter(w for i, t in docs if i is not None and i < 60 for w in [*text.words(t), b" "])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.vocabulary) == (n, v) and len(found) == len(docs)
    texts = {(i, len(text.words(t)) + 1): [*text.words(t), b" "] for i, t in docs}
    for r in found:
        tokens = texts[(r.doc_id, r.n_tokens)]
        assert r.n_known == sum(t in counts for t in tokens)
        assert abs(r.base_score - sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6
        words_, at, lengths = hidden_markov.word_ids([b" ".join(tokens[:-1]).decode()])
        cls = model.classes(words_, hidden_markov.word_hashes(words_))
        share = model.shares(cls, np.array([counts[w] for w in words_]))
        assert abs(r.score - hidden_markov.forward_log10(model, cls[at], lengths)[0] - share[at].sum()) < 1e-6
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_every_round_sees_all_segments_of_a_large_corpus(rows, monkeypatch):
    seen = []
    monkeypatch.setattr(hidden_markov, "improved", lambda model, segments: seen.append(segments) or model)
    docs = rows([(i, f"w{i} x " * 80_000) for i in range(20)], DOCS).repartition(5)
    model, _ = hidden_markov.train(docs)
    assert model.tokens == 20 * 160_001
    wanted = 20 * (1 + -(-(160_001 - hidden_markov.SEGMENT) // (hidden_markov.SEGMENT - 1))) * 2 * hidden_markov.SEGMENT
    assert [s.selectExpr("sum(octet_length(segments))").first()[0] for s in seen] == [wanted] * 8


def test_scores_without_training_rows(spark, rows):
    docs = rows([(1, "a b"), (2, None)], DOCS)
    model, vocabulary = hidden_markov.train(docs.limit(0))
    found = {r.doc_id: r for r in hidden_markov.score(docs, model, vocabulary).collect()}
    assert found[1].n_known == 0 and found[1].n_tokens == 3 and found[1].base_score == 0 and found[2].n_tokens == 1
    assert all(math.isfinite(r.score) for r in found.values())
    assert hidden_markov.score(docs.limit(0), model, vocabulary).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def sourced(seed=6):
    rng = random.Random(seed)
    sizes = {"big": 150, "mid": 40, "tiny": 6, None: 12}
    out, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            out.append((i, " ".join(["w"] * rng.randint(0, 30)), source, 7))
            i += 1
    return out + [(900, None, "tiny", 7), (901, "w w", "big", 7), (901, "w w", "big", 7)]


SOURCED = DOCS + ", source string, pass int"


def tokens(t):
    return len(text.words(t)) + 1


@pytest.mark.parametrize("target", [mixing.Target(), mixing.Target(entropy=0.99, repeats=None), mixing.Target(entropy=None, repeats=None),
                                    mixing.Target(entropy=1.0, repeats=2.0), mixing.Target(tokens=500, block_tokens=100)])
def test_mixture_meets_its_target(spark, rows, target):
    data = sourced()
    df = rows(data, SOURCED).repartition(3)
    found = mixing.mix_schedule(df, target).collect()
    have, each = Counter(), {}
    for i, t, s, _ in data:
        have[s] += tokens(t)
        each[i] = tokens(t)
    total = sum(have.values())
    budget = target.tokens or total
    if target.repeats:
        budget = min(budget, target.repeats * total)
    a = mixing.exponent(spark.createDataFrame([(str(s), n) for s, n in have.items()], "_source string, tokens bigint"), total, budget, target)
    z = sum((n / total) ** a for n in have.values())
    share = {s: (n / total) ** a / z for s, n in have.items()}
    entropy = -sum(w * math.log(w) for w in share.values())
    repeats = max(budget * share[s] / n for s, n in have.items())
    if target.repeats and repeats > target.repeats * 0.999:
        assert repeats <= target.repeats * (1 + 1e-5)
    elif target.entropy:
        assert entropy >= target.entropy * math.log(len(have)) - 1e-6
    else:
        assert a == 1.0
    used, passes = Counter(), defaultdict(Counter)
    for r in found:
        assert r.n_tokens == each[r.doc_id] and abs(r.weight - share[r.source]) < 1e-9 and r.block >= 0
        used[r.source] += r.n_tokens
        passes[r.source][r["pass"]] += 1
    for s, n in have.items():
        wanted, docs = budget * share[s], sum(x[2] == s for x in data)
        # Whole passes have all documents; the last ends before the one that exceeds the budget.
        assert wanted - 2 * max(each.values()) - 1 < used[s] <= wanted
        assert all(passes[s][p] == docs for p in range(int(wanted // n)))
    mixed = mixing.mix_documents(df, target)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in found)


@pytest.mark.parametrize("target", [mixing.Target(entropy=None), mixing.Target(entropy=0.5)])
def test_mixture_that_stays_as_it_is_has_every_document_once(rows, target):
    rng = random.Random(11)
    # A long tail: most sources have one document.
    data = [(i, " ".join(["w"] * rng.randint(0, 300)), f"s{i if i < 150 else i % 7}", 7) for i in range(400)]
    df = rows(data, SOURCED).repartition(3)
    found = mixing.mix_schedule(df, target).collect()
    assert Counter((r.doc_id, r["pass"]) for r in found) == Counter((i, 0) for i, *_ in data)
    assert Counter(r.doc_id for r in mixing.mix_documents(df, target).collect()) == Counter(i for i, *_ in data)


def test_even_mixture_keeps_whole_passes(rows):
    # Nineteen alike: 1 / 19 rounds down, each budget is one whole pass.
    data = [(i, "w " * 699, f"s{i % 19}", 7) for i in range(190)]
    df = rows(data, SOURCED)
    for target in (mixing.Target(entropy=1.0), mixing.Target(entropy=None, tokens=2 * 190 * 700)):
        each = 2 if target.tokens else 1
        assert Counter(r.doc_id for r in mixing.mix_documents(df, target).collect()) == Counter({i: each for i in range(190)})


def test_blocks_hold_every_source_by_its_weight(rows):
    target = mixing.Target(entropy=None, repeats=None, block_tokens=400)
    found = mixing.mix_schedule(rows(sourced(), SOURCED), target).collect()
    first = Counter()
    for r in found:
        if r.block == 0:
            first[r.source] += r.n_tokens
    weight = {r.source: r.weight for r in found}
    assert all(abs(first[s] - 400 * w) <= 31 for s, w in weight.items())


def test_mixture_of_nothing(rows):
    assert mixing.mix_schedule(rows([], SOURCED)).count() == mixing.mix_documents(rows([], SOURCED)).count() == 0


# --- packing ------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_bins_hold_their_pieces(sizes):
    lengths = (8, 16, 64)
    bins, offsets, final = packing.pack(np.array(sizes), lengths)
    used = np.bincount(bins, sizes)
    for b, n in enumerate(used):
        at = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
        assert [o for o, _ in at] == np.cumsum([0, *[s for _, s in at]])[:-1].tolist()
        assert final[b] == min(c for c in lengths if c >= n)


def test_best_fit_and_least_cost():
    flat = lambda c: c + 1
    bins, _, final = packing.pack(np.array([6, 5, 4, 3, 2]), (10,), flat)
    assert bins.tolist() == [0, 1, 0, 1, 1] and final == [10, 10]
    # A price above proportion makes short sequences cheaper for short documents.
    steep = lambda c: c * c
    assert packing.pack(np.array([4, 4, 4]), (4, 16), steep)[2] == [4, 4, 4]
    assert packing.pack(np.array([4, 4, 4, 4]), (4, 16), flat)[2] == [16]


def test_packing_keeps_every_token(spark, rows):
    rng = random.Random(9)
    data = [(i, rng.randint(1, 300), "x") for i in range(300)] + [(1000, 5_000, "x"), (1001, None, "x"), (1002, 0, "x"), (None, 7, "x")]
    data += [(2000, 40, "x")] * 50
    df = rows(data, "doc_id bigint, n_tokens bigint, bin string")
    found = packing.pack_documents(df, lengths=(64, 128, 512), shard_docs=60).collect()
    wanted = Counter()
    for i, n, _ in data:
        wanted[i] += max(n or 1, 1)
    got, used, length = Counter(), Counter(), {}
    for r in found:
        got[r.doc_id] += r.n_tokens
        used[r.shard, r.bin] += r.n_tokens
        length[r.shard, r.bin] = r.length
    assert got == wanted and all(n <= length[b] for b, n in used.items())
    assert {r["copy"] for r in found if r.doc_id == 2000} == set(range(1, 51))
    assert sum(used.values()) / sum(length.values()) > 0.9
    assert packing.pack_documents(df.limit(0)).count() == 0


def whole_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_sizes_are_ids_and_bins_hold_as_many(spark, rows):
    import public_tokenizers

    texts = ["", None, " \t", "Plain words, and signs!", "机器学习需要大量的文本数据" * 40, "ภาษาไทยไม่มีช่องว่าง" * 30, "long " * 3_000, "long " * 3_000]
    df = rows([(i if i != 3 else None, t, "x", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, n_tokens int")
    sizes = packing.token_sizes(df, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert sizes.columns == ["doc_id", "n_tokens"]
    wanted = {
        (i if i != 3 else None): len(whole_tokenizer().encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)
    }
    assert {r.doc_id: r.n_tokens for r in sizes.collect()} == wanted
    assert wanted[4] > 100  # one word by blanks
    used, length = Counter(), {}
    for r in packing.pack_documents(sizes, lengths=(64, 512)).collect():
        wanted[r.doc_id] -= r.n_tokens
        used[r.shard, r.bin] += r.n_tokens
        length[r.shard, r.bin] = r.length
    assert set(wanted.values()) == {0} and all(n <= length[b] for b, n in used.items())
    assert packing.token_sizes(df.limit(0), public_tokenizers.path("word_bpe_49k.json"), end_id=2).count() == 0


# --- pipeline -------------------------------------------------------------------------------------

FOLDER = os.environ.get("AGRONIMBUS_TABLES", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_stages_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    # Near duplicates: the first document of each group, by brute force on the stage's input.
    rows = list(zip(kept["language"].doc_id.tolist(), kept["language"].text.tolist()))
    groups = linked_components(rows)
    assert sorted(kept["near_duplicates"].doc_id) == sorted({c for _, n, c in groups if n} | {i for i, n, _ in groups if not n})
    # Packing: every id of every row that mixing kept, and one end each.
    wanted = Counter()
    for i, t in zip(kept["mixing"].doc_id, kept["mixing"].text):
        wanted[i] += len(whole_tokenizer().encode(t or "", add_special_tokens=False).ids) + 1
    assert Counter(dict(kept["packing"].groupby("doc_id").n_tokens.sum())) == wanted
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").select("doc_id").toPandas().doc_id
    good = set(labels) & set(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").toPandas().doc_id)
    assert len(good & set(kept["language"].doc_id)) >= 0.9 * len(good)


def test_language_stage_without_a_labelled_language(rows):
    import corpus_pipeline

    docs = rows([(1, "the house", None), (2, None, None), (3, "", None), (4, "42 !", None), (5, "дом", None)], DOCS + ", lang string")
    out = corpus_pipeline.language_stage(docs.sparkSession, docs, FOLDER)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 5]


def test_language_stage_fills_in_languages(rows):
    import corpus_pipeline

    docs = [(i, "the house and the water of the town " * 5, "en") for i in range(20)] + [(100 + i, "la casa y el agua de la ciudad " * 5, "es") for i in range(20)]
    docs += [(200, "the town and the house", None), (201, "el agua y la casa", None), (202, "42", None), (203, "la casa", "en")]
    docs = rows([(i, t, v, "s", len(t)) for i, t, v in docs], DOCS + ", lang string, source string, n_chars bigint")
    out = corpus_pipeline.language_stage(docs.sparkSession, docs, FOLDER)
    found = {r.doc_id: r.lang for r in out.collect()}
    assert out.columns == docs.columns and len(found) == 43 and 202 not in found
    assert (found[200], found[201], found[203]) == ("en", "es", "en")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
def test_pipeline_without_any_language(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0.5 * docs.count()


def test_held_out_rows_are_not_learned_from(spark, rows, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda docs, labels: seen.update(d=docs.collect(), l=labels.collect()) or quality.Network())
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    corpus_pipeline.quality_stage(spark, docs, FOLDER)
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for side in seen.values() for r in side)
