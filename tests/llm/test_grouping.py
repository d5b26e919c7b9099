"""Spelling variants, clusters and mixtures against plain Python, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadhaul.llm import heap_clusters, source_mixture, spelling_blocks
from threadhaul.llm.common import prepared

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepared(spark)


# --- spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(rows, min_length=6, min_count=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    found = {}
    for word, k in n.items():
        others = [x for x in n if near(word, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= 5 * k else None
        found[word] = (form, k, len(others), n[form] if form else None)
    out = set()
    for word, (form, k, many, form_n) in found.items():
        root = word
        while found[root][0]:
            root = found[root][0]
        out.add((word, form, root, k, many, form_n))
    return out


def spelling_rows():
    rng = random.Random(3)
    base = ["spelling", "variant", "grouping", "éclairÉ", "straße", "aaaaaaaa", "Banana", "x" * 3000, "abcdefgh", "hgfedcba"]
    texts = []
    for doc in range(80):
        words = []
        for word in base:
            for _ in range(rng.randrange(6)):
                letters = list(word)
                for _ in range(rng.choice((0, 0, 0, 1, 2))):
                    at, kind = rng.randrange(len(letters)), rng.randrange(3)
                    at = min(at, 3)
                    if kind == 0:
                        letters[at] = rng.choice("abeÀ")
                    elif kind == 1:
                        letters.insert(at, rng.choice("abÿ"))
                    else:
                        del letters[at]
                words.append("".join(letters))
        texts.append((doc, rng.choice(" 1.×-").join(words)))
    return [*texts, texts[0], (None, texts[1][1]), (90, None), (91, ""), (92, "1 2 3"), (93, "FORMATION " * 200 + "formatien " * 9)]


@pytest.mark.parametrize("settings", [{}, {"tile_words": 3}, {"groups": 1, "tile_letters": 500}, {"spoil_every": 2, "min_length": 3}])
def test_spelling_groups_equal_brute_force(spark, settings):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "w", 1, "c") for i, t in rows], "doc_id long, text string, word string, n int, cell string")
    got = spelling_blocks.spelling_groups(docs.repartition(5), spelling_blocks.Settings(**settings))
    got = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_groups(rows, settings.get("min_length", 6), every=settings.get("spoil_every", 199))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(form for _, form, *_ in want) and any(len(w) > 2000 for w, *_ in want)


def test_spelling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_blocks.spelling_groups(docs).collect() == []
    docs = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling_blocks.spelling_groups(docs).collect() == []


def test_long_texts_are_cut_alike(monkeypatch, spark):
    rows = [(i, t) for i, t in spelling_rows() if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(tuple(r) for r in spelling_blocks.word_counts(docs).collect())
    long = [(i, (t + " ") * 1 + "." * (1 << 20)) for i, t in rows[:3]]
    some = plain_groups(rows[:3], min_count=1)
    got = spelling_blocks.word_counts(spark.createDataFrame(long, "doc_id long, text string"), spelling_blocks.Settings(min_count=1))
    assert {(r.word, r.n) for r in got.collect()} == {(w, n) for w, _, _, n, *_ in some} and want


def test_pairs_of_products_cover_every_pair_once():
    rng = np.random.default_rng(1)
    for size, same in ((20, True), (700, True), (700, False)):
        a = np.sort(rng.integers(0, 4, size))
        b = a if same else np.sort(rng.integers(0, 4, size))
        seen = np.zeros((size, size), int)
        for rows, columns in spelling_blocks._products(a, b, same):
            seen[rows, columns] += 1
        meet = (a[:, None] == 0) | (a[:, None] != b[None, :])
        if same:
            meet &= np.arange(size)[:, None] < np.arange(size)
            seen = np.where(np.arange(size)[:, None] < np.arange(size), seen, 0)
        assert (seen[meet] == 1).all() and seen.max() == 1


# --- clusters


def plain_clusters(rows, clusters, rounds, dimensions):
    kept = [
        (i, tuple(math.floor(256 * x) for x in v))
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(((digest(i), v) for i, v in kept))[:clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        assigned = [min((away(v, c), k) for k, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            members = defaultdict(list)
            for (_, v), (_, k) in zip(kept, assigned):
                members[k].append(v)
            centres = [tuple(sum(c) // len(c) for c in zip(*members[k])) if k in members else c for k, c in enumerate(centres)]
    whole, per = sum(d for d, _ in assigned), Counter()
    for d, k in assigned:
        per[k] += d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, k, d, per[k], whole, text[k]) for (i, _), (d, k) in zip(kept, assigned)), key=repr)


def vector_rows(dimensions):
    rng = random.Random(5)
    middles = [[rng.uniform(-1, 1) for _ in range(dimensions)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.05) for m in rng.choice(middles)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a common vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(500, None), (501, []), (502, [1.0]), (503, [None] * dimensions), (504, [math.nan] * dimensions)]
    rows += [(505, [math.inf] + [0.0] * (dimensions - 1)), (506, [-0.0] * dimensions), (507, [2000.5] * dimensions)]
    return rows


@pytest.mark.parametrize("clusters, rounds, block_rows", [(6, 5, 50), (9, 12, 7), (1, 2, 1000), (600, 2, 64)])
def test_clusters_equal_brute_force(spark, clusters, rounds, block_rows):
    rows = vector_rows(8)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, block int")
    how = heap_clusters.Clustering(dimensions=8, clusters=clusters, rounds=rounds, block_rows=block_rows, blocks_per_bucket=2)
    found = heap_clusters.cluster(df.repartition(4), how)
    assert sorted((tuple(r) for r in heap_clusters.with_inertia(found).collect()), key=repr) == plain_clusters(rows, clusters, rounds, 8)
    if clusters == 6:
        # Once the centroids rest, no gap closes: the heaps spare the comparisons.
        assert found.rescanned[0] == len(found.assignments.collect()) > 5 * found.rescanned[-1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("threadhaul_vectors")]


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    how = heap_clusters.Clustering(dimensions=2, clusters=3)
    assert heap_clusters.with_inertia(heap_clusters.cluster(spark.createDataFrame([], schema), how)).collect() == []
    rows = [(1, [0.5, 1.0]), (2, [3.0, 3.0]), (3, [600_000.0, 0.0])]
    got = heap_clusters.with_inertia(heap_clusters.cluster(spark.createDataFrame(rows, schema), how)).collect()
    assert sorted(r.vec_id for r in got) == [1, 2] and all(r.distance == r.inertia == 0 for r in got)


def test_ties_go_to_the_smaller_number(spark):
    x, c = np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]])
    heaps = heap_clusters.Heaps.unpacked(3, None, 2)
    heaps.rescan(heaps.expired(np.zeros(3)), x, c, np.zeros(3))
    assert heaps.assigned.tolist() == [0, 0]
    # A gap of nothing is popped again even if no centroid moved; state survives packing.
    again = heap_clusters.Heaps.unpacked(3, heaps.packed(), 2)
    assert sorted(again.expired(np.zeros(3)).tolist()) == [0, 1]


def test_large_numbers_are_exact():
    x = np.array([[(1 << 27) - 1, -(1 << 27)]])
    c = np.array([[-(1 << 27), (1 << 27) - 1]])
    assert heap_clusters.squared_distances(x, c)[0, 0] == 2 * ((1 << 28) - 1) ** 2


# --- mixtures


def mixture_rows():
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 300)), rng.choice(["a", "b", "c", "d", None, "zz"])) for i in range(900)]
    rows += [(1000 + i, "x y", "hot") for i in range(700)] + [(2000, None, "a"), (2001, "", "b"), (2002, " \t\x0b", "void")]
    return [*rows, rows[0], rows[0], (None, "one two", "a"), (3000, "é è b", "tiny")]


def plain_targets(rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, targets, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(targets.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        targets.update({s: float(2 * sizes[s]) for s in over} if over else share)
        free -= over or free
    return sizes, targets


def test_mixture_comes_near_its_targets(spark, monkeypatch):
    rows = mixture_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = source_mixture.taken_words(docs.repartition(3)).collect()
    sizes, targets = plain_targets(rows)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= largest[source]
    assert sorted(map(repr, got)) == sorted(map(repr, source_mixture.taken_words(docs).collect()))
    # The mix itself has each row as often, with all of its columns.
    mix = source_mixture.mixed(docs)
    assert mix.columns == docs.columns
    counts = Counter(r.doc_id for r in mix.collect())
    expected = Counter()
    for r in got:
        expected[r.doc_id] += r.copies
    assert counts == +expected


def test_mixture_splits_a_hot_source(spark, monkeypatch):
    rows = [(i, "a b " * (i % 9), "hot" if i % 3 else f"s{i % 11}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(repr, source_mixture.taken_words(docs).collect()))
    whole = source_mixture.with_ordinal
    monkeypatch.setattr(source_mixture, "with_ordinal", lambda *a: whole(*a, parts=9, part_rows=50))
    assert sorted(map(repr, source_mixture.taken_words(docs).collect())) == want


def test_systematic_sampling_crosses_each_number_once(spark):
    rows = [(i, "w " * 10, "a") for i in range(100)] + [(i, "w " * 10, "b") for i in range(100, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mixture.taken_words(docs, source_mixture.Mixture(weights=(1, 1), share=0.05)).collect()
    per = Counter()
    for r in got:
        per[r.source] += r.copies
    assert abs(per["a"] - 25) <= 1 and abs(per["b"] - 25) <= 1
    assert len({tuple(sorted(r.doc_id for r in source_mixture.taken_words(docs, source_mixture.Mixture(seed=s, share=0.05)).where("copies > 0").collect())) for s in (1, 2)}) == 2


def test_mixture_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mixture.taken_words(docs).collect() == []
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in source_mixture.taken_words(docs).collect()] == [(0, 0.0, 0)]
