"""Operators 2, 6 and 8 against brute force."""
import hashlib
import random

import numpy as np
import pytest

from infrarisk.llm import minhash, spotsigs, substrings
from infrarisk.llm.components import connected_components

from .conftest import CLASHES, shingles, split


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("k", "t"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates(corpus, k, t):
    rows, df = corpus
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(df, k=k, threshold=t).collect()}
    assert got == brute_components(rows, k, *t)


def test_near_duplicates_in_blocks(corpus, monkeypatch):
    """A candidate component cut into many tiles keeps every link."""
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 4)
    rows, df = corpus
    got = {r[0]: tuple(r[1:]) for r in minhash.near_duplicates(df, k=3, threshold=(85, 100)).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_near_duplicates_odd(odd, empty):
    got = minhash.near_duplicates(odd, carry=["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        n = 1 if r.text else 0
        assert r.n_shingles == n
        if r.text == "a b c d e":
            assert r.component_id == 1
            assert r.kept == (r.doc_id == 1)
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_drop_near_duplicates_odd(spark):
    """One row of each component stays, also without ids and with repeated ones; texts without words are no copies."""
    t, u, v, w = (" ".join(f"{c}{k}" for k in range(40)) for c in "tuvw")
    rows = [(None, t, 1), (None, t, 2), (None, t + " end", 3), (None, u, 4), (5, v, 5), (5, v + " end", 6), (5, v, 7), (5, w, 8), (None, w, 9),
            (None, None, 10), (None, "", 11), (5, "", 12), (5, "", 13), (6, v, 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = [tuple(r) for r in minhash.drop_near_duplicates(df).collect()]
    group = lambda r: (r[1] or "").removesuffix(" end")
    assert sorted(group(r) for r in got if r[1]) == [t, u, v, w] and set(got) <= set(rows)
    assert {r[0] for r in got if group(r) in (v, w)} == {5} and {r[2] for r in got if not r[1]} == {10, 11, 12, 13}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(300, 300), (7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def brute_removed(rows, window):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = split(t), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [20, 9, 3])
def test_remove_repeats(corpus, window):
    rows, df = corpus
    rows = rows + [(200, " ".join(["again"] * 70), "a")]
    df = df.union(df.sparkSession.createDataFrame(rows[-1:], df.schema))
    got = {r[0]: tuple(r[1:]) for r in substrings.remove_repeats(df, window=window).collect()}
    assert got == brute_removed(rows, window)


def test_remove_repeats_in_stretches(corpus, monkeypatch):
    """The same whatever a task resolves together."""
    rows, df = corpus
    monkeypatch.setattr(substrings, "STRETCH", 50)
    got = {r[0]: tuple(r[1:]) for r in substrings.remove_repeats(df).collect()}
    assert got == brute_removed(rows, 20)


def test_covers():
    for v, d in substrings.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_remove_repeats_odd(spark, odd, empty):
    t = " ".join(f"v{k}" for k in range(30))
    more = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "x " + t), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(more).collect()), key=str)
    # rows that repeat id and text are one document; the null id comes last
    firsts = [g for g in got if g[0] == 5]
    assert (4, 0, 0) in got and (None, 30, 30) in got
    assert sorted(firsts) in ([(5, 30, 0), (5, 30, 0), (5, 31, 30)], [(5, 30, 30), (5, 30, 30), (5, 31, 0)])
    assert substrings.remove_repeats(odd, carry=["doc_id", *CLASHES[2:]]).count() == odd.count()
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("stretch", [substrings.STRETCH, 25])
def test_remove_repeats_of_repeated_rows(spark, monkeypatch, stretch):
    """Repeated rows, with and without an id, are no earlier occurrence of each other, wherever they meet."""
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    t, u, v = (" ".join(f"{c}{k}" for k in range(30)) for c in "tuv")
    again = " ".join(["again"] * 50)
    rows = [(5, t), (5, t), (None, u), (None, u), (None, u), (6, v), (6, v), (7, v), (8, again), (8, again), (None, v), (None, v)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(df).collect()), key=str)
    want = [(5, 30, 0, t)] * 2 + [(None, 30, 0, u)] * 3 + [(6, 30, 0, v)] * 2 + [(7, 30, 30, "")] + [(8, 50, 49, "again")] * 2 + [(None, 30, 30, "")] * 2
    assert got == sorted(want, key=str)


def brute_signature(t, chain=2):
    import regex

    tokens = [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    common = spotsigs.COMMON
    at = [i for i, w in enumerate(tokens) if w not in common]
    runs = [(at[k], tuple(tokens[i] for i in at[k : k + chain])) for k in range(len(at) - chain + 1)]
    spots = {(tokens[i - 1], *c) for i, c in runs if i > 0 and tokens[i - 1] in common}
    return spots or {("", *c) for _, c in runs} or ({" ".join(tokens)} if tokens else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_fingerprints(spark, corpus):
    rows, df = corpus
    stops = ["the", "of", "la", "der"]
    rows = [(i, None if t is None else " ".join(stops[len(w) % 4] if n % 3 == 0 else w for n, w in enumerate(t.split(" "))), s) for i, t, s in rows]
    df = spark.createDataFrame(rows, df.schema).repartition(4)
    got = {r.doc_id: r for r in spotsigs.compared(df).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        r, (a, b, c) = got[i], map(brute_signature, (t, changed, nxt))
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(a, b)) and r.near_next == pytest.approx(jaccard(a, c))
        assert len([x for x in r.fingerprint.split(",") if x]) == len(a)


def test_fingerprint_pairs(corpus):
    rows, df = corpus
    pairs, members = spotsigs.similar_pairs(df, threshold=0.6)
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    sigs = {i: brute_signature(t) for i, t, _ in rows}
    want = {tuple(sorted((of[a], of[b]))) for a in sigs for b in sigs if of[a] != of[b] and sigs[a] and sigs[b] and jaccard(sigs[a], sigs[b]) >= 0.6}
    assert {tuple(sorted((r.a, r.b))) for r in pairs.collect()} == want and want
    groups = {r["doc_id"]: r["group"] for r in spotsigs.similar_groups(df, threshold=0.6).collect()}
    assert len(groups) == len(rows) and all(groups[a] == groups[b] for a in sigs for b in sigs if of[a] == of[b])


def test_fingerprints_odd(spark, odd, empty):
    assert spotsigs.compared(odd).count() == odd.count()
    assert spotsigs.compared(empty).count() == 0
    alone = spotsigs.compared(spark.createDataFrame([(1, "the cat sat on a mat")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    blank = {r.doc_id: r for r in spotsigs.compared(spark.createDataFrame([(1, None), (2, "!?")], "doc_id long, text string")).collect()}
    assert blank[1].fingerprint == "" and blank[1].near_edited == 1.0 and blank[2].n_chars == 2


def test_signature_is_stable():
    assert np.array_equal(minhash._minima(np.arange(9, dtype=np.uint64), 12), minhash._minima(np.arange(9, dtype=np.uint64), 12))
    assert minhash.bands_for(0.85) == 30


@pytest.mark.parametrize("slices", [1, 2, 7, 50, 700])
def test_next_documents(spark, slices):
    """Neighbours by ascending id, for few and many slices, gaps in the ids and one id alone at the end."""
    ids = [i * i - 300 for i in range(400)] + [10**12]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["id"]: r["next_text"] for r in spotsigs.with_next(df, "doc_id", "text", slices).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
