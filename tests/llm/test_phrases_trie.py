"""Operators 11, 12 and 13 against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from infrarisk.llm import licences, prefixes, stripes

from .conftest import CLASHES, split


# 11 ------------------------------------------------------------------------------------------------------------------
def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    convs = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        host = c - int(np.fmod(c, 20))
        built[c] = tuple(convs.get(host, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(cs) - 1) * len(split(k[-1][1])) if k else 0
    return sorted((min(cs), len(k), min(members[k[:-1]]) if k else -1, len(cs), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, cs in members.items())


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefixes.trie(df).collect())


@pytest.fixture
def some_conversations():
    rng = random.Random(11)
    says = ["hello there", "one two three", "", None, "x"]
    rows = []
    for c in range(-45, 130):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn else "system", says[0] if turn == 0 else rng.choice(says)))
    copy = [(t, "user" if t % 2 else None, f"long {t}" if t % 3 else "same text") for t in range(90)]
    for c in (200, 203, 206, 207, 260):  # deep ones, which share a long beginning and part late
        rows += [(c, t, r, x if t < 70 or c < 207 else f"{x} {c}") for t, r, x in copy]
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (300, 0, "assistant", "second"), (300, 0, "assistant", "second")]
    rows += [(None, 0, "user", "belongs nowhere"), (301, 0, "u", "1:b"), (302, 0, "u1:", "b")]
    return rows


@pytest.mark.parametrize("band", [32, 4])
def test_trie(spark, some_conversations, band, monkeypatch):
    monkeypatch.setattr(prefixes, "BAND", band)
    monkeypatch.setattr(prefixes, "SLICE", 16)
    monkeypatch.setattr(prefixes, "CHUNK", 16)
    df = spark.createDataFrame(some_conversations, "conv_id long, turn long, role string, text string").repartition(4)
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1))
    assert trie_rows(df) == brute_trie(some_conversations)


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie_rows(spark.createDataFrame([], schema)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b")], schema)) == []


# 12 ------------------------------------------------------------------------------------------------------------------
def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    subsumed = set()
    for (lang, g), a in cand.items():
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                if j - i < len(g) and a >= f[lang, g[i:j]]:
                    subsumed.add((lang, g[i:j]))
    out = defaultdict(list)
    for (lang, g), a in cand.items():
        if (lang, g) not in subsumed:
            score, k = min(((1000 * a * n[lang]) // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def found_collocations(df, **kw):
    return sorted(tuple(r) for r in stripes.collocations(df, **kw).collect())


@pytest.fixture
def phrases():
    rng = random.Random(12)
    rows = []
    for i in range(300):
        w = [rng.choice("a b c d É f G".split()) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            w[0:0] = ["New", "york", "stock", "exchange", "Inc"]
        seps = [rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0b"]) for _ in w]
        rows.append((rng.choice(["en", "en", None, "und", "de"]), "".join(x + s for x, s in zip(w, seps, strict=True))))
    rows += [("en", None), ("en", ""), ("en", " . , "), ("de", "na na na na na na na na na na " * 300), ("x", "lone"), ("en", rows[0][1]), ("en", rows[0][1])]
    return rows


@pytest.mark.parametrize(("held", "hot"), [(1 << 20, 1 << 16), (64, 8)])
def test_collocations(spark, phrases, held, hot, monkeypatch):
    monkeypatch.setattr(stripes, "HELD", held)
    monkeypatch.setattr(stripes, "HOT", hot)
    monkeypatch.setattr(stripes, "ROW_ENTRIES", 16)
    df = spark.createDataFrame(phrases, "lang string, text string").repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(1))
    for least, top in ((8, 2000), (30, 5)):
        assert found_collocations(df, least=least, top=top) == brute_collocations(phrases, least, top)


def test_collocations_of_nothing(spark):
    schema = "lang string, text string"
    assert found_collocations(spark.createDataFrame([], schema)) == []
    assert found_collocations(spark.createDataFrame([("en", None), (None, "one two")], schema)) == []


def test_merge_tells_entries_with_one_sort_key_apart(monkeypatch):
    monkeypatch.setattr(stripes, "mix", lambda x: x * np.uint64(0))
    rng = np.random.Generator(np.random.PCG64(5))
    p, w = rng.integers(0, 4, 200).astype(np.uint64), rng.integers(0, 4, 200).astype(np.uint64)
    e = stripes.joined([stripes.Entries(p, p, w, np.ones(200, np.int64))])
    assert {(int(a), int(b)): int(c) for a, b, c in zip(e.p1, e.word, e.count, strict=True)} == Counter(zip(p.tolist(), w.tolist(), strict=True))


def test_bitmap_never_loses_a_phrase(spark, monkeypatch):
    monkeypatch.setattr(stripes, "MOST_BITS", 1 << 8)  # far too small: only more is counted
    keys = [random.Random(i).randrange(-(2**63), 2**63) for i in range(500)]
    bits = stripes._bitmap(spark.createDataFrame([(k,) for k in keys], "q1 long"))
    at = stripes._bits_at(np.array(keys, np.int64).view(np.uint64), len(bits) * 8)
    assert ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all()


# 13 ------------------------------------------------------------------------------------------------------------------
def brute_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), sorted((i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_places():
    rng = random.Random(13)
    scanner = licences.Scanner()
    parts = ["cc", "by", "General", "public", "LICENSE", "all", "rights", "reserved", "é", "nc", "mit", "x1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice([" ", "-", "\n", ". ", "", "\x00", "  "]) for _ in range(rng.randrange(0, 25)))
        n, places, _, _ = scanner.scan(text)
        assert (n, sorted((p[0], p[2]) for p in places if p[3])) == brute_places(text)


def test_postfix():
    ask = lambda x: licences.postfix(licences._TOKEN.findall(x))
    assert ask("a or b and c with d") == "a b c d with and or".split()
    assert ask("(a or b) and c") == "a b or c and".split()
    assert ask("a and (b or (c and d)") == "a b c d and or and".split()
    assert ask("a or") == ["a"] and ask("or a") == [] and ask("a b") == ["a"] and ask(")") == [] and ask("a) b") == ["a"]
    assert len(ask("(" * 100_000 + "a" + ")" * 100_000)) == 1

    def value(tokens):  # recursive reference: or < and < with
        def level(i, ops):
            if not ops:
                if tokens[i] == "(":
                    v, i = level(i + 1, ["or", "and", "with"])
                    return v, i + 1
                return licences.FREEDOM[tokens[i]], i + 1
            v, i = level(i, ops[1:])
            while i < len(tokens) and tokens[i] == ops[0]:
                w, i = level(i + 1, ops[1:])
                v = max(v, w) if ops[0] == "or" else min(v, w) if ops[0] == "and" else (v + 1) / 2
            return v, i
        return level(0, ["or", "and", "with"])[0]

    rng = random.Random(3)

    def expression(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(list(licences.FREEDOM))]
        a, b = expression(depth - 1), expression(depth - 1)
        both = a + [rng.choice(["or", "and", "with"])] + b
        return ["(", *both, ")"] if rng.random() < 0.6 else both

    for _ in range(500):
        e = expression(4)
        assert licences.freedom(licences.postfix(e)) == pytest.approx(value(e))


def test_licence_texts(spark):
    texts = {
        "Released under the MIT License or the GNU General Public License.": ("gpl", "gpl,mit", 0.9),
        "Released under the MIT License and the GNU General Public License.": ("gpl", "gpl,mit", 0.4),
        "MIT License. Something else. General Public License": ("gpl", "gpl,mit", 0.4),
        "Licensed under CC BY-NC 4.0.": ("cc-by", "cc-by,cc-by-nc", 0.2),
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0": ("", "apache,exception,gpl,mit", 0.7),
        "SPDX-License-Identifier:": ("", "other", 0.5),
        "GNU GPL with the classpath exception": ("", "exception,gpl", 0.7),
        "no words of that kind": ("", "", 0.5), "": ("", "", 0.5), None: ("", "", 0.5),
        "cc by cc by all rights reserved": ("cc-by,reserved", "cc-by,reserved", 0.0),
    }
    extra = ["licence", "found", "own", "places", "score", "a.b"]
    df = spark.createDataFrame([(t, *[1] * len(extra)) for t in texts], "text string, " + ", ".join(f"`{c}` int" for c in extra))
    out = licences.scan(df.withColumn("shown", F.col("text")))
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.columns[-1] == "_licence"
    got = {r["shown"]: r["_licence"] for r in out.collect()}
    for t, (base, labels, score) in texts.items():
        g = got[t]
        assert (",".join(sorted({p["label"] for p in g["places"] if p["base"]})), ",".join(g["labels"]), pytest.approx(score)) == (base, labels, g["score"]), t
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_licence_text():
    text = "all rights reserved " * 100_000
    n, places, expressions, _ = licences.Scanner().scan(text + "SPDX-License-Identifier: " + "(" * 50_000 + "MIT")
    assert n == 300_004 and sum(p[3] for p in places) == 100_000 and "mit" in expressions
