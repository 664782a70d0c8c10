"""Operators 1, 3, 4, 5 and 7 against brute force, libraries and fixed pages."""
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from infrarisk.llm import pages, pieces, pii, quality, tagger, tokens

from .conftest import CLASHES, split


# 1 -------------------------------------------------------------------------------------------------------------------
def brute_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(0)
    for _ in range(20000):
        x = "".join(rng.choice("ab.@-+ 0123456789.()1.2 @@%é\n") for _ in range(40))
        assert brute_spans(x) == pii.base_spans(x)
    long = "1" * 300_000 + " " + "a" * 300_000 + " x@y.zz " + "1.1." * 50_000
    assert (600_002, 0, 600_008) in pii.base_spans(long)


@pytest.fixture(scope="module")
def model():
    return tagger.train(*pii.training_windows([]))


def test_gradient():
    rng = np.random.Generator(np.random.PCG64(1))
    m = tagger.fresh_model()
    for p in m.parts():
        p += rng.standard_normal(p.shape).astype(np.float32) * 0.1
    x, y = rng.integers(0, tagger.N_CLASSES, (3, 6)), rng.integers(0, tagger.N_TAGS, (3, 6))
    _, grads = tagger._loss(m, x, y)
    for p, g in zip(m.parts(), grads, strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        keep, eps = p[at], 1e-2
        p[at] = keep + eps
        up = tagger._loss(m, x, y)[0]
        p[at] = keep - eps
        down = tagger._loss(m, x, y)[0]
        p[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(float(g[at]), rel=0.05, abs=1e-3)


def test_viterbi_is_best_path(model):
    rng = np.random.Generator(np.random.PCG64(2))
    e = rng.standard_normal((1, 4, tagger.N_TAGS)).astype(np.float32) * 3
    moves, first = model.moves + tagger.allowed(), model.first.copy()
    first[2::2] = -1e9
    best = max(np.ndindex(*[tagger.N_TAGS] * 4), key=lambda t: first[t[0]] + e[0, 0, t[0]] + sum(moves[a, b] + e[0, k + 1, b] for k, (a, b) in enumerate(zip(t, t[1:], strict=False))))
    assert tuple(tagger.viterbi(model, e, np.array([4]))[0]) == best


def test_held_out_accuracy(model):
    x, y = pii.training_windows([], seed=99, generated=300)
    got = tagger.viterbi(model, tagger.emissions(model, x), np.full(len(x), pii.WIDTH))
    assert (got == y).mean() > 0.97 and (got == y)[y > 0].mean() > 0.93


def test_added_spans(model):
    clean = "no personal data stands in chapter 3. of 1999 and none follows " * 3
    text = "reach us under (499) 555-6503 or 4845168114407329 7536784127813050 today " + "x" * 5000 + " mail a.b@mail5.example.com"
    found = pii.tagged(model, [clean, text, "12 " * 9000])
    assert pii.with_added(pii.base_spans(clean), found[0]) == []
    every = pii.with_added(pii.base_spans(text), found[1])
    assert set(pii.base_spans(text)) <= set(every) and any(k == 3 and text[s:e].startswith("(499)") for s, k, e in every)
    assert pii.masked_text(text, every).count("[EMAIL]") == 1


def test_windows_cover():
    for n in (1, 64, 65, 96, 97, 500):
        w = pii.windows(n)
        assert w[0] == 0 and (n <= 64 or w[-1] + 64 == n) and all(b - a <= 32 for a, b in zip(w, w[1:], strict=False))


def test_find(spark, odd, empty, model):
    got = pii.find(odd, carry=["doc_id", "text", *CLASHES], model=model).collect()
    assert len(got) == odd.count() and sum(r.n_phone for r in got) == 1
    masked = pii.mask_documents(odd)
    assert masked.columns == odd.columns and masked.where("text LIKE '%[PHONE]%'").count() == 1
    assert pii.find(empty).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------
def test_page():
    html = """<html><head><title>no</title><style>p{}</style></head><body><h1>Top</h1>loose<p>a<p>b <b>c</b>
      d<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul><table><caption>cap</caption><tr><th>Name<th>V<tr><td>long name<td>1<tr><td>s<td>22</table>
      <pre>k  l
 m</pre><span hidden>no</span><div style="color:red; display : none">no</div><script>"<p>no</p>"</script>x&nbsp;&amp;<br>y</body>after"""
    assert pages.render(html).split("\n") == ["Top", "", "loose", "", "a", "", "b c d", "", "- x", "- y", "  3. q", "  4. r", "", "cap", "Name      | V",
                                              "long name | 1", "s         | 22", "", "k  l", " m", "", "x &", "yafter"]


def test_broken_pages():
    assert pages.render(None) == pages.render("") == ""
    assert pages.render("a < b & c") == "a < b & c"
    assert pages.render("</p></div>x<b>y") == "xy"
    assert pages.render("<div>" * 30000 + "deep") == "deep"
    assert "in | ner" in pages.render("<table><tr><td>o<td><table><tr><td>in<td>ner</table></table>")
    big = pages.render("<table>" + "<tr><td>a<td>b" * 20000 + "</table>")
    assert big.count("\n") == 19999


def test_open_head():
    """A head without end tags ends where content begins."""
    head = "<html><head>\n<meta charset=utf-8><title>no</title> <link rel=x href=y><style>no</style><script>no</script><template>no<p>no</template>\n"
    for body, want in (("<p>a<p>b", "a\n\nb"), ("a<p>b", "a\n\nb"), ("<table><td>a<td>b</table>", "a | b"), ("<img alt=a>b", "ab"), ("&lt;a", "<a"),
                       ("<body>a", "a"), ("</head>a<head>b<title>no</title>c", "abc"), ("<head><head>a", "a")):
        assert pages.render(head + body) == want


@pytest.mark.parametrize("html", [
    "<table><thead><th>Na0<th>Vb1</thead><tr><td>Ac2<td>Bd3</table>Ze4",
    "<table><td>Aa0</td><tr><td>Bb1</table>",
    "<table><tr><form><td>Aa0<td>Bb1</form></tr><tr><td>Cc2</table>Dd3",
    "<p>Pp0<table>Xa1<tr>Xb2<td>Cc3</td>Xd4<div>Xe5<p>Xf6</div><b>Xg7<tr><td>Dh8</table>Ei9",
    "<table><caption>Ca0<tr><td>Ab1</tbody>Xc2<colgroup><col><tbody>Xd3<td>Be4<tfoot><th>Ff5</table>",
    "<table><tr><td>Aa0<table><td>Bb1<table>Xc2<tr><td>Cd3</table>Xe4</table>Df5<table>Xg6<table><td>Gh7</table></table>Hi8",
    "<table>Xa0<ul><li>Xb1<table><li>Xc2<td>Cd3<td><p>De4<tr><th><form>Ef5</table><img alt=Fg6></table>Gh7",
    "<table><tr><td>Aa0<template><tr><td>no<table>no</table>no</template>Bb1<script>no</script></table>",
    "<ol><table><form><tr><input type=hidden value=no><td>Aa0<li>Bb1</form><tr>Xc2<br>Xd3<a>Xe4</a><h2>Xf5</table><li>Cg6</ol><tr><td>Dh7",
])
def test_loose_tables(html):
    """Every visible text is in the page's text, once."""
    text = pages.render(html)
    want = re.findall(r"[A-Z][a-z]\d", html)
    assert sorted(re.findall(r"[A-Z][a-z]\d", text)) == sorted(want) and "no" not in text


def test_loose_rows():
    assert pages.render("<table><thead><th>N<th>V</thead><td>a<td>b</table>") == "N | V\na | b"
    assert pages.render("<table><tr><form><td>a<td>b</form>x<tr><td>c</table>y") == "a | bx\nc\n\ny"
    assert pages.render("<table>x<form><td>a</td>y<td>b<tr>z<td>c</table>") == "xyz\n\na | b\nc"
    assert pages.render("<table>" + "x<td>a" * 20000 + "</table>").count(" | a") == 19999


def test_spans():
    table = lambda s: pages.render(f"<table>{s}</table>").split("\n")
    assert table("<tr><td rowspan=2>a<td>b<tr><td>2") == ["a | b", "  | 2"]
    assert table("<tr><td colspan=2>head<td>c<tr><td>x<td>y<td>z") == ["head  | c", "x | y | z"]
    assert table("<tr><td>p<td rowspan=0>q<td>r<tr><td>s<td>t<tr><td>u<td>v") == ["p | q | r", "s |   | t", "u |   | v"]
    assert table("<thead><tr><th rowspan=9>n<th>m</thead><tbody><tr><td>a<td>b") == ["n | m", "a | b"]
    assert table("<tr><td rowspan=2>a<tr></tr><tr><td>b<td>c") == ["a", "b | c"]
    assert table("<tr><td>a<td rowspan=2>b<tr><td colspan=3>wide<td>d") == ["a    | b", "wide |   | d"]
    assert table("<tr><td colspan=x rowspan=-1>a<td colspan=0>b<tr><td>" + "l" * 300 + "<td>c")[0] == "a | b"
    assert table("<tr><td colspan=1000 rowspan=65534>a<td>b" + "<tr><td>c" * 2000)[-1].strip() == "| c"


def test_visibility():
    assert pages.render("<div style='visibility:hidden'>no<b style='visibility: visible'>a</b>no</div>b") == "a\nb"
    assert pages.render("<div style='display:none'>no<b style='visibility:visible'>no</b></div>b") == "b"
    assert pages.render("<dialog>no</dialog><dialog open>a</dialog>") == "a"
    assert pages.render("<select><option>a<option>b</select>c") == "a\nb\nc"
    assert pages.render("<svg><title>no</title><defs/><text>a</text><path/><style>no</style></svg>b<math><mi>x</mi></math>") == "abx"
    assert pages.render("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>a<tr><td>b<td>c</table>") == "  | a\nb | c"
    assert pages.render("<table style='visibility:hidden'><tr><td>no</table>b") == "b"


def walked(n, seen=True):
    """Visible words of a tree, recursively."""
    if isinstance(n, str):
        return n.split() if seen else []
    style = (n.attrs.get("style") or "").replace(" ", "")
    if n.tag in pages.INVISIBLE or n.tag == "input" or "hidden" in n.attrs or "display:none" in style or (n.tag == "dialog" and "open" not in n.attrs):
        return []
    seen = False if "visibility:hidden" in style else True if "visibility:visible" in style else seen
    return (n.attrs.get("alt", "").split() if n.tag == "img" and seen else []) + [w for k in n.kids for w in walked(k, seen)]


def test_random_pages():
    """Every visible word of any tag soup is in the text once, and no other."""
    rnd = random.Random(11)
    tags = "div p b span ul ol li table tr td th tbody thead caption pre h1 a form dl dt dd select option svg text dialog template script".split()
    odd = ["", "", "", " hidden", " style='display: none'", " style='visibility: hidden'", " style='color:red;visibility: visible'", " open", " colspan=2", " rowspan=3", " colspan=3 rowspan=0"]
    for _ in range(1500):
        parts = []
        for k in range(rnd.randint(1, 40)):
            tag = rnd.choice(tags)
            parts.append(rnd.choice([f"<{tag}{rnd.choice(odd)}>", f"</{tag}>", f" W{k}x ", f"<img alt=A{k}x>", f"<{tag}/>", "<br>"]))
        html = "".join(parts)
        assert sorted(re.findall(r"[WA]\d+x", pages.render(html))) == sorted(re.findall(r"[WA]\d+x", " ".join(walked(pages.parse(html))))), html


def test_deep_pages_in_linear_time():
    took = []
    for n in (10_000, 40_000):
        start = time.perf_counter()
        assert pages.render("<div>" * n + "x" + "<p><li><td>y</b>" * n).count("y") == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 1


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>x", "u"), (1, "<p>x", "u"), (None, None, None)], "page_id long, html string, text string")
    got = pages.extract(df, carry=["page_id"]).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", "x"), ("1", "x"), ("None", "")]
    assert pages.extract(df.limit(0)).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------
def test_like_the_library(corpus):
    import sentencepiece

    p, lib = pieces.read_model(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t or "" for _, t, _ in corpus[0]] + ["   ", "a  b\t\n é 日本語 😀 <s>", "x" * 400 + " " + "ab" * 300, "\x00", "#" * 90, " " * 40 + "z", "Hello World"]
    ids, offs = pieces.Encoder(p).encode(texts)[0]
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == lib.encode(texts)
    assert pieces.decode(p, ids, offs) == texts


def test_unigram_viterbi():
    table = [("a", -1.0), ("b", -1.5), ("ab", -2.0), ("ba", -2.2), ("aba", -2.9), ("▁", -1.0), ("▁a", -1.9), ("bb", -2.4)]
    p, score, rng = pieces.make_pieces(table, pieces.UNIGRAM), dict(table), random.Random(1)
    words = ["▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(300)]

    def best(w):
        return 0.0 if not w else max(score[w[:n]] + best(w[n:]) for n in range(1, 4) if w[:n] in score)

    [(flat, lens)] = pieces.encode_words(p, words)
    for w, ids in zip(words, np.split(flat, np.cumsum(lens)[:-1]), strict=True):
        assert "".join(table[i][0] for i in ids) == w and sum(table[i][1] for i in ids) == pytest.approx(best(w))


def test_viterbi_of_the_file(corpus):
    """The best path over the file's pieces: found by a plain search, and it decodes to the text."""
    p = pieces.read_model()
    texts = [(t or "")[:400] for _, t, _ in corpus[0][:25]] + ["", " a  ▁b\n", "né 日本 😀", "x" * 90 + " y"]
    ids, offs = pieces.Encoder(p, (False, True)).encode(texts)[1]
    assert pieces.decode(p, ids, offs) == [t.replace(pieces.BLANK, " ") for t in texts]
    for word in ("▁Hello", "▁▁tokens", "▁unbelievable", "▁w123", "▁né"):
        best = [0.0]
        for end in range(1, len(word) + 1):
            best.append(max(best[s] + (p.by_text[word[s:end]][1] if word[s:end] in p.by_text else p.scores.min() - 10) for s in range(end) if word[s:end] in p.by_text or end - s == 1))
        [(got, _)] = pieces.encode_words(p, [word], (True,))
        known = {i: score for i, score in p.by_text.values()}
        assert sum(known.get(int(i), p.scores.min() - 10) for i in got) == pytest.approx(best[-1])


def test_words_seen_before(monkeypatch):
    """Ids do not depend on what a task remembers, nor on where slices end."""
    p, rng = pieces.read_model(), random.Random(9)
    texts = [" ".join(rng.choice(["ab", "cde", "x" * 60, "é", "Word", f"n{rng.randrange(99)}"]) for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    whole, offs = pieces.Encoder(p).encode(texts)[0]
    monkeypatch.setattr(pieces, "WORDS_KEPT", 5)
    e = pieces.Encoder(p)
    assert np.concatenate([e.encode(texts[i : i + 7])[0][0] for i in range(0, 80, 7)]).tolist() == whole.tolist() and offs[-1] == len(whole)


def test_encode_documents(odd, empty, tmp_path):
    got = pieces.encode_documents(odd, carry=["doc_id", "text", "ids"], viterbi=True)
    assert got.columns == ["doc_id", "text", "ids", "n_tokens", "_ids", "viterbi_ids", "decoded"]
    got.write.parquet(str(tmp_path / "out"))
    rows = odd.sparkSession.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == odd.count() and all(r.decoded == (r.text or "") and r.n_tokens == len(r._ids) for r in rows)
    assert pieces.encode_documents(odd, decoded=False).columns[-2:] == ["n_tokens", "_ids"]
    assert pieces.encode_documents(empty).count() == 0


def test_encoding_stage_takes_every_step(odd):
    """The pipeline's last stage searches the best path and decodes, too, as the operator's query does."""
    import corpus_pipeline

    got = corpus_pipeline.encoding(odd.sparkSession, odd, "")
    assert got.columns == ["doc_id", "source", "n_tokens", "ids", "viterbi_ids", "round_trip"]
    rows = got.collect()
    encoder = pieces.Encoder(pieces.read_model(), (False, True))
    want = sorted((str(r.doc_id), *[x.tolist() for x, _ in encoder.encode([r.text or ""])], True) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids, r.viterbi_ids, r.round_trip) for r in rows) == want


# 5 -------------------------------------------------------------------------------------------------------------------
def brute_stats(t):
    w = split(t)
    lines = [x for x in (t or "").split("\n") if split(x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_statistics(spark, corpus, empty):
    rows = corpus[0] + [(300, "é# x\ny\n\né# x\n y\nz z z z z |", "a"), (301, "a b c a b c a b c", "b")]
    got = {r[0]: tuple(r[1:6]) for r in quality.statistics(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["doc_id"]).collect()}
    assert got == {i: brute_stats(t) for i, t, _ in rows}
    assert quality.score(empty).count() == 0


def test_estimate_finds_good_rules():
    rng = np.random.Generator(np.random.PCG64(0))
    good = rng.random(6000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.6, 0.9, 0.7, 0.5])
    votes = np.where(rng.random((6000, 8)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, rates, post = quality.estimate(patterns, counts)
    assert np.argmax(rates[:, 1, 2]) in (0, 1) and rates[7, 1, 2] < rates[0, 1, 2]
    named = {tuple(p): q for p, q in zip(patterns, post, strict=True)}
    said = np.array([named[tuple(v)] > 0.5 for v in votes])
    assert (said == good).mean() > 0.95


def test_quality_odd(odd):
    got = quality.score(odd).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got)
    assert quality.filter_documents(odd).columns == odd.columns
    dotted = odd.withColumn("a.b", F.lit(1))
    assert quality.score(dotted).count() == len(got) and quality.filter_documents(dotted.limit(0)).columns == dotted.columns


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), carry=["doc_id"]).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    fair = [r for r in got if not r.base_failed]
    assert sum(r.kept == (r.quality == 1) for r in fair) / len(fair) > 0.97


# 7 -------------------------------------------------------------------------------------------------------------------
def brute_tokens(c, text, starts, ends, rule):
    out, none, at = [0] * len(starts), 0, 0
    char = [k for k, x in enumerate(text) for _ in x.encode()]
    for i in c.coder.encode_ordinary(text):
        n = len(c.coder.decode_single_token_bytes(i))
        hit = [next((j for j in range(len(starts)) if starts[j] <= p < ends[j]), -1) for p in sorted(set(char[at : at + n]))]
        at += n
        inside = Counter(j for j in hit if j >= 0)
        own = {"first": hit[0], "last": hit[-1], "most": min(inside, key=lambda j: (-inside[j], j)) if inside else -1}[rule]
        if own < 0:
            none += 1
        else:
            out[own] += 1
    return out, none


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution(corpus, rule):
    c, rng = tokens.Counter(tokens.read_ranks()), random.Random(3)
    for text in [(t or "")[:300] for _, t, _ in corpus[0][1:25]] + ["😀 é\n\n\n  x", "a\n\nb", "\n", "日本\n語 the words"]:
        cut = sorted(rng.sample(range(len(text) + 1), min(6, len(text) + 1) // 2 * 2))
        for s, e in (tokens.lines(text) if text else (np.empty(0, int), np.empty(0, int)), (np.array(cut[::2], int), np.array(cut[1::2], int))):
            got = c.attribute(text, s, e, rule)
            assert (got[0].tolist(), got[1]) == brute_tokens(c, text, s, e, rule)


def test_count_tokens(spark, odd, empty):
    rows = tokens.count_tokens(odd, carry=["doc_id", "ids"]).collect()
    assert len(rows) == odd.count() and all(sum(r.section_tokens) + r.n_outside == r.n_tokens for r in rows)
    assert tokens.count_tokens(empty).count() == 0
    df = spark.createDataFrame([(1, "alpha beta gamma", [(0, 6), (6, 99)]), (2, "x", None), (3, None, [(0, 3)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {r.doc_id: r for r in tokens.count_tokens(df, sections="parts").collect()}
    assert sum(got[1].section_tokens) == got[1].n_tokens and got[2].n_outside == got[2].n_tokens == 1 and got[3].section_tokens == [0]


def test_results_have_one_column_a_name(spark, odd, tmp_path):
    """Whatever the carried columns are called, results can be written and read by name."""
    from infrarisk.llm import minhash, substrings

    some = odd.withColumns({c: F.lit(1) for c in ("base", "spans", "component_id", "kept", "n_tokens", "n_words", "n_shingles", "a.b", "n_removed")})
    every = [c for c in some.columns if c != "text"]
    for name, made in {"pii": pii.find(some, carry=every), "pairs": minhash.near_duplicates(some, carry=every), "tokens": tokens.count_tokens(some, carry=every),
                       "repeats": substrings.remove_repeats(some, carry=every), "quality": quality.score(some), "pieces": pieces.encode_documents(some, carry=every)}.items():
        assert len({c.lower() for c in made.columns}) == len(made.columns)
        made.write.parquet(str(tmp_path / name))
        assert spark.read.parquet(str(tmp_path / name)).count() == some.count()


def test_training_windows_see_whole_texts(spark):
    """Windows come from everywhere in a text, and a span that a window cuts is labelled as far as it is seen."""
    far = "word " * 400 + "call +1 (212) 555-0100 now " + "word " * 400 + "mail someone.with.a.long.name.that.goes.on.and.on@example.com today"
    drawn = pii.sample(spark.createDataFrame([(far,), (None,), ("",)], "text string"))
    assert any("555-0100" in p for p, _ in drawn) and any("@example" in p for p, _ in drawn)
    spans = pii.base_spans(far)
    for p, own in drawn:
        at = far.index(p)
        assert own == [(s - at, k, e - at) for s, k, e in spans if s < at + len(p) and e > at]


def test_long_stretch_is_decoded_whole(model):
    text = " ".join(f"{k % 10}" for k in range(6000)) + " reach a.b@example.org now"
    assert pii.with_added(pii.base_spans(text), pii.tagged(model, [text])[0]).count((text.index("a.b@"), 0, text.index(" now"))) == 1
