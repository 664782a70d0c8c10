"""Operators 9 and 10, the registered queries against their SQL, and the pipeline."""
import hashlib
import random

import numpy as np
import pytest

from infrarisk.llm import chat, mixing
from infrarisk.llm.queries import ORACLE, REGISTRY

from .conftest import split


# 9 -------------------------------------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return {**capped, **t}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 900, "c": 50, "é": 3, None: 7}, {"x": 10}, {"a": 0, "b": 5, "c": 9, "d": 2, "e": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_flight_keeps_totals():
    rng = np.random.Generator(np.random.PCG64(1))
    size, p = rng.integers(1, 900, 400).astype(float), rng.random(400)
    q = mixing.flight(p, size, rng.random)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    r = mixing.landing(q, size, p)
    assert set(r) <= {0.0, 1.0} and abs((r * size).sum() - (p * size).sum()) < 2


def test_flight_is_unbiased():
    rng, size, p = np.random.Generator(np.random.PCG64(2)), np.array([3.0, 5, 8, 2, 2, 7]), np.array([0.3, 0.6, 0.5, 0.2, 0.9, 0.5])
    mean = np.mean([mixing.flight(p, size, rng.random) for _ in range(4000)], axis=0)
    assert mean == pytest.approx(p, abs=0.03)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)  # several levels
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["big"] * 6 + ["b", "c", None])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(3)).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(split(rows[r.doc_id][1])) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 3 for s in sizes)
    corpus = mixing.mix_documents(df)
    assert corpus.columns == df.columns
    seen = {}
    for r in corpus.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {r.doc_id: r.copies for r in got if r.copies}


def test_mix_odd(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_documents(odd).columns == odd.columns and mixing.mix_documents(odd).count() >= 0
    assert mixing.mix(empty).count() == mixing.mix_documents(empty).count() == 0


def test_mix_keeps_rows(spark, odd):
    """The mix holds as many rows as it has copies, also of a single document without an id."""
    alone = spark.createDataFrame([(None, "a b c", "s")], "doc_id long, text string, source string")
    for docs in (alone, odd):
        assert mixing.mix_documents(docs).count() == sum(r.copies for r in mixing.mix(docs).collect()) > 0


# 10 ------------------------------------------------------------------------------------------------------------------
def fold_by_hand(events):
    told = {}  # message -> [role, text, opened at]
    for seq, kind, message, role, payload in sorted(events):
        if kind == "open":
            told[message] = [role, payload, seq]
        elif kind == "delta":
            told[message][1] += payload
        else:
            told[message][1] = payload
            told = {m: v for m, v in told.items() if m <= message or v[2] > seq}
    return [(told[m][0], told[m][1]) for m in sorted(told)]


def test_fold(spark):
    rng, rows, want = random.Random(8), [], {}
    for conv in range(25):
        events, known = [], 0
        for seq in range(rng.randrange(1, 30)):
            kind = "open" if not known or rng.random() < 0.3 else rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
            if kind == "open":
                known += 1
                events.append((seq, kind, known, rng.choice(["user", "assistant"]), ""))
            else:
                standing = [m for m in range(1, known + 1) if m in alive(events)]
                events.append((seq, kind, rng.choice(standing), None, "" if kind == "regenerate" else f"t{seq}<s> "))
        want[conv] = fold_by_hand(events)
        rows += [(conv, *e) for e in events]
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, payload string")
    got = {}
    for r in sorted(chat.fold(log).collect(), key=lambda r: (r.conv_id, r.message)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == want
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    assert back == want


def alive(events):
    out = {}
    for seq, kind, m, *_ in sorted(events):
        if kind == "open":
            out[m] = seq
        elif kind in ("edit", "regenerate"):
            out = {x: s for x, s in out.items() if x <= m or s > seq}
    return out


def test_round_trip(spark):
    nasty = ["<s>", "</s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST", "<</s>", "</s", "x[\\/INST]<", "", "\n", None, "a" * 1000 + "é😀", "[INST][INST]\\", "$1\\1"]
    rows = [(1, k, "assistant" if k % 2 else t, t) for k, t in enumerate(nasty)] + [(None, 0, "user", "hi"), (2, None, None, "last"), (2, 0, "user", "first"), (2, 0, "assistant", "same turn"), (3, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.as_log(df, chunk=7)))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if k % 2 else t or "", t or "") for k, t in enumerate(nasty)]
    assert got[1].loss_texts == [t or "" for k, t in enumerate(nasty) if k % 2]
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "same turn"), ("user", "first"), ("", "last")]
    assert len(got) == 4 and got[3].formatted == "<s>[INST]user[/INST]</s>"
    assert chat.render(chat.fold(chat.as_log(df.limit(0)))).count() == 0


# Queries -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df, res = REGISTRY[name](spark, sf), con.execute(ORACLE[name])
    assert df.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, df.collect())) == sorted(res.fetchall())


def test_planted_conversation(spark):
    row = REGISTRY["op10_chat"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert row.loss_chars == len(t) and row.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from infrarisk.llm import minhash, pii, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        made.append(now)
    given = {r.doc_id: r for r in docs.collect()}
    verdict = {r.doc_id for r in quality.score(docs, carry=["doc_id"]).where("kept").collect()}
    good = {r.doc_id for r in made[0].collect()}
    assert good == verdict and all(m.columns == docs.columns for m in made[:4])
    from .test_pairs import brute_components

    comp = brute_components([(i, given[i].text) for i in good], 5, 80, 100)
    single = {r.doc_id for r in made[1].collect()}
    assert single == {i for i, (_, _, kept) in comp.items() if kept}
    masked = {r.doc_id: r for r in made[2].collect()}
    assert set(masked) == single and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in masked.values())
    mix = made[3].collect()
    assert {r.doc_id for r in mix} <= single and all(r.text == masked[r.doc_id].text for r in mix)
    assert made[4].count() == len(mix)
    assert minhash.bands_for(0.8) > 30
