import random
import re

import pytest

from infrarisk.llm.common import ready

#: Extra columns whose names clash with names the operators use inside or return.
CLASHES = ["key", "n_words", "kept", "id", "h", "pos", "size", "target", "p", "block", "own", "row", "text_", "component_id", "spans", "ids", "rank", "copies"]


@pytest.fixture(scope="session", autouse=True)
def _importable(spark):
    ready(spark)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, DataFrame): near copies, exact copies, shared passages, blank, null and one very long text."""
    rng = random.Random(4)
    rows = [(0, " ".join(words(rng, 40000, 30000))), (1, ""), (2, None), (3, " \t\n "), (4, "one"), (5, "One two"), (6, "one TWO")]
    passage = words(rng, 30)
    base = words(rng, 150, 3000)
    for k in range(60):
        w = list(base) if k % 2 else words(rng, rng.randrange(5, 200), 5000)
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if k % 5 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((7 + k, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100 + k, rows[10 + k % 3][1]) for k in range(12)]
    rows = [(i, t, "abc"[i % 3]) for i, t in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and sources, repeated ids, rows repeated as a whole, and clashing extra columns."""
    rows = [(None, "a b c d e"), (None, None), (1, "a b c d e"), (1, "a b c d e"), (1, "other words stand here now"), (2, ""), (None, "a b c d e"), (3, "call +1 (212) 555-0100 now")]
    rows = [(i, t, None if i == 3 else "s", *[7] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in split(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
