"""Quality rules by weak supervision (operator 5).

Every rule votes *good* (1), *bad* (-1) or abstains (0) on a document.  Which rules to trust is not
fixed: expectation-maximisation over the votes estimates each rule's outcome rates for good and bad
documents (a two-class latent model with independent rules), and the posterior probability of *good*
replaces all-must-pass filtering.

Scale: one pass computes the document statistics; the model sees only the counts of vote patterns, at
most ``3 ** len(RULES)`` rows whatever the size of the corpus, aggregated with map-side combine.  The
estimated posterior of each pattern is joined back as a table of that bounded size.

Defined cases: a null text counts as an empty one: no words, zero statistics, ``base_failed``.
Repeated rows and ties get the same verdict each; an empty table gives an empty result; further columns
pass through ``score`` untouched unless they are named like one of its outputs (then the input column
is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, written
from .words import IS_WORD, chained, slices

#: Frequent function words of the corpus languages (English, French, German, Spanish).
STOPWORDS = """the of and to in is that it with as for by on are this be was at or an from
le la les de des du et un une en que qui est dans pour par sur au avec ne pas ce
der die das und ist von mit den zu ein eine nicht auf für im dem sich des auch es
el los las del y que en un una con por para se no su al lo como más""".split()
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_ended_lines", "n_alpha_words", "n_stopwords")
RULES = ("length", "repetition", "symbols", "duplicate_lines", "word_length", "alphabetic", "stopwords", "line_ends")
MIN_WORDS = 50
KEEP_AT = 0.5  # least posterior probability of a good document
PRIOR_GOOD = 0.85  # where the estimation starts
EM_ROUNDS = 200
_SPACE = " \t\n\v\f\r"
_ENDS = (".", "!", "?", ":", '"', "”", "»", "…")


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple]:
    """name -> (condition of a bad vote, condition of a good vote); neither: the rule abstains."""
    n = F.col("n_words")
    repeats, symbols, chars = _ratio("n_repeat_words", "n_words"), _ratio("n_symbols", "n_words"), _ratio("word_chars", "n_words")
    dups, alpha, stops = _ratio("n_dup_lines", "n_lines"), _ratio("n_alpha_words", "n_words"), _ratio("n_stopwords", "n_words")
    return {
        "length": (n < MIN_WORDS, n >= 2 * MIN_WORDS),
        "repetition": (repeats > 0.3, repeats < 0.1),
        "symbols": (symbols > 0.2, symbols < 0.05),
        "duplicate_lines": ((dups > 0.3) & (F.col("n_dup_lines") >= 3), (dups < 0.1) & (F.col("n_lines") >= 2)),
        "word_length": ((chars < 2.5) | (chars > 12), chars.between(3, 9)),
        "alphabetic": (alpha < 0.6, alpha > 0.9),
        "stopwords": ((stops < 0.02) & (n >= 20), stops > 0.1),
        "line_ends": ((_ratio("n_ended_lines", "n_lines") < 0.1) & (n >= 20), _ratio("n_ended_lines", "n_lines") > 0.6),
    }


def _text_stats(w, text_of) -> np.ndarray:
    """One row of STATS for each document of a slice; ``text_of(k)`` gives its text."""
    n = len(w.offs) - 1
    out = np.zeros((n, len(STATS)), np.int64)
    out[:, 0] = w.counts()
    head = np.arange(n + 1)
    csum = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offs[head]])
    out[:, 1] = csum(IS_WORD[w.data] & ((w.data & 0xC0) != 0x80))
    out[:, 2] = csum(SYMBOLS[w.data])
    # words covered by a 3-word window that its document holds twice or more
    at = np.flatnonzero(w.windows(3))
    key = chained(w.hashes(), 3, at) ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 3, -1)
    out[:, 4] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    # words that hold a letter or a non-ASCII character
    letter = w.data | 0x20
    letter = ((letter >= 97) & (letter <= 122)) | (w.data >= 128)
    upto = np.concatenate([[0], np.cumsum(letter)])
    out[:, 7] = np.bincount(w.doc[upto[w.ends] > upto[w.starts]], minlength=n)
    out[:, 8] = np.bincount(w.doc[np.isin(w.hashes(lower=True), _stop_hashes())], minlength=n)
    for k in range(n):
        lines = [x for x in text_of(k).split("\n") if x.strip(_SPACE)]
        out[k, 3] = len(lines) - len(set(lines))
        out[k, 5] = len(lines)
        out[k, 6] = sum(x.rstrip(_SPACE).endswith(_ENDS) for x in lines)
    return out


def _stop_hashes() -> np.ndarray:
    _, _, w = next(slices(pa.array([" ".join(dict.fromkeys(STOPWORDS))])))
    return w.hashes()


def statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) plus the nine statistics of each whole text."""
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in STATS]
    hidden = fresh("text_", carry)
    schema = T.StructType([T.StructField(f"c{k}", docs.select(F.col(f"`{c}`")).schema[0].dataType) for k, c in enumerate(carry)] + [T.StructField(c, T.LongType()) for c in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, parts = b.column(b.schema.get_field_index(hidden)), []
            for i, j, w in slices(col):
                own = col.slice(i, j - i)
                parts.append(_text_stats(w, lambda k, own=own: own[k].as_py() or ""))
            made = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(carry))] + [pa.array(made[:, k]) for k in range(len(STATS))], names=schema.names)

    given = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], F.col(f"`{text}`").alias(hidden))
    return given.mapInArrow(run, schema).toDF(*carry, *STATS)


def with_votes(stats: DataFrame) -> DataFrame:
    vote = lambda bad, good: F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")
    return stats.withColumns({f"vote_{k}": vote(*v) for k, v in rules().items()})


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: float = PRIOR_GOOD, rounds: int = EM_ROUNDS):
    """EM over vote patterns: (prior, rates[rule, class, outcome], posterior of *good* per pattern).

    Starts from a simple majority of votes, so *good* keeps its meaning; rates are smoothed by one
    pseudo-vote, so no rule becomes certain.
    """
    if not len(patterns):
        return prior, np.full((len(RULES), 2, 3), 1 / 3), np.zeros(0)
    counts = counts.astype(float)
    score = patterns.sum(1)
    post = np.where(score > 0, 0.9, np.where(score < 0, 0.1, prior))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, outcome
    for _ in range(rounds):
        good, bad = post * counts, (1 - post) * counts
        prior = (good.sum() + 1) / (counts.sum() + 2)
        rates = np.stack([np.einsum("p,pro->ro", x, onehot) + 1 for x in (bad, good)], axis=1)
        rates /= rates.sum(2, keepdims=True)
        log = np.einsum("pro,rco->pc", onehot, np.log(rates)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return prior, rates, post


def _posteriors(voted: DataFrame) -> DataFrame:
    """Posterior of every vote pattern that occurs: at most 3 ** len(RULES) rows."""
    votes = [f"vote_{k}" for k in RULES]
    seen = sorted(tuple(r) for r in voted.groupBy(*votes).count().collect())
    patterns = np.array([r[:-1] for r in seen], dtype=np.int64).reshape(len(seen), len(votes))
    _, _, post = estimate(patterns, np.array([r[-1] for r in seen]))
    schema = T.StructType([T.StructField(v, T.IntegerType()) for v in votes] + [T.StructField("posterior", T.DoubleType())])
    return voted.sparkSession.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, post, strict=True)], schema)


def _judged(voted: DataFrame, table: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.join(F.broadcast(table), [f"vote_{k}" for k in RULES], "left").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT)))


def score(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, statistics, votes, ``base_failed``, ``posterior`` and ``kept``."""
    own = {*STATS, *[f"vote_{k}" for k in RULES], "base_failed", "posterior", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in own]
    voted = with_votes(written(statistics(docs, text, carry), "quality"))
    return _judged(voted, _posteriors(voted))


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    Statistics are worked out twice, once for the estimate and once beside the rows: that costs less than a copy of the corpus.
    """
    posteriors = _posteriors(with_votes(statistics(docs, text, [])))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(f"`{text}`").alias("text"))
    kept = _judged(with_votes(statistics(packed, "text", ["row_"])), posteriors).where("kept")
    return kept.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])


def q_op5(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from .common import table

    return score(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 9).alias("posterior"))
