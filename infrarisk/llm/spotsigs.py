"""Document fingerprints by SpotSigs (operator 6): DataFrame functions only.

A text's tokens are its lower-cased runs of letters and digits.  Wherever a common word (the *anchor*) stands right
before a content word, the anchor and the chain of ``CHAIN`` content words that follow (common words between them
skipped) form one spot signature; the fingerprint is the set of hashed signatures.  Texts without such a spot take
every chain with an empty anchor; texts with fewer content words than a chain take their whole token sequence.

Likeness is the Jaccard similarity of the sets, 1 for equal fingerprints.  ``similar_pairs``, a helper that no
registered query runs, finds all pairs above a threshold: fingerprints are partitioned by set length, only partitions whose length ratio can reach the threshold
meet, and inside them only documents that share one of their rarest signatures (a prefix as long as the
threshold allows) are compared in full.

``next`` of a document is the following one in ascending id.  Ids are cut into slices at fixed quantile edges
taken from the data; a slice's first document is also dealt to the slice before, so one shuffle and a window per
slice find every neighbour and no window spans the table.

Defined cases: null texts are empty; an empty text (or one without letters and digits) has the empty
fingerprint, which is like itself (1) and unlike all others (0).  Null ids sort last; documents with equal ids follow
each other by text hash.  A single document is its own next.  Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, table, written
from .components import connected_components

CHAIN = 2
SLICE_BYTES = 4 << 20
MOST_SLICES = 1 << 16  # edges stand in the plan (0.5 MB); a slice is 4 MB or this share of the table, 1.6 GB of 100 TB, whichever is more
#: Frequent function words of the corpus languages (English, French, German, Spanish).
COMMON = """the of and to in is that it with as for by on are this be was at or an from he his they
le la les de des du et un une en que qui est dans pour par sur au avec ne pas ce il
der die das und ist von mit den zu ein eine nicht auf für im dem sich auch es
el los las del y con por se no su al lo como más""".split()


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once a row (a lambda variable is never inlined)."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of a text's spot signatures: array<bigint>."""
    common = lambda w: w.isin(*COMMON)
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def spots(t: Column) -> Column:
        places = F.filter(F.transform(t, lambda w, i: F.when(common(w), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

        def of(p: Column) -> Column:
            ahead = F.size(p) - chain + 1
            chained = lambda k: [F.get(t, F.get(p, k + j)) for j in range(chain)]
            before = lambda k: F.get(p, k) - 1
            anchored = lambda k: (F.get(p, k) > 0) & (F.when(k > 0, F.get(p, k - 1)).otherwise(F.lit(-1)) < before(k))
            every = F.when(ahead > 0, F.sequence(F.lit(0), ahead - 1)).otherwise(F.array().cast("array<int>"))
            anchors = F.array_compact(F.transform(every, lambda k: F.when(anchored(k), F.xxhash64(F.get(t, before(k)), *chained(k)))))
            plain = F.transform(every, lambda k: F.xxhash64(F.lit(""), *chained(k)))
            short = F.when(F.size(t) > 0, F.array(F.xxhash64(F.array_join(t, " ")))).otherwise(F.array().cast("array<bigint>"))
            return _let(anchors, lambda a: F.when(F.size(a) > 0, a).when(ahead > 0, plain).otherwise(short))

        return _let(places, of)

    return F.array_sort(F.array_distinct(_let(tokens, spots)))


def fingerprint(sigs: Column) -> Column:
    """The set as text: its hashes in hex, joined by commas."""
    return F.array_join(F.transform(sigs, lambda h: F.lower(F.hex(h))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets, by their intersection; equal ones are 1, and an empty one is 0 to others."""
    inter = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_let(inter, lambda i: i / (F.size(a) + F.size(b) - i)))


def with_next(docs: DataFrame, id_col: str, text: str, slices: int) -> DataFrame:
    """(id, text, next_text) with nulls of text as empty; see the module's note on slices."""
    ident = F.col(f"`{id_col}`").cast("long")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(ident.alias("id"), F.coalesce(ident, F.lit(LAST_ID)).alias("key"), body.alias("text"))
    asked = F.lit([i / slices for i in range(slices)]).cast("array<double>")
    edges = sorted(set(docs.select(F.coalesce(ident, F.lit(LAST_ID)).alias("key")).agg(F.percentile_approx("key", asked, 10 * slices).alias("e")).first()["e"] or [0]))
    least = docs.agg(F.min(F.coalesce(ident, F.lit(LAST_ID)))).first()[0]
    edges = sorted({*edges, least if least is not None else 0})
    last, width = len(edges) - 1, math.isqrt(len(edges) - 1) + 1
    # edges in runs of ``width``: a row looks through the runs' first edges, then through one run
    runs = F.lit([edges[i:i + width] for i in range(0, len(edges), width)]).cast("array<array<bigint>>")
    heads = F.lit(edges[::width]).cast("array<bigint>")
    up_to = lambda found: F.size(F.filter(found, lambda e: e <= F.col("key"))) - 1
    own = _let(up_to(heads), lambda k: k * width + up_to(F.get(runs, k)))
    guest = F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1)
    first = F.get(F.get(runs, F.floor(F.col("own") / width).cast("int")), F.col("own") % width) == F.col("key")  # an edge is an id of the data: the smallest of its slice
    dealt = (keyed.withColumn("own", own).withColumn("slice", F.explode(F.when(first, F.array("own", guest)).otherwise(F.array("own"))))
             if last else keyed.withColumn("own", F.lit(0)).withColumn("slice", F.explode(F.when(F.col("key") == edges[0], F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0))))))
    # guests come after the slice's own documents
    guested = F.when(F.col("slice") == F.col("own"), F.lit(0)).otherwise(F.lit(1)) if last else F.when(F.col("slice") == 0, F.lit(0)).otherwise(F.lit(1))
    dealt = dealt.withColumn("guest", guested).withColumn("slice", F.greatest(F.col("slice"), F.lit(0)))
    order = Window.partitionBy("slice").orderBy("guest", "key", F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as much of the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, signature set and its text form of every document."""
    return (docs.select(F.col(f"`{id_col}`"), signatures(F.col(f"`{text}`")).alias("sigs"))
            .select(id_col, "sigs", fingerprint(F.col("sigs")).alias("fingerprint")))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of distinct fingerprints with ``likeness`` of at least ``threshold``; who has which.

    Copies share one fingerprint class (a hash of the set) and are never compared.  Length partitions are powers of
    1 / threshold, so a set meets its own partition and the next one only.  Signatures are ordered
    rarest first; two sets that reach the threshold share one of the first n - ceil(threshold * n) + 1, so a frequent
    signature joins only where a set has nothing rarer.
    """
    members = written(docs.select(F.col(f"`{id_col}`").alias(id_col), signatures(F.col(f"`{text}`")).alias("sigs"))
                      .withColumn("class", F.xxhash64("sigs")), "spots")
    classes = written(members.where(F.size("sigs") > 0).groupBy("class").agg(F.first("sigs").alias("sigs")), "spotclasses")
    flat = classes.select("class", F.explode("sigs").alias("sig"))
    counted = written(flat.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "spotcounts")
    ranked = flat.join(counted, "sig").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by"))
    n = F.size("by")
    heads = ranked.select("class", n.alias("n"), F.floor(F.log(n) / math.log(1 / threshold) + 1e-9).cast("int").alias("part"),
                          F.explode(F.slice("by", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))).alias("head")).select("class", "n", "part", F.col("head.sig").alias("sig"))
    heads = written(heads, "spotheads")
    left, right = heads.alias("a"), heads.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1))).alias("b")
    met = left.join(right, ["sig", "part"]).where("a.n >= :t * b.n AND b.n >= :t * a.n".replace(":t", repr(threshold))).where((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.class") < F.col("b.class"))))
    cand = met.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()
    full = cand.join(classes.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), "a").join(classes.select(F.col("class").alias("b"), F.col("sigs").alias("sb")), "b")
    pairs = full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)
    return pairs, members.select(id_col, "class")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class, group): documents whose fingerprints are connected by pairs of ``similar_pairs``."""
    pairs, members = similar_pairs(docs, id_col, text, threshold)
    named = written(connected_components(written(pairs.select("a", "b"), "spotlinks")), "spotgroups")
    return members.join(named.withColumnRenamed("node", "class"), "class", "left").select(id_col, "class", F.coalesce("component", "class").alias("group"))


def compared(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).first()[0])
    rows = with_next(docs, id_col, text, min(MOST_SLICES, max(8, -(-total // SLICE_BYTES))))
    made = rows.select(F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), "text", edited(F.col("text"), F.col("next_text")).alias("changed"), "next_text")
    return made.select(id_col, "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"),
                       F.array(*[signatures(F.col(c)) for c in ("text", "changed", "next_text")]).alias("s")).select(
        id_col, "n_chars", "edited_sha256", fingerprint(F.col("s")[0]).alias("fingerprint"), fingerprint(F.col("s")[1]).alias("edited_fingerprint"),
        likeness(F.col("s")[0], F.col("s")[1]).alias("near_edited"), likeness(F.col("s")[0], F.col("s")[2]).alias("near_next"))


def q_op6(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return compared(table(spark, sf_dir, "documents"))
