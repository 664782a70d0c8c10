"""Chat formatting by event-sourced reconstruction (operator 10).

A log holds events of conversations: ``open`` starts (or restarts) a message with a role, ``delta`` appends text
to it, ``edit`` replaces its text, ``regenerate`` drops its text and begins anew.  An edit or regeneration also
discards the later messages that were opened before it.  ``fold`` sorts each conversation's events by
sequence and folds them into final messages; ``render`` writes them in a template and marks the text that
training learns from; ``read_back`` parses the template again.

Template of one turn: ``<s>[INST]role[/INST]text</s>``.  Control strings inside roles and texts get a backslash after
their first character (one more if backslashes stand there already), so escaping is reversible and the
only bare control strings are the template's own.

Scale: events are first folded by message (a long message is one group), then only final messages meet by
conversation.  A conversation's rendered text is one value by contract, so its turns meet in one row; everything
else about it (offsets, truncation) runs over narrow window rows that spill.  DataFrame functions only.

Defined cases: null texts and payloads are empty, null roles are the empty role; rows with a null turn come last;
rows that share conversation and turn follow each other by role, then text; a null conversation id is one
conversation.  A log without an ``open`` for a message gives it the empty role.  Empty tables give empty results.
Further columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, table

CHUNK = 256  # code points of a streamed delta
HEAD, MID, END = "<s>[INST]", "[/INST]", "</s>"
_BARE = r"(<|\[)(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"(<|\[)\\(\\*)(/?(?:s>|INST\]))"
ASSISTANT = "assistant"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, _BARE, r"$1$2\\$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, r"$1$2$3")


def as_log(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the event log that streaming them would have left."""
    turn = F.coalesce(F.col("turn"), F.lit(LAST_ID))
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    said = rows.select("conv_id", F.struct(turn.alias("turn"), tie.alias("tie")).alias("message"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"greatest(length(text) - 1, 0) div {chunk}")),
                        lambda i: F.substring(F.col("text"), (i * chunk + 1).cast("int"), F.lit(chunk)))
    events = said.select("conv_id", "message", "role", F.posexplode(F.concat(F.array(F.lit("")), parts)).alias("step", "payload"))
    return events.select("conv_id", F.struct("message.turn", "message.tie", "step").alias("seq"), "message",
                         F.when(F.col("step") == 0, F.lit("open")).otherwise(F.lit("delta")).alias("kind"), "role", "payload")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that stand at the end of each conversation's log."""
    kind, seq = F.col("kind"), F.col("seq")
    folded = log.groupBy("conv_id", "message").agg(
        F.max(F.when(kind == "open", seq)).alias("opened"),
        F.max(F.when(kind.isin("open", "edit", "regenerate"), seq)).alias("reset"),
        F.max(F.when(kind.isin("edit", "regenerate"), seq)).alias("cut"),
        F.min(seq).alias("began"),
        F.max_by("role", F.when(kind == "open", seq)).alias("role"),
        F.sort_array(F.collect_list(F.struct(seq.alias("seq"), F.coalesce("payload", F.lit("")).alias("payload")))).alias("events"))
    live = F.filter("events", lambda e: F.col("reset").isNull() | (e.getField("seq") >= F.col("reset")))
    text = F.array_join(F.transform(live, lambda e: e.getField("payload")), "")
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    told = folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.coalesce("opened", "began").alias("opened"),
                         F.max("cut").over(earlier).alias("cut"))
    return told.where(F.col("cut").isNull() | (F.col("opened") > F.col("cut"))).select("conv_id", "message", "role", "text")


def render(messages: DataFrame, learn: str = ASSISTANT) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation; spans are [start, end) code points of escaped text."""
    m = messages.withColumns({"r": escaped(F.col("role")), "t": escaped(F.col("text"))}).withColumn("piece", F.concat(F.lit(HEAD), "r", F.lit(MID), "t", F.lit(END)))
    so_far = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece").cast("long")).over(so_far) - len(END)
    span = F.when(F.col("role") == learn, F.struct((end - F.length("t")).alias("start"), end.alias("end")))
    turns = m.select("conv_id", "message", "piece", span.alias("span")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message", "piece", "span"))).alias("turns"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t.getField("piece")), "").alias("formatted"),
                        F.filter(F.transform("turns", lambda t: t.getField("span")), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, both parsed from ``formatted`` and ``loss_spans`` and unescaped."""
    whole = r"(?s)^<s>\[INST\](.*?)\[/INST\](.*)$"
    parts = F.filter(F.split("formatted", END), lambda p: F.length(p) > 0)
    turn = lambda p: F.struct(unescaped(F.regexp_extract(p, whole, 1)).alias("role"), unescaped(F.regexp_extract(p, whole, 2)).alias("text"))
    inside = lambda s: unescaped(F.substring(F.col("formatted"), (s.getField("start") + 1).cast("int"), (s.getField("end") - s.getField("start")).cast("int")))
    return rendered.withColumn("turns", F.transform(parts, turn)).withColumn("loss_texts", F.transform("loss_spans", inside))


def q_op10(spark, sf_dir: str) -> DataFrame:
    """Every conversation (and the planted one, -7) through log, fold, template and back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    back = read_back(render(fold(as_log(rows.unionByName(planted)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


#: The same straight from the turns.
SQL = r"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '(<|\[)(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') AS r, regexp_replace(text, '(<|\[)(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g') AS t FROM given),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
             sum(length(r) + length(t) + 20) AS chars
      FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
