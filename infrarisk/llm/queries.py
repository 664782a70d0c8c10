"""Queries of this subpackage and the SQL that equals them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, licences, minhash, mixing, pages, pieces, pii, prefixes, quality, spotsigs, stripes, substrings, tokens
from .common import ready

_QUERIES = {
    "op1_pii": pii.q_op1,
    "op2_minhash": minhash.q_op2,
    "op3_html": pages.q_op3,
    "op4_sentencepiece": pieces.q_op4,
    "op5_quality": quality.q_op5,
    "op6_spotsigs": spotsigs.q_op6,
    "op7_tokens": tokens.q_op7,
    "op8_substrings": substrings.q_op8,
    "op9_mixing": mixing.q_op9,
    "op10_chat": chat.q_op10,
    "op11_prefixes": prefixes.q_op11,
    "op12_collocations": stripes.q_op12,
    "op13_licences": licences.q_op13,
}


def _registered(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(ready(spark), sf_dir)


REGISTRY = {name: _registered(q) for name, q in _QUERIES.items()}

ORACLE: dict[str, str] = {
    "op2_minhash": minhash.SQL,
    "op8_substrings": substrings.SQL,
    "op10_chat": chat.SQL,
    "op11_prefixes": prefixes.SQL,
    "op12_collocations": stripes.SQL,
}
