"""Queries and SQL of the training-data operators.

The operators' modules are imported here, so a package that they need and that is missing shows when this module is imported.
"""

from __future__ import annotations

from quarry.llm import chat, dedup, katz, minhash, mixing, packing, quality, substrings, urls, warc

QUERIES = {
    "op1_warc": (warc.op1_warc, warc.SQL),
    "op2_quality_rules": (quality.op2_quality_rules, None),
    "op3_mixing": (mixing.op3_mixing, mixing.SQL),
    "op4_exact_dedup": (dedup.op4_exact_dedup, dedup.SQL),
    "op5_chat_format": (chat.op5_chat_format, chat.SQL),
    "op6_url_filter": (urls.op6_url_filter, urls.SQL),
    "op7_minhash": (minhash.op7_minhash, minhash.SQL),
    "op8_substrings": (substrings.op8_substrings, substrings.SQL),
    "op9_packing": (packing.op9_packing, None),
    "op10_katz": (katz.op10_katz, katz.SQL),
    # Parts of operators that SQL can express by themselves.
    "quality_base": (quality.quality_base, quality.BASE_SQL),
    "link_spread": (urls.link_spread, urls.LINK_SQL),
}


def queries():
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
