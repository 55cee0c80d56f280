"""The queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from . import chat, flac, langid, lines, mixing, neardup, packing, quality, substrings, urls
from .common import table


def op1_chat_prefix(spark, sf_dir):
    return chat.digest(chat.prefix_examples(chat.with_hostile(table(spark, sf_dir, "conversations"))))


def queries():
    return {
        "op1_chat_prefix": op1_chat_prefix,
        "op2_flac": flac.query,
        "op3_neardup": neardup.query,
        "op4_substrings": substrings.query,
        "op5_quality_rules": quality.query,
        "op6_packing": packing.query,
        "op7_mixing": mixing.query,
        "op8_lines": lines.query,
        "op9_urls": urls.query,
        "op10_langid": langid.query,
    }


def oracle_sql():
    return {"op1_chat_prefix": chat.SQL}
