"""Operators of a training-data pipeline; nothing else in the package imports them."""

from __future__ import annotations


def queries() -> dict:
    from . import bpe, chat, linededup, mixing, packing, quality, simhash, urls, warc, winnow

    found = [mixing.op1_mixing, winnow.op2_winnowing, simhash.op3_simhash, bpe.op4_byte_bpe, warc.op5_warc, quality.op6_quality_rules, packing.op7_token_packing, chat.op8_chat_format, linededup.op9_line_dedup, urls.op10_url_filters]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import chat, linededup, quality, warc

    return {"op5_warc": warc.OP5_SQL, "op6_quality_rules": quality.OP6_SQL, "op8_chat_format": chat.OP8_SQL, "op9_line_dedup": linededup.OP9_SQL}
