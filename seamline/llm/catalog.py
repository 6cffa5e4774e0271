"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, jaccard, langid, lines, neighbours, packing, quality, secrets, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_nearest_neighbours": neighbours.op4_nearest_neighbours,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": langid.op6_language_id,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_warc": warc.op8_warc,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_packing": packing.op10_packing,
}
SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op4_nearest_neighbours": neighbours.OP4_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
}
