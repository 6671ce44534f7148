"""The registered query of each corpus operator, and its SQL where SQL can state it."""

from __future__ import annotations

from tracelake.llm import eliasfano, licences, linededup, mixing, neighbours, packing, quality, simhash, toxicity, urls

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1,
    "op2_licence_scan": licences.op2,
    "op3_mixing": mixing.op3,
    "op4_nearest_neighbours": neighbours.op4,
    "op5_line_dedup": linededup.op5,
    "op6_quality_rules": quality.op6,
    "op7_packing": packing.op7,
    "op8_token_files": eliasfano.op8,
    "op9_toxicity": toxicity.op9,
    "op10_url_filter": urls.op10,
}
SQL = {
    "op3_mixing": mixing.OP3_SQL,
    "op4_nearest_neighbours": neighbours.OP4_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op10_url_filter": urls.OP10_SQL,
}
