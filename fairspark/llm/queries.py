"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import cotrain, decontam, host_rules, katz, lines, minhash, mixing, secrets, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_host_rules": host_rules.op2_host_rules,
    "op3_near_duplicates": minhash.op3_near_duplicates,
    "op4_redirect_filter": url_filter.op4_redirect_filter,
    "op5_secrets": secrets.op5_secrets,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_katz_scores": katz.op7_katz_scores,
    "op8_mix": mixing.op8_mix,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_cotrained_quality": cotrain.op10_cotrained_quality,
}
ORACLE_SQL = {
    "op2_host_rules": host_rules.OP2_SQL,
    "op3_near_duplicates": minhash.OP3_SQL,
    "op4_redirect_filter": url_filter.OP4_SQL,
    "op5_secrets": secrets.OP5_SQL,
    "op6_decontaminate": decontam.OP6_SQL,
    "op8_mix": mixing.OP8_SQL,
    "op9_line_dedup": lines.OP9_SQL,
}
