"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, html_text, line_dedup, mixing, pii, pitman_yor, quality_net, quality_rules, ranked_search, simhash, sketch, url_filter, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality_net.op4_quality,
    "op5_mixing": mixing.op5_mixing,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_pitman_yor": pitman_yor.op8_pitman_yor,
    "op9_html_text": html_text.op9_html_text,
    "op10_fingerprints": sketch.op10_fingerprints,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}
ORACLE_SQL = {
    "op2_url_filters": url_filter.OP2_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
