"""The queries of this subpackage, and their SQL where there is any."""

from . import chat, containment, crossparse, linededup, pfair, quality, sanitize, simhash, toxicity, warc

QUERIES = {
    "op1_warc_chunks": warc.op1_warc_chunks,
    "op2_toxic_segments": toxicity.op2_toxic_segments,
    "op3_simhash_groups": simhash.op3_simhash_groups,
    "op4_cross_parsing": crossparse.op4_cross_parsing,
    "op5_chat_spans": chat.op5_chat_spans,
    "op6_pfair_mix": pfair.op6_pfair_mix,
    "op7_sanitise": sanitize.op7_sanitise,
    "op8_benchmark_leaks": containment.op8_benchmark_leaks,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_bitmaps": linededup.op10_line_bitmaps,
}

SQL = {
    "op1_warc_chunks": warc.SQL,
    "op8_benchmark_leaks": containment.SQL,
    "op9_quality_rules": quality.SQL,
    "op10_line_bitmaps": linededup.SQL,
}
