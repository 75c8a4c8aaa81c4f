"""The queries of this subpackage and their SQL."""

from . import bpe, exact_dedup, hmm, language, line_dedup, packing, pii, quality, simhash, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_hmm": hmm.op2_hmm,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_language": language.op8_language,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
}
SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
