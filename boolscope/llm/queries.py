"""Registry of the corpus operators' queries."""

from __future__ import annotations

from . import decontaminate, language_crf, line_dedup, merkle, packing, piece_encoding, quality_rules, simhash, suffix_dedup, toxicity, url_rules, warc

QUERIES = {
    "op1_url_rules": url_rules.query,
    "op2_warc": warc.query,
    "op3_toxicity": toxicity.query,
    "op4_decontaminate": decontaminate.query,
    "op5_language_crf": language_crf.query,
    "op6_line_dedup": line_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_simhash": simhash.query,
    "op9_packing": packing.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_merkle": merkle.query,
    "op12_piece_encoding": piece_encoding.query,
}

ORACLES = {
    "op2_warc": warc.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op11_merkle": merkle.ORACLE,
}
