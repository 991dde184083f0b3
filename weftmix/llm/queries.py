"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from weftmix.llm import collocations, decontaminate, langid, license_scan, mih, packing, quality_cnn, recurrent_lm, simhash, suffix_dedup, turn_repair, url_reputation, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_language_id": langid.query,
    "op3_quality_cnn": quality_cnn.query,
    "op4_simhash_groups": simhash.query,
    "op5_mih_topk": mih.query,
    "op6_order_packing": packing.query,
    "op7_warc_transactions": warc.query,
    "op8_license_scan": license_scan.query,
    "op9_containment": decontaminate.query,
    "op10_url_reputation": url_reputation.query,
    "op11_turn_repair": turn_repair.query,
    "op12_collocations": collocations.query,
    "op13_recurrent_lm": recurrent_lm.query,
}
ORACLE_SQL = {
    "op5_mih_topk": mih.SQL,
    "op7_warc_transactions": warc.SQL,
    "op8_license_scan": license_scan.SQL,
    "op9_containment": decontaminate.SQL,
    "op10_url_reputation": url_reputation.SQL,
    "op12_collocations": collocations.SQL,
}
