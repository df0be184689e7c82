"""The registered queries of this folder and the SQL of those that SQL can express."""

from quarryloom.llm import bpe, clusters, decontaminate, html_text, license_scan, near_dedup, quality, spelling, suffix_dedup, toxicity, url_rules, warc, word_bpe

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_warc": warc.op5_warc,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_html_text": html_text.op9_html_text,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_centroid_clusters": clusters.op12_centroid_clusters,
    "op13_word_bpe": word_bpe.op13_word_bpe,
}
ORACLE = {
    "op1_quality": quality.ORACLE,
    "op3_url_rules": url_rules.ORACLE,
    "op5_warc": warc.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_centroid_clusters": clusters.ORACLE,
}
