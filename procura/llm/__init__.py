"""Operators for training-data corpora; nothing outside this package imports it."""

from procura.llm import classifier, decontam, licenses, line_dedup, mixing, quality_rules, secrets, simhash, substring, warc

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_secrets": secrets.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_licenses": licenses.op6_licenses,
    "op7_simhash": simhash.op7_simhash,
    "op8_substring": substring.op8_substring,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_classifier": classifier.op10_quality_classifier,
}
ORACLES = {"op3_quality_rules": quality_rules.OP3_SQL, "op9_mixing": mixing.OP9_SQL}
