"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from screenlens.llm import (
    conversation_repair,
    decontaminate,
    hamming_search,
    language_id,
    license_scan,
    line_dedup,
    lm_score,
    packing,
    preference,
    simhash,
    token_alignment,
    toxicity,
    url_filter,
)
from screenlens.llm.common import table


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_preference_format(spark, sf_dir):
    pairs = preference.paired(preference.swapped_answers(table(spark, sf_dir, "conversations")))
    return preference.digest(preference.formatted(pairs))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op5_hamming_search(spark, sf_dir):
    return hamming_search.search(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op8_lm_score(spark, sf_dir):
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark, sf_dir):
    return simhash.digest(simhash.simhash_dedup(table(spark, sf_dir, "documents")))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark, sf_dir):
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"))[0]


def op12_license_scan(spark, sf_dir):
    return license_scan.digest(license_scan.license_scan(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.digest(conversations, conversation_repair.repair(conversation_repair.damaged(conversations)))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_preference_format": op2_preference_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_hamming_search": op5_hamming_search,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_lm_score": op8_lm_score,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_license_scan": op12_license_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op2_preference_format": preference.SQL,
    "op5_hamming_search": hamming_search.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
}
