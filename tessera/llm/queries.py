"""Registered queries of the subpackage: name -> callable(spark, sf_dir), and the SQL that checks them."""

from __future__ import annotations

from tessera.llm import fill_in_middle, html_text, jaccard_join, line_dedup, log_bilinear, packing, pii_tagger, quality_classifier, quality_rules, sharding, string_tiling, suffix_dedup, term_pipeline
from tessera.llm.common import documents, table


def op1_benchmark_decontamination(spark, sf_dir):
    return string_tiling.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_pii(spark, sf_dir):
    return pii_tagger.find(documents(spark, sf_dir))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


def op4_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, sf_dir), with_bytes=False))


def op5_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark, sf_dir):
    return log_bilinear.score(documents(spark, sf_dir))


def op7_sharding(spark, sf_dir):
    return sharding.digest(sharding.place(documents(spark, sf_dir)))


def op8_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.digest(quality_rules.apply_rules(documents(spark, sf_dir)))


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.links(documents(spark, sf_dir))


def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digest(fill_in_middle.rearrange(documents(spark, sf_dir)))


def op12_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.drop_frequent_lines(documents(spark, sf_dir)))


def op13_ranked_search(spark, sf_dir):
    return term_pipeline.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_pii, op3_best_fit_packing, op4_suffix_array_dedup, op5_quality_classifier, op6_lm_scoring, op7_sharding, op8_html_extraction, op9_quality_rules, op10_ngram_jaccard_join,
    op11_fill_in_middle, op12_line_dedup, op13_ranked_search)}
ORACLES = {"op9_quality_rules": quality_rules.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE,
           "op12_line_dedup": line_dedup.ORACLE, "op13_ranked_search": term_pipeline.ORACLE}
