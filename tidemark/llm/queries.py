"""Queries of this subpackage, and SQL for those that SQL can express."""

from tidemark.llm import bpe, collocations, decontaminate, filter_audit, kneser_ney, line_dedup, media, packing, preferences, simhash, toxicity, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe,
        preferences.op2_preferences,
        decontaminate.op3_decontaminate,
        media.op4_media,
        simhash.op5_simhash,
        toxicity.op6_toxicity,
        line_dedup.op7_line_dedup,
        url_filter.op8_url_filter,
        url_filter.url_rules,
        warc.op9_warc,
        kneser_ney.op10_kneser_ney,
        collocations.op11_collocations,
        packing.op12_packing,
        filter_audit.op13_filter_audit,
    )
}

ORACLE_SQL = {
    "op2_preferences": preferences.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "url_rules": url_filter.RULES_ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
