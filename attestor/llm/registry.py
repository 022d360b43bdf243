"""Queries and oracle SQL of the llm operators, for __spark_entry__.py."""

from attestor.llm import ann, chat, fertility, fim, langid, mil, mixing, packing, rnnlm, simhash, spelling, urlfilter, warc
from attestor.llm.common import prepare

OPERATORS = [
    warc.op1_warc_index, urlfilter.op2_url_filters, chat.op3_chat_format, ann.op4_learned_partitions, packing.op5_sum_of_squares_packing,
    simhash.op6_simhash_near_dedup, rnnlm.op7_recurrent_lm, langid.op8_language_id, mixing.op9_mixing, fertility.op10_fertility_rules,
    spelling.op11_spelling_variants, fim.op12_fim_scan, mil.op13_mil_quality,
]


def _with_workers(query):
    def run(spark, sf_dir):
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {f.__name__: _with_workers(f) for f in OPERATORS}


def oracle_sql():
    return {"op2_url_filters": urlfilter.OP2_SQL, "op3_chat_format": chat.OP3_SQL, "op9_mixing": mixing.OP9_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_fim_scan": fim.OP12_SQL}
