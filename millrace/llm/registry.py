"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from millrace.llm import alignment, exact_topk, fim, jaccard_join, learned_partitions, mixing, pieces, secrets, sharding, token_counts, toxicity, url_templates, warc


def queries() -> dict:
    found = [
        learned_partitions.op1_learned_partitions,
        pieces.op2_pieces,
        toxicity.op3_toxicity,
        secrets.op4_secrets,
        url_templates.op5_url_templates,
        mixing.op6_mixing,
        exact_topk.op7_exact_topk,
        warc.op8_warc,
        jaccard_join.op9_jaccard_join,
        sharding.op10_sharding,
        fim.op11_fill_in_middle,
        alignment.op12_token_alignment,
        token_counts.op13_token_counts,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op7_exact_topk": exact_topk.ORACLE, "op8_warc": warc.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE, "op10_sharding": sharding.ORACLE, "op11_fill_in_middle": fim.ORACLE}
