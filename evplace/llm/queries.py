"""The training-data queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from evplace.llm import ann, collocations, decontaminate, lm, mixing, neardup, packing, quality, secrets, substrings, token_files, urls, whitening

QUERIES = {
    "op1_lm_scores": lm.op1_lm_scores,
    "op2_token_files": token_files.op2_token_files,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_mixture": mixing.op5_mixture,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_secrets": secrets.op9_secrets,
    "op10_url_filter": urls.op10_url_filter,
    "op11_packing": packing.op11_packing,
    "op12_collocations": collocations.op12_collocations,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op3_near_duplicates": neardup.OP3_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op5_mixture": mixing.OP5_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
