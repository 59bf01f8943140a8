"""Queries of the corpus operators and their DuckDB SQL."""

from . import decontam, exact_dedup, langid, lexical, line_dedup, merkle, minmax, mixing, pfp_dedup, sharding, tokens, urlfilter, warc

QUERIES = {
    "op1_kk_sharding": sharding.op1_kk_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_line_spread": line_dedup.op3_line_spread,
    "op4_automaton_decontam": decontam.op4_automaton_decontam,
    "op5_pfp_substrings": pfp_dedup.op5_pfp_substrings,
    "op6_bayes_langid": langid.op6_bayes_langid,
    "op7_minmax_near_dedup": minmax.op7_minmax_near_dedup,
    "op8_token_frames": tokens.op8_token_frames,
    "op9_poisson_mix": mixing.op9_poisson_mix,
    "op10_link_trust": urlfilter.op10_link_trust,
    "op11_ball_tree_search": lexical.op11_ball_tree_search,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_warc_source": warc.op13_warc_source,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_line_spread": line_dedup.OP3_SQL,
    "op4_automaton_decontam": decontam.OP4_SQL,
    "op7_minmax_near_dedup": minmax.OP7_SQL,
    "op9_poisson_mix": mixing.OP9_SQL,
    "op10_link_trust": urlfilter.OP10_SQL,
    "op11_ball_tree_search": lexical.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_warc_source": warc.OP13_SQL,
}
