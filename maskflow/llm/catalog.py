"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from ..session import ship
from . import chat, decontam, embeddings, importance, lm, phrases, secrets, sharding, simhash, suffixes, tokens, toxicity

_ALL = (chat.op1_chat_format, simhash.op2_simhash, decontam.op3_decontaminate, tokens.op4_best_fit_pack, embeddings.op5_embedding_dedup, toxicity.op6_toxicity, lm.op7_lm_score, suffixes.op8_suffix_dedup, secrets.op9_secret_scan, tokens.op10_token_ids, sharding.op11_hilbert_shards, importance.op12_importance_resampling, phrases.op13_collocations)


def _shipped(query):
    return lambda spark, sf_dir: query(ship(spark), sf_dir)


QUERIES = {q.__name__: _shipped(q) for q in _ALL}
SQL = {"op1_chat_format": chat.OP1_SQL, "op3_decontaminate": decontam.OP3_SQL, "op7_lm_score": lm.OP7_SQL, "op11_hilbert_shards": sharding.OP11_SQL, "op12_importance_resampling": importance.OP12_SQL, "op13_collocations": phrases.OP13_SQL}
