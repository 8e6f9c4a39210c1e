"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from docspark.llm.chat import OP4_SQL, op4_chat_format
from docspark.llm.collocations import OP12_SQL, op12_collocations
from docspark.llm.decontaminate import op9_decontamination
from docspark.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from docspark.llm.language import op5_language_id
from docspark.llm.lm_score import OP10_SQL, op10_lm_score
from docspark.llm.mixing import OP13_SQL, op13_mixing
from docspark.llm.mtree import OP7_SQL, op7_exact_topk
from docspark.llm.quality import op3_quality
from docspark.llm.sentencepiece_codec import op1_sentencepiece
from docspark.llm.sharding import OP6_SQL, op6_sharding
from docspark.llm.simhash import op2_simhash_dedup
from docspark.llm.token_counts import op8_token_counts

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_quality": op3_quality,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_exact_topk": op7_exact_topk,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_lm_score": op10_lm_score,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_collocations": op12_collocations,
    "op13_mixing": op13_mixing,
}
SQL = {"op4_chat_format": OP4_SQL, "op6_sharding": OP6_SQL, "op7_exact_topk": OP7_SQL, "op10_lm_score": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_collocations": OP12_SQL, "op13_mixing": OP13_SQL}
