"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestone.llm.byte_bpe import op11_perfect_hash_bytes
from lodestone.llm.chat_format import OP9_SQL, op9_schema_fingerprint_chat
from lodestone.llm.context_mixing import op2_context_mixing
from lodestone.llm.filter_audit import OP13_SQL, op13_filter_interaction
from lodestone.llm.media_chunks import op7_chunked_media
from lodestone.llm.packing import op5_sum_of_squares_packing
from lodestone.llm.personal_data import op4_disclosure_spans
from lodestone.llm.piece_bpe import op6_backtracking_pieces
from lodestone.llm.quality import OP8_SQL, op8_quality_cascade
from lodestone.llm.simhash import op10_simhash_multi_index
from lodestone.llm.spelling_variants import OP12_SQL, op12_trie_pair_variants
from lodestone.llm.token_counts import op3_token_counts
from lodestone.llm.toxicity import op1_noisy_channel_toxicity

QUERIES = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_context_mixing": op2_context_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_disclosure_spans": op4_disclosure_spans,
    "op5_sum_of_squares_packing": op5_sum_of_squares_packing,
    "op6_backtracking_pieces": op6_backtracking_pieces,
    "op7_chunked_media": op7_chunked_media,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_schema_fingerprint_chat": op9_schema_fingerprint_chat,
    "op10_simhash_multi_index": op10_simhash_multi_index,
    "op11_perfect_hash_bytes": op11_perfect_hash_bytes,
    "op12_trie_pair_variants": op12_trie_pair_variants,
    "op13_filter_interaction": op13_filter_interaction,
}
ORACLE_SQL: dict[str, str] = {
    "op8_quality_cascade": OP8_SQL,
    "op9_schema_fingerprint_chat": OP9_SQL,
    "op12_trie_pair_variants": OP12_SQL,
    "op13_filter_interaction": OP13_SQL,
}
