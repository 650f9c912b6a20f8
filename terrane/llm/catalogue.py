"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from terrane.llm.bpe import op6_bpe
from terrane.llm.chat_format import op4_chat_format
from terrane.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from terrane.llm.html_extract import op1_html_extract
from terrane.llm.media_chunks import op3_media_chunks
from terrane.llm.mixing import op7_mix_sources
from terrane.llm.ngram_join import op9_ngram_jaccard
from terrane.llm.quality_cotrain import op5_quality_cotrain
from terrane.llm.warc_index import OP2_SQL, op2_warc_index
from terrane.llm.word_model import op8_word_model

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_warc_index": op2_warc_index,
    "op3_media_chunks": op3_media_chunks,
    "op4_chat_format": op4_chat_format,
    "op5_quality_cotrain": op5_quality_cotrain,
    "op6_bpe": op6_bpe,
    "op7_mix_sources": op7_mix_sources,
    "op8_word_model": op8_word_model,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLES = {"op2_warc_index": OP2_SQL, "op10_exact_dedup": OP10_SQL}
