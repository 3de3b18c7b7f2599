"""Registered queries of this subpackage and, where SQL can say the same, their DuckDB form.

The query ``pipeline`` is ``corpus_pipeline.run``, which the entry adds beside these: nothing here needs the root script.
"""

from __future__ import annotations

from cuelake.llm.bpe import op4_bpe
from cuelake.llm.embedding_dedup import op8_embedding_dedup
from cuelake.llm.fingerprint import op5_fingerprints
from cuelake.llm.language_id import op6_language_id
from cuelake.llm.line_dedup import op1_line_dedup
from cuelake.llm.packing import op7_packing
from cuelake.llm.quality import op10_quality
from cuelake.llm.simhash import op3_simhash_dedup
from cuelake.llm.substring_dedup import op2_substring_dedup
from cuelake.llm.url_filter import ORACLE as URL_FILTER_SQL
from cuelake.llm.url_filter import op9_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_bpe": op4_bpe,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {
    "op9_url_filter": URL_FILTER_SQL,
}
