"""Registered queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from textlens.llm.bpe import op8_byte_bpe
from textlens.llm.fill_middle import ORACLE as FILL_MIDDLE
from textlens.llm.fill_middle import op12_fill_in_middle
from textlens.llm.jaccard_join import op5_jaccard_join
from textlens.llm.language import op7_language_id
from textlens.llm.mixing import op4_source_mixing
from textlens.llm.quality import op1_quality_classifier
from textlens.llm.rules import op9_quality_rules
from textlens.llm.secrets import op3_secret_scans
from textlens.llm.sharding import op2_sharding
from textlens.llm.suffix_lm import op10_lm_scoring
from textlens.llm.toxicity import op13_toxicity
from textlens.llm.vector_dedup import op6_embedding_dedup
from textlens.llm.whitening import op11_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_quality_classifier,
    op2_sharding,
    op3_secret_scans,
    op4_source_mixing,
    op5_jaccard_join,
    op6_embedding_dedup,
    op7_language_id,
    op8_byte_bpe,
    op9_quality_rules,
    op10_lm_scoring,
    op11_embedding_whitening,
    op12_fill_in_middle,
    op13_toxicity,
)}

ORACLES: dict[str, str] = {"op12_fill_in_middle": FILL_MIDDLE}
