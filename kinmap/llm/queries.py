"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from kinmap.llm.decontaminate import OP3_SQL, op3_decontaminate
from kinmap.llm.language_model import OP4_SQL, op4_lm_scoring
from kinmap.llm.media import op8_media
from kinmap.llm.quality import op5_quality
from kinmap.llm.secret_scan import OP9_SQL, op9_secret_scan
from kinmap.llm.segmentation import op7_segmentation
from kinmap.llm.simhash import op1_simhash
from kinmap.llm.token_counts import op10_token_counts
from kinmap.llm.token_files import op2_token_files
from kinmap.llm.toxicity import op6_toxicity

QUERIES = {
    "op4_lm_scoring": op4_lm_scoring,
    "op7_segmentation": op7_segmentation,
    "op6_toxicity": op6_toxicity,
    "op5_quality": op5_quality,
    "op1_simhash": op1_simhash,
    "op8_media": op8_media,
    "op3_decontaminate": op3_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op2_token_files": op2_token_files,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": OP3_SQL,
    "op4_lm_scoring": OP4_SQL,
    "op9_secret_scan": OP9_SQL,
}
