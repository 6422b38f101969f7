"""The queries of this subpackage's operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from conjunx.llm.decontaminate import OP5_SQL, op5_decontaminate
from conjunx.llm.html_text import op8_text
from conjunx.llm.language_id import op1_language
from conjunx.llm.mixing import op7_mix
from conjunx.llm.pii import op3_pii
from conjunx.llm.simhash import op6_simhash
from conjunx.llm.spotsigs import op9_fingerprint, spotsigs_classes
from conjunx.llm.token_count import op2_tokens
from conjunx.llm.toxicity import op4_toxicity
from conjunx.llm.url_filter import op10_urls

QUERIES = {
    "op1_language": op1_language,
    "op2_tokens": op2_tokens,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_mix": op7_mix,
    "op8_text": op8_text,
    "op9_fingerprint": op9_fingerprint,
    "op10_urls": op10_urls,
    "spotsigs_classes": spotsigs_classes,  # the joining half of operator 9
}

SQL = {"op5_decontaminate": OP5_SQL}
