"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .html_text import OP13_SQL, op13_html_text
from .line_dedup import op7_line_dedup
from .minhash import op8_minhash
from .lm import op1_lm
from .mixing import op2_mixing
from .pii import op9_pii
from .quality import op10_quality
from .runs import OP11_SQL, op11_periodic_runs
from .simhash import op3_simhash
from .toxicity import op4_toxicity
from .trie import OP12_SQL, op12_prefix_trie
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_lm": op1_lm,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash": op8_minhash,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_html_text": op13_html_text,
}

ORACLE_SQL: dict[str, str] = {"op5_url_filter": OP5_SQL, "op11_periodic_runs": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_html_text": OP13_SQL}
