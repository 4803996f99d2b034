"""The training-data queries and their SQL, for the driver contract."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontamination
from .divergence import OP12_SQL, op12_level_products
from .gnat import OP11_SQL, op11_gnat_codes
from .html_text import op7_html_layout
from .mixing import op1_pareto_mixing
from .mtree import OP10_SQL, op10_mtree_topk
from .personal import op13_weak_labels
from .quality import op6_quality
from .secrets import op4_secrets
from .simhash import op3_simhash
from .tokens import op2_simple8b_tokens
from .toxicity import op5_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_pareto_mixing, op2_simple8b_tokens, op3_simhash, op4_secrets, op5_toxicity, op6_quality, op7_html_layout, op8_decontamination, op9_warc, op10_mtree_topk, op11_gnat_codes, op12_level_products, op13_weak_labels)}
ORACLE_SQL = {"op8_decontamination": OP8_SQL, "op9_warc": OP9_SQL, "op10_mtree_topk": OP10_SQL, "op11_gnat_codes": OP11_SQL, "op12_level_products": OP12_SQL}
