"""The queries of this package by name, and their SQL."""

from __future__ import annotations

from .bpe import op1_bpe
from .exact import OP3_SQL, op3_exact
from .licenses import OP11_SQL, op11_licenses
from .lines import OP5_SQL, op5_lines
from .near import op6_near
from .negatives import OP13_SQL, op13_negatives
from .packing import op7_pack
from .ppm import op4_ppm
from .prefixes import OP12_SQL, op12_prefixes
from .suffixes import op9_repeats
from .toxicity import op10_toxicity
from .urls import op8_urls
from .vectors import op2_embeddings

QUERIES = {"op1_bpe": op1_bpe, "op2_embeddings": op2_embeddings, "op3_exact": op3_exact, "op4_ppm": op4_ppm, "op5_lines": op5_lines, "op6_near": op6_near, "op7_pack": op7_pack, "op8_urls": op8_urls, "op9_repeats": op9_repeats, "op10_toxicity": op10_toxicity, "op11_licenses": op11_licenses, "op12_prefixes": op12_prefixes, "op13_negatives": op13_negatives}
ORACLES = {"op3_exact": OP3_SQL, "op5_lines": OP5_SQL, "op11_licenses": OP11_SQL, "op12_prefixes": OP12_SQL, "op13_negatives": OP13_SQL}
