"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_bpe
from .divergence import OP13_SQL, op13_divergence
from .fingerprint import op8_fingerprint
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language import op3_language
from .license_scan import op10_license
from .mix import op6_mix
from .near_dup import OP4_SQL, op4_near_dup
from .simhash import op12_simhash
from .top_k import OP9_SQL, op9_top_k
from .toxicity import op7_toxicity
from .url_filter import op1_url_filter
from .warc import OP5_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language": op3_language,
    "op4_near_dup": op4_near_dup,
    "op5_warc": op5_warc,
    "op6_mix": op6_mix,
    "op7_toxicity": op7_toxicity,
    "op8_fingerprint": op8_fingerprint,
    "op9_top_k": op9_top_k,
    "op10_license": op10_license,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash": op12_simhash,
    "op13_divergence": op13_divergence,
}
SQL: dict[str, str] = {
    "op4_near_dup": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op9_top_k": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_divergence": OP13_SQL,
}
