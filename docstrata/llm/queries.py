"""The queries of this package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstrata.llm.ann import op9_ann
from docstrata.llm.bpe import op4_bpe
from docstrata.llm.collocations import OP13_SQL, op13_collocations
from docstrata.llm.kd_shards import op3_kd_shards
from docstrata.llm.licenses import op1_licenses, scan_sql
from docstrata.llm.minhash import OP2_SQL, op2_minhash
from docstrata.llm.packing import op7_packing
from docstrata.llm.quality import op5_quality
from docstrata.llm.secrets import op10_secrets
from docstrata.llm.token_alignment import op11_alignment
from docstrata.llm.topk import OP6_SQL, op6_topk
from docstrata.llm.url_filter import OP8_SQL, op8_url_filter
from docstrata.llm.vector_dedup import OP12_SQL, op12_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_minhash": op2_minhash,
    "op3_kd_shards": op3_kd_shards,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_ann": op9_ann,
    "op10_secrets": op10_secrets,
    "op11_alignment": op11_alignment,
    "op12_vector_dedup": op12_vector_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_licenses": scan_sql(),
    "op2_minhash": OP2_SQL,
    "op6_topk": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op12_vector_dedup": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
