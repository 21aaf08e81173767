"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioloom.llm import decontaminate, line_chunks, manifest, near_vectors, reputation, spelling, units
from folioloom.llm.language import op5_language
from folioloom.llm.neighbours import op4_neighbours
from folioloom.llm.packing import op7_packing
from folioloom.llm.quality import op10_quality
from folioloom.llm.simhash import op1_simhash
from folioloom.llm.token_files import op3_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_neighbours": op4_neighbours,
    "op5_language": op5_language,
    "op6_url_reputation": reputation.op6_url_reputation,
    "op7_packing": op7_packing,
    "op8_repeated_lines": units.op8_repeated_lines,
    "op8_later_lines": units.op8_later_lines,
    "op9_line_chunks": line_chunks.op9_line_chunks,
    "op9_repeated_passages": line_chunks.op9_repeated_passages,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_near_vectors": near_vectors.op12_near_vectors,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
CHECKS: dict[str, str] = {
    "op2_decontamination": decontaminate.SQL,
    "op6_url_reputation": reputation.SQL,
    "op8_repeated_lines": units.SQL,
    "op9_line_chunks": line_chunks.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op12_near_vectors": near_vectors.SQL,
    "op13_spelling_variants": spelling.SQL,
}
