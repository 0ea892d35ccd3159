"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm.decontaminate import OP4_SQL, op4_decontaminate
from labelloom.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from labelloom.llm.html_text import op9_html_text
from labelloom.llm.licenses import op8_license_scan, oracle_sql
from labelloom.llm.line_dedup import op5_line_dedup
from labelloom.llm.media import op1_media_columns
from labelloom.llm.mixing import OP7_SQL, op7_mixing
from labelloom.llm.quality import op3_quality
from labelloom.llm.simhash import op6_simhash
from labelloom.llm.substrings import op11_substring_dedup
from labelloom.llm.token_alignment import op13_token_alignment
from labelloom.llm.token_counts import op2_token_counts
from labelloom.llm.token_output import op10_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_html_text": op9_html_text,
    "op10_token_output": op10_token_output,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op8_license_scan": oracle_sql(),
    "op12_hard_negatives": OP12_SQL,
}
