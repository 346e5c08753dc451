"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.decontaminate import op10_decontaminate
from brindle.llm.html_text import op8_html
from brindle.llm.line_dedup import op9_line_dedup
from brindle.llm.packing import op3_packing
from brindle.llm.pii import op2_pii
from brindle.llm.quality import op5_quality
from brindle.llm.sharding import op1_sharding
from brindle.llm.simhash import op4_simhash
from brindle.llm.substring import op6_substring
from brindle.llm.transport_stream import op7_transport_stream


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_pii": op2_pii,
        "op3_packing": op3_packing,
        "op4_simhash": op4_simhash,
        "op5_quality": op5_quality,
        "op6_substring": op6_substring,
        "op7_transport_stream": op7_transport_stream,
        "op8_html": op8_html,
        "op9_line_dedup": op9_line_dedup,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {}
