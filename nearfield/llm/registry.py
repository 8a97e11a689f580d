"""The subpackage's queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op4_chat
from .decontaminate import op3_decontaminate
from .mixing import op5_mixing
from .neardup import op6_neardup
from .oracles import oracle_sql as oracle_sql
from .pii import op1_pii
from .quality import op10_quality_rules
from .secrets import op2_secrets
from .substring import op9_substring
from .suffix import op8_suffix
from .toxicity import op7_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii": op1_pii,
        "op2_secrets": op2_secrets,
        "op3_decontaminate": op3_decontaminate,
        "op4_chat": op4_chat,
        "op5_mixing": op5_mixing,
        "op6_neardup": op6_neardup,
        "op7_toxicity": op7_toxicity,
        "op8_suffix": op8_suffix,
        "op9_substring": op9_substring,
        "op10_quality_rules": op10_quality_rules,
    }
