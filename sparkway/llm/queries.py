"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .codes import OP13_SQL, op13_codes
from .decontaminate import op8_decontaminate
from .langid import op2_language
from .lexical import OP12_SQL, op12_lexical
from .licenses import op9_licenses
from .lm import op5_lm
from .mixing import op11_mixing
from .pii import op10_pii
from .sharding import op1_sharding
from .simhash import op7_simhash
from .substrings import op3_substrings
from .topk import OP6_SQL, op6_topk

QUERIES = (op1_sharding, op2_language, op3_substrings, op4_bpe, op5_lm, op6_topk, op7_simhash, op8_decontaminate, op9_licenses, op10_pii, op11_mixing, op12_lexical, op13_codes)
SQL = {"op6_topk": OP6_SQL, "op12_lexical": OP12_SQL, "op13_codes": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
