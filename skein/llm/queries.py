"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op1_warc, op3_substrings, op4_mixing
from .op1_warc import op1_warc as _op1
from .op2_block_search import op2_block_search
from .op3_substrings import op3_substrings as _op3
from .op4_mixing import op4_mixing as _op4
from .op5_packing import op5_packing
from .op6_rules import op6_rules
from .op7_language import op7_language
from .op8_ordinal import op8_ordinal
from .op9_weighted_minhash import op9_weighted_minhash
from .op10_token_store import op10_token_store
from .op11_whitening import op11_whitening
from .op12_repair import op12_repair
from .op13_prefix_join import op13_prefix_join


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_warc": _op1,
        "op2_block_search": op2_block_search,
        "op3_substrings": _op3,
        "op4_mixing": _op4,
        "op5_packing": op5_packing,
        "op6_rules": op6_rules,
        "op7_language": op7_language,
        "op8_ordinal": op8_ordinal,
        "op9_weighted_minhash": op9_weighted_minhash,
        "op10_token_store": op10_token_store,
        "op11_whitening": op11_whitening,
        "op12_repair": op12_repair,
        "op13_prefix_join": op13_prefix_join,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": op1_warc.ORACLE_SQL, "op3_substrings": op3_substrings.ORACLE_SQL, "op4_mixing": op4_mixing.ORACLE_SQL}
