"""Queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit
from .alignment import op13_alignment
from .decontaminate import op1_decontaminate
from .html_text import op9_html
from .language import op3_language
from .licenses import op2_licenses
from .media_gif import op5_media
from .ngrams import ORDER, op6_ngrams
from .packing import op10_packing
from .pii import op12_pii
from .secrets import op8_secrets
from .simhash import op4_simhash
from .toxicity import op7_toxicity


def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_ngrams(spark, sf_dir, ORDER)


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_licenses": op2_licenses, "op3_language": op3_language, "op4_simhash": op4_simhash, "op5_media": op5_media, "op6_ngrams": trigrams, "op7_toxicity": op7_toxicity, "op8_secrets": op8_secrets, "op9_html": op9_html, "op10_packing": op10_packing, "op11_filter_audit": filter_audit.op11_filter_audit, "op12_pii": op12_pii, "op13_alignment": op13_alignment}
ORACLE_SQL: dict[str, str] = {"op11_filter_audit": filter_audit.ORACLE_SQL}
