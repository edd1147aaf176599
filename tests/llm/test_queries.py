"""The registered queries: against SQL where there is some, else their columns and row counts."""

import __spark_entry__ as entry_module
import pytest
from compare import connect, differences

from creativeaudit.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": ["doc_id", "lang", "units", "perplexity", "threshold", "kept"],
    "op2_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op9_licence_scan": ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"],
    "op10_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"]}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns == COLUMNS[name]
    n = out.count()
    assert n == spark.read.parquet(f"{SF}/documents.parquet").count() or (name == "op9_licence_scan" and n > 0)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLE) <= set(entry_module.oracle_sql())
    assert "pipeline" in entry_module.queries() and {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
