"""The registered queries: columns and types as the contracts word them, one row for each document, which rows are held out."""

import zlib

import pytest

import __spark_entry__ as entry
from terrasift.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_sentencepiece": "doc_id bigint, n_parts bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean, v_pieces bigint, v_score double",
    "op10_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint, copies int",
}
HELD = {"op1_toxicity": (5, 0), "op4_quality": (3, 1), "op5_language": (5, 0)}


@pytest.mark.parametrize("name", COLUMNS)
def test_one_row_for_each_document(spark, name):
    got = entry.queries()[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema) == COLUMNS[name]
    rows, ids = got.collect(), [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name in HELD:
        by, held = HELD[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == held) and 0 <= r.score <= 1 for r in rows)
        if "predicted" in got.columns:
            assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_pairs_and_neighbours(spark):
    pairs = queries.op2_preference_format(spark, SF)
    assert pairs.columns == ["conv_id", "status", "prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask"]
    found = queries.op7_vector_top_k(spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) == "query_id bigint, rank int, vec_id bigint, score bigint"
    assert {r.query_id % 50 for r in found.collect()} == {0}


def test_all_are_registered():
    assert {k for k in entry.queries() if k.startswith("op") and k[2].isdigit()} == set(queries.queries()) and "pipeline" in entry.queries()
