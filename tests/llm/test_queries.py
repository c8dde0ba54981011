import pytest

import __spark_entry__ as entry
from tests.llm.conftest import SF
from wordreel.llm import queries

CONTRACT = {
    "op1_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_near_duplicates": "doc_id class_id",
    "op3_quality": "doc_id held_out score predicted",
    "op4_repeated_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_spot_signatures": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint "
                           "near_edited near_next",
    "op6_max_score": "query_id rank vec_id score",
    "op7_warc_segments": "page_id payload_bytes payload_digest record_type refers_to",
    "op8_byte_pairs": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_lattice_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_language": "doc_id held_out lang_pred score",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
}
TYPES = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
         "ids_crc32": "bigint", "offset": "bigint", "held_out": "boolean", "predicted": "int",
         "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "n_chars": "bigint",
         "near_edited": "double", "near_next": "double", "query_id": "bigint", "rank": "int",
         "vec_id": "bigint", "page_id": "bigint", "payload_bytes": "bigint",
         "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
         "base_score": "double", "refers_to": "bigint", "over_limit": "boolean", "n": "bigint",
         "n_near": "bigint", "form_n": "bigint", "n_a": "bigint", "n_b": "bigint",
         "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint"}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(CONTRACT)
    assert set(CONTRACT) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(CONTRACT)


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    for column in CONTRACT[name].split():
        assert types[column] == TYPES.get(column, types[column]), column
    rows = df.count()
    if "doc_id" in types and "piece" not in types:
        assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_sql_has_it(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(
        map(str, want))
