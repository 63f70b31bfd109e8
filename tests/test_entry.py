import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
NAMES = ["dedup_language_stats", "near_pairs_jaccard", "benchmark_contamination", "split_overlap_matrix", "sft_mask", "generated_tasks_grid", "normalised_records", "validated_records", "sft_record_errors", "similarity_histogram", "packed_stream", "events_sessions", "family_split_ranges", "sale_quantiles", "gated_documents", "numbered_lines", "packed_sink", "stream_click_purchases", "training_progress", "document_margins"]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
