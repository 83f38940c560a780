"""Every query with an oracle over sf0.001, against DuckDB on the same files."""

import glob
import json
import os

import duckdb
import pytest

from termscan import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.sql(catalogue.oracles()[name])
    assert sorted(expected.columns) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted(map(tuple, expected.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_hit_details_shape(spark):
    for r in catalogue._details(spark, "/root/testdata/sf0.01").collect():
        for part, found in json.loads(r.hit_details).items():
            assert part.startswith("attachment-") and found["matches"] and all(list(m) == ["term_id", "match_text", "start_index", "end_index", "delta"] for m in found["matches"])


@pytest.mark.parametrize("name", ["part_scan", "wanted_messages", "featured_messages", "hit_details", "matched_states", "control_offsets"])
def test_not_empty(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).columns == ["doc_id"]
