"""Every registered query runs on the small tables with the columns that are fixed; those with SQL give the rows of their SQL."""

import pytest

from ledgerloom.llm import queries
from tests.compare import assert_same, connect

COLUMNS = {
    "p1_found": ["sequence_index_a", "sequence_index_b"], "p2_found": ["trial_id", "choice"], "p3_found": ["session_id"], "p5_found": ["kind", "item_a", "item_b"],
    "p6_found": ["paper_id_a", "paper_id_b"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, data, con, name):
    df = queries.QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in queries.SQL:
        assert_same(df, con, queries.SQL[name])
    rows = df.collect()
    if name in ("p1_found", "p3_found", "p5_found", "p6_found", "p9_found"):
        assert len(rows) == len({tuple(r) for r in rows})
