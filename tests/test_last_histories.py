"""Queries that score a session's end gather its last rows only."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from seqdrift import catalog
from seqdrift.operators import factors, sessions as S  # factors binds its own history_windows when first imported
from seqdrift.sources import adapters as A


def test_last_histories_equal_the_whole_ones(spark):
    rows = A.click_rows(spark, SF001, with_size=True)
    whole = S.history_windows(S.session_rows(A.clicks(spark, SF001), with_size=True), 3, carry=("session_len",))
    want = whole.filter(F.col("row_num") == F.col("session_len"))
    got = catalog._last_histories(rows, 3)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["recommend_history_bounded", "inner_product_topk"])
def test_queries_gather_last_rows_only(spark, monkeypatch, name):
    seen, plain = [], S.history_windows
    assert factors.history_windows is plain

    def watched(rows, length, **kw):
        seen.append(rows.groupBy("user_session").count().agg(F.max("count")).first()[0])
        return plain(rows, length, **kw)

    monkeypatch.setattr(S, "history_windows", watched)
    catalog.QUERIES[name](spark, SF001)
    assert seen and max(seen) <= 10
