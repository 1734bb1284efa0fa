"""Rows that may have one of many keys, told apart by bits."""

from __future__ import annotations

import pytest

from docledger.functions import keybits


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_no_row_with_a_key_is_among_the_others(spark, kind):
    rows = spark.range(5_000).selectExpr(f"CAST(id AS {kind}) AS k", "id AS v").unionByName(
        spark.sql(f"SELECT CAST(NULL AS {kind}) AS k, -1L AS v"))
    keys = spark.range(0, 6_000, 7).selectExpr(f"CAST(id AS {kind}) AS k").unionByName(
        spark.sql(f"SELECT CAST(NULL AS {kind}) AS k"))
    others, near = keybits.split_by_keys(rows, "k", keys)
    assert others.columns == near.columns == ["k", "v"]
    far, close = {r.v for r in others.collect()}, {r.v for r in near.collect()}
    assert not far & close and far | close == {-1, *range(5_000)}
    assert close >= set(range(0, 5_000, 7)) and len(close) < 800
    assert {r.v for r in keybits.with_keys(rows, "k", keys).collect()} == set(range(0, 5_000, 7))


def test_full_bins_only_let_more_rows_through(spark, monkeypatch):
    monkeypatch.setattr(keybits, "_BINS", 3)
    rows, keys = spark.range(100), spark.range(0, 100, 3)
    others, near = keybits.split_by_keys(rows, "id", keys)
    assert others.count() == 0 and near.count() == 100
    assert keybits.with_keys(rows, "id", keys).count() == 34


def test_without_keys_all_rows_are_others(spark):
    others, near = keybits.split_by_keys(spark.range(10), "id", spark.range(0))
    assert others.count() == 10 and near.count() == 0
