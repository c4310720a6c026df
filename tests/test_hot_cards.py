"""Cards worked out in ranges of time equal those worked out by windows."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as X
from ledgerlens.operators import hot_cards
from ledgerlens.sources import tables as S


def test_half_of_all_rows_on_one_card(spark):
    rows = S.transactions(spark, "/root/testdata/sf0.001").withColumn("cc_num", F.when(F.col("trans_num") % 2 == 0, 1).otherwise(F.col("cc_num") % 20 + 2).cast("long"))
    rows = rows.withColumn("merchant", F.when(F.col("trans_num") % 11 == 0, None).otherwise(F.col("merchant"))).withColumn("amt", F.when(F.col("trans_num") % 13 > 0, F.col("amt")))
    rows = rows.withColumn("trans_date_trans_time", F.date_trunc("hour", "trans_date_trans_time").cast("timestamp_ntz"))  # ties, and many rows a day
    clean = rows.withColumn("amt", X.clean(F.col("amt").cast("double")))
    want = {r.trans_num: r.asDict() for r in X.by_card(clean).collect()}
    got = hot_cards.by_card_in_ranges(clean, hot_rows=100, range_rows=60)
    assert sorted(got.columns) == sorted(next(iter(want.values())))
    found = {r.trans_num: r.asDict() for r in got.collect()}
    assert len(found) == len(want) == 1000 and sum(r["cc_num"] == 1 for r in found.values()) == 500
    for k, r in want.items():
        for c, v in r.items():
            assert found[k][c] == (pytest.approx(v, rel=1e-12) if c == "daily_amount_sum" and v is not None else v), (k, c)
    assert X.engineered(rows, hot_rows=100).count() == X.engineered(rows, hot_rows=10**6).count() == 1000
