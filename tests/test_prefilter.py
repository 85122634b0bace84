import pandas as pd

from siftloom.operators import bloom
from siftloom.plans import membership


def test_prefilter_rules_out_however_many_members(spark, tmp_path, monkeypatch):
    n = 4000
    pd.DataFrame({"p_partkey": range(2 * n), "p_size": [5] * n + [20] * n, "p_brand": "b"}).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame({"l_partkey": range(2 * n), "l_quantity": 1.0}).to_parquet(tmp_path / "lineitem.parquet")
    kept = []
    real = bloom.semi_join
    monkeypatch.setattr(bloom, "semi_join", lambda *a, **k: kept.append(real(*a, **k)) or kept[0])
    assert [tuple(x) for x in membership.bf_prefilter_join(spark, str(tmp_path)).collect()] == [("b", n, float(n))]
    assert n <= kept[0].count() <= n * 1.1
