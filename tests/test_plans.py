"""Every query against its SQL over the same tables; queries without SQL only run."""

import pytest

from corpusloom import plans


def rows(df, cols):
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    return sorted(map(repr, ([plain(v) for v in r] for r in df[cols].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    sql = plans.ORACLES.get(name)
    if sql is None:
        assert list(got.columns)
        return
    want = duck.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    as_float = [c for c in cols if "float" in (str(got[c].dtype), str(want[c].dtype).lower()[:5])]
    for c in as_float:
        got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert rows(got.astype({c: "float64" for c in cols if got[c].dtype.kind in "if" and want[c].dtype.kind in "if"}), cols) == rows(want.astype({c: "float64" for c in cols if got[c].dtype.kind in "if" and want[c].dtype.kind in "if"}), cols)
