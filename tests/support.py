"""Helpers of the tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def plain(value):
    """One spelling for a value of either engine."""
    import datetime
    import decimal

    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return int(value) if float(value).is_integer() else round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def same(df, con, sql: str) -> None:
    """Equal columns and equal multisets of rows."""
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
