"""Comparison of a query's rows with those of its SQL twin."""


def same_as_sql(duck, df, sql, digits=9):
    def value(x):
        return round(x, digits) if isinstance(x, float) else x

    cols = sorted(df.columns)
    rel = duck.sql(sql)
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(value(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want
