"""Spark rows against DuckDB rows, whatever their order."""


def same_rows(df, duck, sql):
    want = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    text = lambda f: sorted(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).astype(str).values.tolist()))
    assert text(df.toPandas()) == text(want.df())
