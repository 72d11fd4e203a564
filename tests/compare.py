"""Results of Spark and DuckDB as sorted rows of plain values."""


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*names).collect())


def rows_of_sql(duck, sql):
    out = duck.sql(sql)
    names = sorted(out.columns)
    at = [out.columns.index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())
