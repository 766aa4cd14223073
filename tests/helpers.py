"""What tests share."""

SF = "/root/testdata/sf0.001"


def flat(v) -> str:
    if v is None or v != v:
        return "~"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(flat, v)) + "]"
    return str(v)


def same(df, con, sql: str) -> None:
    got = df.collect()
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    want = r.fetchall()
    at, to = [df.columns.index(c) for c in sorted(names)], [names.index(c) for c in sorted(names)]
    assert sorted("|".join(flat(x[i]) for i in at) for x in got) == sorted("|".join(flat(x[i]) for i in to) for x in want)
