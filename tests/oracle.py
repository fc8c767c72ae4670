"""DuckDB beside Spark, on the same tables."""

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or x != x:
        return None
    return round(x, 9) if isinstance(x, float) else x if isinstance(x, str) else int(x)


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    theirs = Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
    ours = Counter(tuple(_plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    assert ours == theirs
