"""Compares a query with its SQL as a multiset of rows."""

from collections import Counter

import duckdb

TABLES = "documents embeddings labels"
DATA = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


def same_as_sql(df, sql, tables):
    """tables: name to pandas or Parquet path."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{t}'") if isinstance(t, str) else con.register(name, t)
    got = con.sql(sql)
    want = rows_of(got.columns, got.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(got.columns) == sorted(df.columns)
    assert have == want, list((have - want).items())[:5] + list((want - have).items())[:5]


#: Nulls, empty and repeated texts, ties, a long text, extra columns whose names clash.
def odd_rows():
    line = "the same long line that many documents hold"
    rows = [(1, "abc"), (2, "ABC"), (3, None), (4, ""), (5, line + "\n" + line.upper() + " \nx"), (6, " " + line), (7, line + "\nother"), (8, "ä" * 20), (9, "Ä" * 20), (10, "ä" * 20 + "\n\n"), (11, "ä" * 20), (12, "z" * 60_000), (13, "z" * 60_000 + "\n" + line)]
    rows += [(i, f"{line}\nrow number {i} and nothing else") for i in range(20, 60)]
    return [(i, t, None if i % 3 else "en", f"s{i % 4}" if i % 5 else None, 7, i, i, 0) for i, t in rows]


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, doc long, keep int"


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)
