"""Rows that try the operators: nulls, empty and very long texts, ties, repeats, clashing columns."""

import itertools

WORDS = "the of and tion inge her ouda ment café straße año été zu ver".split()


def text(seed: int, n: int) -> str:
    """n pseudo-random words, the same for the same seed."""
    out, x = [], seed * 2654435761 % 2**32 or 1
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[x >> 20 & 7] + WORDS[x >> 12 & 7] + WORDS[8 + (x >> 24) % 6] * (x >> 30 & 1) + ".," [x >> 8 & 1] * (x >> 16 & 3 == 0))
    return " ".join(out)


HARD = [
    (1, ""),
    (2, None),
    (3, "   \t\n"),
    (4, "one"),
    (5, "One two"),
    (6, text(1, 120)),
    (7, text(1, 120)),
    (7, text(1, 120)),
    (8, text(2, 9000)),
    (None, text(3, 60)),
    (None, None),
    (10, "x" * 5000 + " \u00a0\u2028 end\x00 \x1c \U0001f600"),
    (11, "a  b   c \n\n d <|endoftext|> 'll it's  "),
    (12, text(4, 300) + "\n" + text(4, 300) + "\n" + "rep rep rep rep rep " * 30),
    (13, text(1, 119) + " changed"),
    (-5, "é" * 700),
]
#: Columns that the operators use inside themselves.
CLASH = ["size", "position", "salt", "node", "shard", "h", "words", "run", "score", "kept", "fp", "tile", "slice", "target", "digest", "spans", "n", "tie", "bin"]


def frame(spark, rows=HARD, extra: bool = True):
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASH if extra)
    full = [(i, t, "en", [None, "b", "a", "b"][k % 4], None if t is None else len(t), *(["x"] * len(CLASH) if extra else [])) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, kinds).repartition(3)


def table_of(df):
    return [r.asDict() for r in df.collect()]


def pairs(n):
    return itertools.combinations(range(n), 2)


def same_as_sql(got, sql, folder, tables=("documents",)):
    """Holds a query's rows against DuckDB's of its SQL over the same folder, floats to six digits."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in tables:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) and glob.glob(path + '/*.parquet') else path}'")
    found = con.execute(sql)
    said = [c[0] for c in found.description]
    names = sorted(got.columns)
    assert sorted(said) == names
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([plain(r[said.index(c)]) for c in names]) for r in found.fetchall())
    have = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    assert len(have) == len(want)
    assert [(a, b) for a, b in zip(have, want, strict=True) if a != b][:3] == []
