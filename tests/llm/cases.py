"""Tables that every operator must take: odd rows, repeated rows, no rows, columns with names that operators use themselves."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000 + "\n" + "x" * 50_000
ROWS = [
    (1, "One two three four five six seven eight nine ten", "en", "a", 10),
    (1, "One two three four five six seven eight nine ten", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "fr", None, 4),
    (5, LONG, "de", "b", len(LONG)),
    (6, "!!! 123 ...", "en", "b", 11),
    (None, "a row without number, but with words in it", "en", "c", 1),
    (8, "One two three four five six seven eight nine ten", None, "c", 10),
    (9, "é ß 日本語 \U0001f600 text <|endoftext|> more", "es", "c", 3),
]
CLASH = "salt key n h w b bucket slice_ digest point s1 c node tokens rule score taken size start path rid x rank keep copies line best kind item pos".split()


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(df):
    return df.withColumns({c: F.lit("?") for c in CLASH if c not in df.columns})


def rows(df, *cols):
    got = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in got.collect()), key=repr)


def holds(make, df):
    """make gives as many rows as df, the same with more columns, and none for none; returns its rows."""
    got = rows(make(df))
    assert len(got) == df.count()
    assert rows(make(clashing(df))) == got
    assert rows(make(df.limit(0))) == []
    return got
