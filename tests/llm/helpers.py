"""Tables with odd rows, and small references."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("id", "h", "th", "sid", "sig", "root", "keep", "rows", "rate", "copies", "n", "class", "e", "df", "entities", "terms", "s", "x", "y", "slots", "fold", "hash", "__hash", "__keep", "score", "n_masked", "part", "node", "w", "tokens")

PROSE = "the quiet river bends around the old mill and the keeper counts every barrel before the rain comes down from the hills at night"


def odd_rows():
    """Nulls in every column, empty, blank, wordless and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997} runs {i}" for i in range(60_000))
    rows = [(i, f"{PROSE} number {i} {'green' if i % 2 else 'blue'} door {i * 7}", "en", "web" if i % 3 else "books", 130) for i in range(40)]
    rows += [(100, PROSE, "en", "web", 120), (101, PROSE, "en", "web", 120), (101, PROSE, "en", "web", 120), (102, PROSE, None, None, None)]
    rows += [(None, None, None, None, None), (None, PROSE, "de", "web", 120), (None, PROSE, "de", "web", 120)]
    rows += [(200, None, "en", "web", None), (201, "", "en", "web", 0), (202, "", "fr", "", 0), (203, " \n\t ", "en", "web", 4), (204, "!!! ... ???", "en", "web", 11)]
    rows += [(300, long, "en", "web", len(long)), (301, "\U0001f600 été 中文 naïve", "zh", "web", 16), (302, "x" * 200_000, "en", "web", 200_000)]
    return rows


def odd_docs(spark, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    if clash:
        df = df.select("*", *[F.lit(f"c{i}").alias(c) for i, c in enumerate(CLASH)])
    return df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def components(pairs):
    """{node: least node of its component} of an iterable of pairs."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}
