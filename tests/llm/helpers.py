"""Small tables with all that may go wrong in a row, and brute-force pieces that several tests use."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, prose(2, 60), "de", None, 5),
        (5, long, "en", "a", len(long)),
        (5, long, "en", "a", len(long)),
        (6, long, None, None, None),
        (None, "one two three four five six seven eight nine ten eleven", "fr", "b", 3),
        (8, " \t\n\x0b\x0c\r ", "en", "", 7),
        (9, "short", "en", "a", 5),
        (10, "naïve café   \U0001f600   İSTANBUL ß", "tr", "a", 9),
        (11, "x" * 20_000, "en", "b", 20_000),
        (12, "\n".join(["same line of words"] * 30), "en", "b", 9),
    ]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(hard_rows() if rows is None else rows, DOCS)


def clashing(df, names="id node row text_hash host component label v fp shard slot key part value block epoch weight src tokens stop passes base added kept"):
    """df with extra columns of names that operators might use themselves."""
    return df.withColumns({n: F.lit("clash") for n in names.split() if n not in df.columns})


def union_find(nodes, links) -> dict:
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def python_free(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "ArrowEval", "ExternalRDD", "Scan ExistingRDD["))
