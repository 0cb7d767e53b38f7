"""Rows that every operator has to take: null and repeated ids, empty and long texts, copies, and awkward column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = ", `a.b` int, _key string, region string, block string, at string, row string, doc string, spans string, body string, u1 string, `we ird,{}` string"


def words(rng, n, kinds=400):
    return [f"v{rng.randrange(kinds)}" for _ in range(n)]


def rows(seed=21):
    rng = random.Random(seed)
    passage, text = words(rng, 40), lambda n: words(rng, n)
    base = text(90)
    near = list(base)
    near[45] = "other"
    out = [
        (3, " ".join(base)), (4, " ".join(base)), (None, " ".join(base)), (9, " ".join(near)), (1, " ".join(text(30) + passage + text(30))), (2, " ".join(text(20) + passage + text(15))),
        (7, " ".join(text(25))), (7, " ".join(text(10) + passage)), (7, " ".join(text(10) + passage)), (None, " ".join(passage)), (None, None), (11, None), (12, ""), (13, " \t\n "), (14, "a b"), (14, "a b"), (15, "É 日本 x"),
        (20, " ".join(text(9000) + passage + text(9000))), (21, "the " * 3000), (22, "x" * 50_000),
    ]
    return [(i, t, "en" if k % 3 else None, "s", len(t or "")) for k, (i, t) in enumerate(out)]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def awkward(spark):
    """The same rows with columns whose names an operator may use itself, or that need quoting."""
    return spark.createDataFrame([(*r, k, *["z"] * 10) for k, r in enumerate(rows())], SCHEMA + AWKWARD)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
