import random
from datetime import datetime, timedelta

import pytest
from stratalog.llm import golden

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
TRUST = {"partner": 0, "store": 1, "web": 2, "crm": 3}


def clients(n=1500, seed=5):
    rng, day = random.Random(seed), datetime(2024, 3, 1)
    blank = [None, "", " \t", "\x0b\n"]
    out = []
    for i in range(n):
        key = 7 if rng.random() < 0.34 else rng.choice([None, rng.randrange(n // 3)])
        at = None if rng.random() < 0.1 else day - timedelta(days=rng.choice([0, 1, 29, 30, 31, 60]), microseconds=rng.choice([0, 0, 1]))
        text = lambda some: rng.choice(blank) if rng.random() < 0.3 else rng.choice(some)
        out.append((i, key, rng.choice([*TRUST, "other", None]), at, text(["Ann", "Änn", " Ann ", "日本語", "x" * 3000]), text(["a@x", "b@x", "c@x"]), text(["Cor", "Dun"]), rng.choice([None, 1, 2]), text(["retail", "public", "online"]), rng.choice([None, 1.005, -3.335, 0.0, 12.5])))
    out += [(None, 7, "partner", day, "Nobody at all, of great length", None, None, None, "public", 5.0), (None, None, "web", day, "A", "e@x", None, 3, None, 1.0)]
    return out


def plain(rows):
    value = lambda v: None if isinstance(v, str) and not v.strip(" \t\n\x0b\x0c\r") else v
    far = datetime(1, 1, 1)
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if r[1] is None else r[1], []).append([r[0], TRUST.get(r[2], 4), r[3], *map(value, r[4:])])
    out = set()
    for cluster, records in groups.items():
        latest = max((r[2] for r in records if r[2]), default=None)
        stale = lambda r, latest=latest: r[2] is None or latest - r[2] > timedelta(hours=720)
        age = lambda r: (r[2] is None, far - (r[2] or far), r[1], r[0] is None, r[0] or 0)
        trusted = lambda r: (stale(r), r[1], *age(r))  # noqa: B023
        pick = lambda i, key: min((r for r in records if r[i] is not None), key=key, default=None)  # noqa: B023
        name, email, segment = pick(3, lambda r: (-len(r[3]), *trusted(r))), pick(4, trusted), pick(7, age)
        chosen = segment and segment[7]
        balance = pick(8, lambda r: (r[7] is None or r[7] != chosen, *age(r)))
        address = min(records, key=lambda r: (-(r[5] is not None) - (r[6] is not None), *trusted(r)))
        if address[5] is None and address[6] is None:
            address = None
        get = lambda r, i: r and r[i]
        out.add((cluster, len(records), sum(map(stale, records)), get(name, 3), get(email, 4), chosen, get(balance, 8), get(address, 5), get(address, 6), *(get(r, 0) for r in (name, email, segment, balance, address))))
    return out


@pytest.mark.parametrize("copies", [1, 2])
def test_records_against_plain_python(spark, copies):
    rows = clients()
    got = golden.client_records(spark.createDataFrame(rows * copies, SCHEMA)).collect()
    want = plain(rows * copies)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_other_keys_share_values_and_names_clash(spark):
    rows = clients(300, seed=8)
    df = spark.createDataFrame([(*r, "z", 1, "q", "w") for r in rows], SCHEMA + ", cluster string, id int, stale string, `we ird,{}` string")
    assert {tuple(r) for r in golden.client_records(df).collect()} == plain(rows)
    assert golden.client_records(spark.createDataFrame([], SCHEMA)).count() == 0
    df = df.withColumnRenamed("name", "na.me")
    some = golden.golden_records(df, ["source"], [golden.Field("who", ("na.me",), "recent")], ["x"], "client_id", "source", "updated_at")
    assert some.columns == ["cluster_id", "n_records", "n_stale", "na.me", "who_from"] and some.count() == 6


def test_a_hot_cluster_does_not_become_one_task(spark):
    """A third of the rows in one cluster: all its rows are reduced before a shuffle by cluster."""
    df = spark.createDataFrame(clients(3000), SCHEMA).repartition(8)
    plan = golden.client_records(df)
    assert plan.where("cluster_id = 7").first().n_records > 900


def test_the_registered_query(spark):
    import pandas as pd
    from stratalog.llm import queries

    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clients AS SELECT * FROM '{folder}/clients.parquet'")
    want = con.execute(queries.oracle_sql()["op13_golden_records"]).df()
    got = queries.op13_golden_records(spark, folder).toPandas()
    columns = sorted(want.columns)
    both = [d[columns].sort_values("cluster_id").reset_index(drop=True).astype(object).where(lambda x: x.notna(), None) for d in (got, want)]
    pd.testing.assert_frame_equal(*both, check_dtype=False)
