import hashlib
import math
from collections import Counter, defaultdict

from cases import awkward, empty, frame, rows
from stratalog.llm import sharding


def plain_shard(key, weights):
    def draw(path, i, w):
        u = (int(hashlib.md5(f"{key}{path}/{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        return -math.log(u) / w if w > 0 else math.inf

    path, at, index = "", weights, []
    total = lambda x: x if isinstance(x, float) else sum(map(total, x))
    while not isinstance(at, float):
        i = 0 if len(at) == 1 else min(range(len(at)), key=lambda i: (draw(path, i, total(at[i])), i))
        index.append(i)
        path += f"/{i}"
        at = at[i]
    flat = [(r, k, s) for r, region in enumerate(weights) for k, rack in enumerate(region) for s in range(len(rack))]
    return flat.index(tuple(index))


def test_weighted_draws_against_plain_python(spark):
    t = sharding.Topology((((1.0, 2.0), (0.5,)), ((3.0, 0.0, 1.0),)))
    df = spark.range(3000)
    got = sharding.place(df, df["id"], t, "x").collect()
    assert all(r.x == plain_shard(str(r.id), t.weights) for r in got)
    n = Counter(r.x for r in got)
    for shard, share in enumerate([1 / 7.5, 2 / 7.5, 0.5 / 7.5, 3 / 7.5, 0, 1 / 7.5]):
        assert abs(n[shard] / 3000 - share) < 0.04


def test_every_case_has_a_place(spark):
    data = rows()
    got = sharding.shard_documents(frame(spark), sharding.Topology.uniform()).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d[0], len((d[1] or "").encode()) + 8) for d in data)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.shard_documents(empty(spark), sharding.Topology.uniform()).count() == 0


def test_place_keeps_columns(spark):
    df = awkward(spark)
    got = sharding.place(df, df["doc_id"], sharding.Topology.uniform(), "shard")
    assert got.columns == [*df.columns, "shard"] and {r.region for r in got.collect()} == {"z"}
