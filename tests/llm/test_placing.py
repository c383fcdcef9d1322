"""Sharding and mixing."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from compare import connect, difference
from conftest import FOLDER
from pyspark.sql import functions as F

from sparsile.llm import pareto_mix, rendezvous
from sparsile.llm.queries import CHECKS, QUERIES


def score(key, shard, weight=1.0):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    unit = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 11) + 0.5) / 2**53
    return weight / -math.log(unit)


def test_shards_against_scores(spark, rows):
    found = {r.doc_id: r for r in QUERIES["op5_rendezvous"](spark, FOLDER).collect()}
    slots = defaultdict(list)
    for key, text in rows.items():
        r = found[key]
        scores = [score(key, s) for s in range(41)]
        assert r.shard == max(range(40), key=scores.__getitem__) and r.grown_shard == max(range(41), key=scores.__getitem__)
        assert (r.size, r.text_crc32, r.law) == (len(text.encode()) + 16, zlib.crc32(text.encode()), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_growth(spark):
    keys = spark.range(40_000)
    three = keys.select("id", rendezvous.shard_of(F.col("id"), [1.0, 2.0, 0.0, 5.0]).alias("a"), rendezvous.shard_of(F.col("id"), [1.0, 2.0, 0.0, 5.0, 2.0]).alias("b"))
    got = three.groupBy("a", "b").count().collect()
    share = Counter()
    for r in got:
        share[r.a] += r["count"]
        assert r.b in (r.a, 4)
    assert share[2] == 0 and all(abs(share[s] / 40_000 - w / 8) < 0.01 for s, w in ((0, 1), (1, 2), (3, 5)))


def test_mix_equals_sql(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        assert difference(spark, connect(folder), QUERIES["op6_pareto_mix"], CHECKS["op6_pareto_mix"], folder) is None


def test_mix_meets_its_targets(spark):
    rows = QUERIES["op6_pareto_mix"](spark, "/root/testdata/sf0.1").collect()
    taken, targets, largest = Counter(), {}, Counter()
    for r in rows:
        source = (r.source_size, r.target)
        taken[source] += r.taken
        targets[source] = r.target
        largest[source] = max(largest[source], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert abs(sum(targets.values()) - sum(r.size for r in rows)) < 1
    assert all(abs(taken[s] - t) <= largest[s] for s, t in targets.items())


def test_water_filling_stops_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    found = {r.source: r.target for r in pareto_mix.source_targets(sizes).collect()}
    # a is full at 30; the other 1980 are shared 2 : 1; the empty source takes nothing
    assert found == {"a": 30.0, "b": 1320.0, "c": 660.0, None: 0.0}


def test_documents_of_the_mix(docs):
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in pareto_mix.mix(docs).collect()}
    copies = Counter(r.doc_id for r in pareto_mix.mixed_documents(docs).collect())
    assert copies == Counter({k: n for k, n in taken.items() if n})
    assert not any("Python" in line or "Arrow" in line or "Pandas" in line for line in pareto_mix.mixed_documents(docs)._jdf.queryExecution().toString().split("\n"))


def test_inclusion_follows_size(spark):
    # one source in three gets more than its size, one less: chances are proportional to size, certain ones whole
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.expr("concat(repeat('w ', shiftleft(4, CAST(id % 5 AS INT))), id)").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(30_000 + i, f"s{i % 3}", "w " * 30_000) for i in range(3)], docs.schema))
    rows = pareto_mix.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
    for (target, total), members in by.items():
        copies = int(target / total)
        owed = target - copies * total
        if owed <= 0:
            assert all(r.taken == copies * r.size for r in members)
            continue
        others = [r.size for r in members]  # certain ones go until all are below 1
        while others and (factor := (owed - sum(r.size for r in members) + sum(others)) / sum(x * x for x in others)) * max(others) >= 1:
            others = [x for x in others if x < max(others)]
        groups = defaultdict(list)
        for r in members:
            groups[r.size].append(r.taken // r.size - copies)
        for size, extra in groups.items():
            p = min(1, factor * size)
            assert abs(sum(extra) / len(extra) - p) <= 5 * math.sqrt(p * (1 - p) / len(extra)) + 0.002
        assert abs(sum(r.taken for r in members) - target) <= max(others)


def test_repeated_rows_are_drawn_one_by_one(spark):
    repeats = [(7, "a", "word " * 60)] * 30 + [(None, "a", "null key " * 30)] * 25
    docs = spark.createDataFrame(repeats + [(100 + i, "a", f"x{i} " * 9) for i in range(10)] + [(200 + i, "b", f"y{i} " * 60) for i in range(40)], "doc_id long, source string, text string").repartition(7)
    rows = pareto_mix.mix(docs).collect()
    for target in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == target) - target) <= 60
    taken = Counter((r.doc_id, r.size) for r in rows for _ in range(r.taken // max(r.size, 1)))
    assert taken == Counter((r.doc_id, len(r.text.split())) for r in pareto_mix.mixed_documents(docs).collect())
    assert taken == Counter((r.doc_id, r.size) for r in pareto_mix.mix(docs.repartition(3)).collect() for _ in range(r.taken // max(r.size, 1)))
