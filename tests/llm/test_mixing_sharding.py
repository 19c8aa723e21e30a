"""Mixing and sharding against plain loops."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from playtrail.llm import mixing, queries, sharding
from tests.llm.helpers import DOCS, SF, odd_documents, words


def water_fill(sizes, share=1.5, weights=(3, 1, 2), most=2):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    full = {}
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(full.values())
        targets = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if targets[s] > most * sizes[s]]
        if not over:
            return full | targets
        full |= {s: most * sizes[s] for s in over}


def check_mix(rows, tolerance):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["size"] * 2 >= r["taken"] >= 0 and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    want = water_fill(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance(s, sizes, want)


def test_mix_meets_targets(spark):
    rows = queries.QUERIES["op1_mix_sources"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["size"] == len(words(docs[r["doc_id"]]["text"])) for r in rows)
    longest = {}
    for r in rows:
        longest[r["source"]] = max(r["size"], longest.get(r["source"], 0))
    check_mix(rows, lambda s, sizes, want: longest[s] / 2)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.02)
    again = queries.QUERIES["op1_mix_sources"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_is_pareto_sampling_up_to_the_finish(spark):
    """Without finishing documents, a source takes its ranking's longest beginning that stays within what is due."""
    light = spark.createDataFrame([("a", i, 1 + i % 7, None) for i in range(200)], "source string, doc_id bigint, size bigint, odds double")
    targets = spark.createDataFrame([("a", 1, sum(1 + i % 7 for i in range(200)), 1234.5)], "source string, source_no bigint, source_size bigint, target double")
    row = mixing.sampling_plan(light, targets, finishing=0).first()
    ranked = light.select("doc_id", "size", mixing.pareto_rank(F.col("doc_id"), F.lit(row["p"]), F.lit(None).cast("double"), 11).alias("q"))
    due, best = 1234.5 - row["copies"] * row["source_size"], None
    for r in ranked.orderBy("q").collect():
        due -= r["size"]
        if due < 0:
            break
        best = (r["q"], r["doc_id"], r["size"])
    assert best == (row["cut"]["q"], row["cut"]["id"], row["cut"]["size"])


def test_unequal_odds_favour_documents(spark):
    rows = [("a", i, 10, 9.0 if i % 2 else 1.0) for i in range(2000)]
    light = spark.createDataFrame(rows, "source string, doc_id bigint, size bigint, odds double")
    targets = spark.createDataFrame([("a", 1, 20_000, 10_000.0)], "source string, source_no bigint, source_size bigint, target double")
    plan = mixing.sampling_plan(light, targets).first()
    q = mixing.pareto_rank(F.col("doc_id"), F.lit(0.5), F.col("odds"), 11)
    taken = light.where(q <= plan["cut"]["q"]).groupBy(F.col("odds")).count().collect()
    count = {r["odds"]: r["count"] for r in taken}
    assert sum(count.values()) == 1000 and count[9.0] > 2 * count[1.0]


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).withColumn("size", F.lit("x")).withColumn("_cut", F.lit(1)).withColumn("TAKEN", F.lit(2))
    mixed, names = mixing.mix_sources(docs)
    rows = [
        {"source": r["source"], **{c: r[names[c]] for c in ("size", "source_size", "target", "taken")}} for r in mixed.collect()
    ]
    assert len(rows) == 15
    check_mix(rows, lambda s, sizes, want: max(sizes.values()))
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r[names["copies"]] for r in mixed.collect())
    assert mixing.mix_sources(docs.limit(0))[0].count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 997, 1000])
def test_permutation(spark, n):
    places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(places) == list(range(n))
    if n >= 100:
        assert sum(a < b for a, b in zip(places, places[1:])) < 0.6 * n


def check_shards(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(spark):
    rows = queries.QUERIES["op2_feistel_shards"](spark, SF).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_shards(rows, 40)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    # The place can be computed from the row number alone.
    n = len(rows)
    numbers = spark.createDataFrame([(r["row_number"], r["shard"], r["slot"]) for r in rows], "r bigint, shard bigint, slot bigint")
    place = sharding.permuted(F.col("r"), n, 7)
    assert numbers.where((place % 40 != F.col("shard")) | (F.floor(place / 40) != F.col("slot"))).count() == 0


def test_shards_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), DOCS).withColumn("shard", F.lit("x")).withColumn("_part", F.lit(1)).withColumn("number", F.lit(3))
    out, names = sharding.shard_rows(docs, "doc_id", 4)
    assert names["shard"] != "shard" and set(docs.columns) <= set(out.columns)
    check_shards([{"shard": r[names["shard"]], "slot": r[names["slot"]]} for r in out.collect()], 4)
    assert sharding.shard_rows(docs.limit(0), "doc_id", 4)[0].count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id bigint, text string")
    sharding.write_shards(docs, str(tmp_path / "s"), "doc_id", 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def test_sharding_runs_no_python(spark):
    plan = queries.QUERIES["op2_feistel_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def first_fit(ranked, due):
    """Ids taken in order, passing over what overflows, and the nearest one at last; ``ranked`` has (id, words)."""
    taken = []
    for i, w in ranked:
        if w <= due:
            due -= w
            taken.append(i)
    rest = [(abs(w - due), k, i) for k, (i, w) in enumerate(ranked) if i not in set(taken)]
    return set(taken) | {i for m, _, i in sorted(rest)[:1] if m < due}


@pytest.mark.parametrize(("long", "repeats"), [([100_000], 1), ([20_000] * 3, 1), ([30_000, 700, 90], 2)])
def test_long_documents_are_passed_over(spark, long, repeats):
    sizes = [100 + i * 37 % 200 for i in range(300)] + long
    rows = [(i, " ".join(["w"] * n), "en", "a", n) for i, n in enumerate(sizes) for _ in range(repeats)]
    rows += [(10_000 + i, " ".join(["w"] * 100), "en", "b", 100) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed, names = mixing.mix_sources(docs, weights=(1, 0.0001), share=0.5)
    out = [r for r in mixed.collect() if r["source"] == "a"]
    target, copies = out[0][names["target"]], {r["doc_id"]: r[names["copies"]] for r in out}
    assert len(out) == len(sizes) * repeats
    p = target / sum(sizes) / repeats
    assert 0 < p < 1
    light = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint")
    q = mixing.pareto_rank(F.col("doc_id"), F.lit(p), F.lit(None).cast("double"), 11)
    ranked = [(r["doc_id"], r["size"] * repeats) for r in light.orderBy(q).collect()]
    assert {d for d, c in copies.items() if c} == first_fit(ranked, target)
    miss = abs(sum(r[names["taken"]] for r in out) - target)
    assert miss <= min(sizes[d] for d, c in copies.items() if not c) * repeats / 2
