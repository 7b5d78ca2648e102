import random

import pytest
from pyspark.sql import functions as F

from komagrid.llm import mixing, packing


def items(spark, sizes, parts=3):
    return spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").repartition(parts)


def specs(spark, **capacities):
    return spark.createDataFrame(list(capacities.items()), "spec_name string, capacity long")


def test_packing_keeps_items_whole(spark):
    r = random.Random(1)
    sizes = [r.choice([r.randint(1, 100), r.randint(300, 2500), 1000]) for _ in range(400)] + [0, None, -5]
    placed = packing.pack(items(spark, sizes), specs(spark, a=1000, b=4000)).cache()
    for spec, capacity in (("a", 1000), ("b", 4000)):
        rows = placed.where(F.col("spec_name") == spec).collect()
        by_item, by_box = {}, {}
        for x in rows:
            by_item.setdefault(x.doc_id, []).append(x["size"])
            by_box[x.container] = by_box.get(x.container, 0) + x["size"]
        assert set(by_item) == set(range(len(sizes)))
        for i, s in enumerate(sizes):
            s = max(0, s or 0)
            assert sum(by_item[i]) == s and len(by_item[i]) == max(1, -(-s // capacity))
        assert max(by_box.values()) <= capacity
        assert sum(by_box.values()) / capacity > 0.93 * len(by_box)  # little is left unused
    split = {tuple(x) for x in packing.split_items(placed).collect()}
    assert split == {(n, i) for n, c in (("a", 1000), ("b", 4000)) for i, s in enumerate(sizes) if (s or 0) > c}
    assert packing.containers(placed).where("unused < 0").count() == 0


@pytest.mark.parametrize("parts", [17, 257])  # two and three rounds of merging
def test_packing_merges_in_rounds(spark, parts):
    r = random.Random(3)
    sizes = [r.choice([*[r.randint(1, 300)] * 4, r.randint(1001, 1300)]) for _ in range(3 * parts)]
    placed = packing.pack(items(spark, sizes, parts), specs(spark, a=1000)).collect()
    by_item, by_box = {}, {}
    for x in placed:
        by_item.setdefault(x.doc_id, []).append(x["size"])
        by_box[x.container] = by_box.get(x.container, 0) + x["size"]
    assert {i: (sum(x), len(x)) for i, x in by_item.items()} == {i: (s, -(-s // 1000)) for i, s in enumerate(sizes)}
    assert max(by_box.values()) <= 1000 and sum(sizes) > 930 * len(by_box)


def test_packing_corner_cases(spark):
    assert packing.pack(items(spark, []), specs(spark, a=10)).count() == 0
    rows = packing.pack(items(spark, [10, 10, 20]), specs(spark, a=10)).collect()
    assert len({x.container for x in rows}) == 4 == len(rows)
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(items(spark, [1]), specs(spark, a=0))


def test_windows_place_best_fit():
    w = packing.Windows(10, 2, "")
    first, second = w.place(6), w.place(7)
    assert first != second and w.place(3) == second and w.place(4) == first


def documents(spark, n=3000):
    r = random.Random(2)
    rows = [(i, r.choice(["big"] * 8 + ["small"]), r.randint(1, 500), 400) for i in range(n)] + [(n, None, 50, 1), (n + 1, "small", None, None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, n_chars long")


def test_mix(spark):
    docs = documents(spark).cache()
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.3, 4), ("m", "none", 0.2, 3), ("n", "small", 1.0, 2)], "mix_name string, source string, weight double, max_repeats int")
    report = {(r.mix_name, r.source): r for r in mixing.mix_report(docs, targets).collect()}
    sums = {r.source: r.s or 0 for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("s")).collect()}
    total = sum(sums.values())
    big = report["m", "big"]
    assert not big.capped and 0.5 * total - 500 <= big.actual_tokens <= 0.5 * total
    small = report["m", "small"]
    assert small.epochs == int(0.3 * total // sums["small"]) and 0.3 * total - 500 <= small.actual_tokens <= 0.3 * total
    assert report["m", "none"].capped and report["m", "none"].actual_tokens == 0
    assert report["n", "small"].capped and report["n", "small"].actual_tokens == 2 * sums["small"]
    assert abs(sum(r.actual_share for k, r in report.items() if k[0] == "m") - 1) < 1e-9
    rows = mixing.mix(docs, targets).collect()
    assert max(r.copies for r in rows if r.mix_name == "m" and r.source == "small") == small.epochs + 1
    assert len({(r.mix_name, r.doc_id) for r in rows}) == len(rows)
    again = mixing.mix(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_nothing(spark):
    docs = documents(spark, 0).limit(0)
    targets = spark.createDataFrame([("m", "big", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    row = mixing.mix_report(docs, targets).first()
    assert (row.actual_tokens, row.actual_share, row.capped) == (0, 0.0, False)


def test_weights_draw(spark):
    rows = [(i, "s", 1, 400 if i % 2 else 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, n_chars long")
    targets = spark.createDataFrame([("m", "s", 0.25, 1)], "mix_name string, source string, weight double, max_repeats int")
    taken = [r.doc_id for r in mixing.mix(docs, targets).collect()]
    assert len(taken) == 1000 and sum(i % 2 for i in taken) > 700


def test_no_bucket_holds_much_of_a_source(spark, monkeypatch):
    """Whatever the weights, the end of the budget falls into a small bucket."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("n_tokens"), F.lit(1).alias("n_chars"))
    targets = spark.createDataFrame([("m", "s", 0.37, 1), ("n", "s", 2.5, 2)], "mix_name string, source string, weight double, max_repeats int")
    sized = mixing._sized(docs, targets, "doc_id", "n_tokens", F.lit(0.01), 17)
    assert sized.groupBy("bucket").count().agg(F.max("count")).first()[0] < 40_000 / mixing.BUCKETS * 2
    report = {r.mix_name: r for r in mixing.mix_report(docs, targets, weight=F.lit(0.01)).collect()}
    assert report["m"].actual_tokens == 148_000 and not report["m"].exhausted
    assert report["n"].actual_tokens == 800_000 and report["n"].exhausted and report["n"].capped
    monkeypatch.setattr(mixing, "MAX_TARGETS", 1)
    with pytest.raises(ValueError, match="targets"):
        mixing.mix_report(docs, targets)
