import pytest
from pyspark.sql import functions as F

from quillon.operators import controls, interventions, manifests, panels, stores, validators

BINS = "chrom string, bin_start long, bin_end long"


def test_coordinates_and_masks_fail(spark):
    good = spark.createDataFrame([("c", 0, 128), ("c", 128, 256)], BINS)
    assert validators.check_coordinates(good, 128) is good and validators.check_uniform(good) == 128
    bad = [[("c", 0, 128), ("c", 0, 128)], [("c", 0, 64)], [(None, 0, 128)], [("c", -128, 0)], []]
    for rows in bad:
        with pytest.raises(ValueError):
            validators.check_coordinates(spark.createDataFrame(rows, BINS), 128)
    with pytest.raises(ValueError):
        validators.check_coordinates(good.drop("chrom"), 128)
    with pytest.raises(ValueError):
        validators.check_uniform(spark.createDataFrame([("c", 0, 128), ("c", 128, 200)], BINS))
    mask = lambda *v: spark.createDataFrame([(x,) for x in v], "m int").select(validators.mask_values(F.col("m")).alias("m")).collect()
    assert [r["m"] for r in mask(0, 1)] == [False, True]
    for v in (2, None):
        with pytest.raises(Exception, match="mask value"):
            mask(v)


def test_alignment_panels_and_regions(spark):
    a = spark.createDataFrame([("c", 0, 1, "t"), ("c", 1, 2, "t")], BINS + ", split string")
    validators.check_aligned(a, a.orderBy(F.desc("bin_start")))
    with pytest.raises(ValueError):
        validators.check_aligned(a, a.limit(1))
    p = spark.createDataFrame([("x", "primary"), ("y", "local")], "concept string, role string")
    validators.check_panel(p, p, {"width": 128}, {"width": 128})
    for q, own in ((p.where("concept = 'x'"), {}), (p, {"width": 64})):
        with pytest.raises(ValueError):
            validators.check_panel(p, q, own or {"width": 128}, {"width": 128})
    assert validators.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    for text in ("chr1", "chr1:5-5", "chr1:x-y"):
        with pytest.raises(ValueError):
            validators.parse_region(text)
    wide = spark.createDataFrame([(1, 0, 1)], "id int, x int, y int")
    assert validators.resolve_concepts(wide, p, ["id"]) == [("x", "primary"), ("y", "local")]
    with pytest.raises(ValueError):
        validators.resolve_concepts(wide.drop("y"), p, ["id"])
    assert {(r["concept"], r["y"]) for r in validators.melt(wide, "id", ["x", "y"]).collect()} == {("x", 0), ("y", 1)}


def test_labels_and_frozen_content(spark):
    labels = spark.range(120).select(F.explode(F.array(*[F.lit(c) for c in ("half", "rare", "flat")])).alias("concept"), F.col("id")).withColumn("y", F.when(F.col("concept") == "half", F.col("id") % 2).when(F.col("concept") == "rare", (F.col("id") < 5).cast("long")).otherwise(0))
    assert [r["concept"] for r in validators.without_rare(labels).select("concept").distinct().collect()] == ["half"]
    with pytest.raises(ValueError, match="flat"):
        validators.check_varied(labels)
    one = validators.content_hash(labels).first()
    assert validators.check_frozen(labels.orderBy(F.desc("id")), one["n"], one["hash"]) is not None
    with pytest.raises(ValueError):
        validators.check_frozen(labels.where("id > 0"), one["n"], one["hash"])
    table = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    assert not stores.same_content(table(("a|b", "c")), table(("a", "b|c"))) and not stores.same_content(table((None, "x")), table(("null", "x"))) and not stores.same_content(table(("", "x")), table((None, "x")))
    assert stores.same_content(labels, labels.repartition(3)) and not stores.same_content(labels, labels.limit(3))


def test_draws_and_manifests(spark):
    pool = spark.range(50).select(F.lit("c").alias("chrom"), (F.col("id") * 10).alias("win_start"), (F.col("id") * 10 + 10).alias("win_end"))
    key = ("chrom", "win_start")
    dealt = manifests.deal(pool, key, {"test": 5, "val": 7, "train": 0})
    assert {r["split"]: r["count"] for r in dealt.groupBy("split").count().collect()} == {"test": 5, "val": 7, "train": 38}
    assert dealt.select(*key).distinct().count() == 50
    for counts in ({"test": 51}, {"test": 0, "val": 3}):
        with pytest.raises(ValueError):
            manifests.deal(pool, key, counts)
    assert manifests.overlaps(dealt).count() == 0
    assert manifests.overlaps(dealt.union(dealt.limit(1))).count() == 1
    numbered = manifests.shards(dealt, 6).groupBy("shard").count().collect()
    assert sorted((r["shard"], r["count"]) for r in numbered) == [(i, 6) for i in range(8)] + [(8, 2)]


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(40).select(F.concat(F.lit("r"), "id").alias("row_id"), F.lit("t8").alias("tap"), F.lit("test").alias("split"), F.floor(F.col("id") / 10).cast("int").alias("shard"), F.lit("c").alias("chrom"), (F.floor(F.col("id") / 10) * 40).alias("win_start"), (F.col("id") * 4).alias("bin_start"), (F.col("id") * 4 + 4).alias("bin_end"), (F.col("id") % 7 > 0).alias("kept"), F.array(F.col("id").cast("float")).alias("vec"))
    stores.write_store(rows.where("shard < 2"), path, "run 1")
    with pytest.raises(ValueError, match="shards"):
        stores.open_store(spark, path, "t8", "test", shards=4)
    stores.write_store(rows, path, "run 1")
    stores.write_store(rows, path, "run 1")  # again: nothing doubles
    store = stores.open_store(spark, path, "t8", "test", shards=4)
    assert store.count() == rows.where("kept").count()
    with pytest.raises(ValueError, match="another run"):
        stores.write_store(rows, path, "run 2")
    asked = spark.createDataFrame([(0, "r11"), (1, "r3"), (2, "r11"), (3, "r0"), (4, "zz")], "at int, row_id string")
    got = {r["at"]: r["vec"] for r in stores.take(store, asked).collect()}
    assert got == {0: [11.0], 1: [3.0], 2: [11.0], 3: None, 4: None}
    sizes = [t.num_rows for t in stores.batches(store, 7)]
    assert sizes[:-1] == [7] * (len(sizes) - 1) and sum(sizes) == store.count() and 0 < sizes[-1] <= 7
    assert [r["bin_start"] for r in stores.window_coordinates(store, "c", 40).collect()] == [4 * i for i in range(10, 20) if i % 7]
    every = stores.coordinates(rows)
    windows = every.select("chrom", "win_start", F.lit(10).alias("n_bins")).distinct()
    assert stores.check_windows(every, windows, 4).count() == 4
    with pytest.raises(ValueError, match="incomplete"):
        stores.check_windows(stores.coordinates(store), windows, 4)
    n = store.count()  # its files are replaced from here on
    flipped = rows.where("shard = 3").withColumn("vec", F.when(F.col("row_id") == "r33", F.array(F.lit(0.5).cast("float"))).otherwise(F.col("vec")))
    flipped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tap", "split", "shard").parquet(f"{path}/activations")
    with pytest.raises(ValueError, match="differs"):  # one value of one vector
        stores.open_store(spark, path, "t8", "test")
    rows.where("shard = 3").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tap", "split", "shard").parquet(f"{path}/activations")
    assert stores.open_store(spark, path, "t8", "test").count() == n
    damaged = spark.read.parquet(f"{path}/activations").where("row_id = 'r5'")
    damaged.withColumn("row_id", F.lit("rx")).write.mode("append").partitionBy("tap", "split", "shard").parquet(f"{path}/activations")
    with pytest.raises(ValueError, match="differs"):
        stores.open_store(spark, path, "t8", "test")


def test_controls_without_near_features_draw_from_all(spark):
    rates = spark.createDataFrame([(0, 0.5), (1, 0.001), (2, 0.52), (3, 0.1), (4, 0.45), (5, 0.49)], "feature int, rate double")
    targets = spark.createDataFrame([(0,), (1,)], "feature int")
    out = controls.activity_matched(rates, targets, 3).collect()
    assert {r["control"] for r in out if r["target"] == 0} == {2, 4, 5}
    lonely = [r["control"] for r in out if r["target"] == 1]
    assert len(lonely) == len(set(lonely)) == 3 and set(lonely) <= {2, 3, 4, 5}
    assert controls.activity_matched(rates, targets, 9).where("target = 1").count() == 4
    assert controls.low_auroc(rates.withColumn("max_auroc", F.when(F.col("feature") > 3, 0.5).otherwise(0.6))).count() == 2


def test_doses_and_panels(spark):
    dose = lambda x: spark.createDataFrame([(x,)], "c double").select(interventions.matched_dose(F.lit(2.0), F.col("c")).alias("d")).first()["d"]
    assert dose(0.5) == 4.0
    with pytest.raises(Exception, match="does not move"):
        dose(1e-12)
    spans = spark.createDataFrame([("c", 0, 5), ("c", 5, 9)], "chrom string, start long, end long")
    make = {"ccre_union": lambda spec: spans, "ccre_class": lambda spec: spans.where("false")}
    built = panels.build_panel([{"name": "a", "kind": "ccre_union"}], make)
    assert [(r["concept"], r["start"], r["end"]) for r in built.collect()] == [("a", 0, 9)]
    for specs in ([], [{"name": "a", "kind": "x"}], [{"name": "a", "kind": "ccre_union"}] * 2, [{"name": "e", "kind": "ccre_class"}]):
        with pytest.raises(ValueError):
            panels.build_panel(specs, make)
    contrasts = spark.createDataFrame([(4, 0.5), (2, 0.5), (9, 0.1)], "feature int, contrast double")
    assert interventions.winner(contrasts).first()["feature"] == 2 and interventions.winner(contrasts.where("false")).count() == 0
