"""FASTA and NPY shards as data sources, over files of many partitions a record."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.sources import fasta, shards


def wrapped(name, sequence, width, end="\n"):
    return f">{name}{end}" + "".join(sequence[i : i + width] + end for i in range(0, len(sequence), width))


@pytest.fixture
def genome(tmp_path):
    rng = random.Random(1)
    own = {n: "".join(rng.choice("ACGTacgtN") for _ in range(k)) for n, k in (("chr1", 5000), ("chr2", 60), ("chr3", 59), ("chr4", 1), ("chrM", 121))}
    text = "".join(wrapped(f"{n} some words", s, 60) for n, s in own.items()) + ">empty\n"
    (tmp_path / "a.fa").write_text(text)
    other = "".join(rng.choice("ACGT") for _ in range(1000))
    (tmp_path / "b.fa").write_text(wrapped("win", other, 70, "\r\n"))
    (tmp_path / "c.fa").write_text(wrapped("bare", "ACGT" * 50, 50).rstrip("\n"))
    return str(tmp_path), own | {"win": other, "bare": "ACGT" * 50, "empty": ""}


@pytest.mark.parametrize("range_bytes", [37, 700, 1 << 20])
def test_index_by_ranges(spark, genome, range_bytes):
    path, own = genome
    found = {r["chrom"]: r for r in fasta.index_fasta(spark, path, range_bytes).collect()}
    assert {n: r["length"] for n, r in found.items()} == {n: len(s) for n, s in own.items()}
    assert (found["chr1"]["line_bases"], found["chr1"]["line_bytes"], found["win"]["line_bases"], found["win"]["line_bytes"]) == (60, 61, 70, 72)
    assert {r["chrom"]: r["size"] for r in fasta.chrom_sizes(fasta.index_fasta(spark, path)).collect()}["chr2"] == 60


def test_chunks_of_a_record_lie_in_many_partitions(spark, genome):
    path, own = genome
    index = fasta.index_fasta(spark, path).persist()
    rows = fasta.read_chunks(spark, index, chunk=64, range_bytes=256)
    assert rows.where("chrom = 'chr1'").withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 10
    got = {}
    for r in rows.orderBy("chrom", "chunk").collect():
        assert r["start"] == r["chunk"] * 64
        got[r["chrom"]] = got.get(r["chrom"], "") + r["bases"]
    assert got == {n: s.upper() for n, s in own.items() if s}


def test_what_is_not_asked_for_is_not_read(spark, genome):
    path, own = genome
    index = fasta.index_fasta(spark, path).persist()
    rows = fasta.read_chunks(spark, index, chunk=64, range_bytes=128)
    some = fasta.read_chunks(spark, index, chunk=64, range_bytes=128, chroms=["chr1"], low=640, high=960)
    assert some.rdd.getNumPartitions() <= 4 < rows.rdd.getNumPartitions()
    assert "".join(r["bases"] for r in some.orderBy("start").collect()) == own["chr1"][640:960].upper()
    assert rows.where("chrom IN ('chr2', 'none')").count() == 1 and rows.where("chrom = 'none'").count() == 0
    assert fasta.read_chunks(spark, index, chroms=["none"]).count() == 0


def test_faults_of_files(spark, tmp_path):
    import gzip

    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(b">a\nACGT\n"))
    (tmp_path / "y.fa").write_bytes(gzip.compress(b">a\nACGT\n"))
    for name in ("x.fa.gz", "y.fa"):
        with pytest.raises(ValueError, match="compressed"):
            fasta.index_fasta(spark, str(tmp_path / name))
    for k, text in enumerate((">a\nACGT\nAC\nACGT\n", ">a\nACG\nACGT\n", ">a\nACGT\nACGTA\n")):
        (tmp_path / f"z{k}.fa").write_text(text)
        for size in (5, 1000):
            with pytest.raises(Exception, match="unequal"):
                fasta.index_fasta(spark, str(tmp_path / f"z{k}.fa"), size).collect()
    with pytest.raises(FileNotFoundError):
        fasta.index_fasta(spark, str(tmp_path / "none.fa"))


def test_one_chromosome_by_its_file_s_name(spark, tmp_path):
    (tmp_path / "7.fa").write_text(">7 dna\nacgt\nAC\n")
    (tmp_path / "chr8.fasta").write_text(">chr8\nGG\n>other\nA\n")
    assert [(r["chrom"], r["bases"]) for r in fasta.read_chrom(spark, str(tmp_path), "chr7").collect()] == [("chr7", "ACGTAC")]
    with pytest.raises(ValueError, match="other records"):
        fasta.read_chrom(spark, str(tmp_path), "8")
    with pytest.raises(FileNotFoundError):
        fasta.read_chrom(spark, str(tmp_path), "chr9")


def activations(spark, n=50):
    own = spark.range(n * 3).select(F.lit("t8").alias("tap"), F.when(F.col("id") < n, "dev").otherwise("test").alias("split"), F.floor(F.col("id") / n).cast("int").alias("shard"), (F.col("id") % n).alias("row"), F.array(*[(F.col("id") * k / 8).cast("float") for k in range(1, 4)]).alias("vec"))
    return own


def plain(frame):
    return sorted((r["tap"], r["split"], r["shard"], r["row"], tuple(r["vec"])) for r in frame.collect())


@pytest.mark.parametrize("kind", ["float16", "float32"])
def test_shards_round_trip(spark, tmp_path, kind):
    folder, rows = str(tmp_path / "s"), activations(spark)
    index = shards.write_shards(rows.repartition(4), folder, kind, block=8)
    assert index.count() == 3 * 7
    own = np.load(f"{folder}/t8-test-000001.npy")
    assert own.dtype == kind and own.shape == (50, 3) and own[2].tolist() == [52 / 8, 104 / 8, 156 / 8]
    assert plain(shards.read_shards(spark, folder, partition_bytes=100)) == plain(rows)
    test = shards.read_shards(spark, folder, "t8", "test", shards=2)
    assert plain(test) == plain(rows.where("split = 'test'"))
    with pytest.raises(ValueError, match="2 of 3"):
        shards.read_shards(spark, folder, "t8", "test", shards=3)
    few = shards.read_shards(spark, folder, partition_bytes=60, rows=(16, 24)).where("shard = 1")
    assert few.rdd.getNumPartitions() <= 4 and plain(few) == plain(rows.where("shard = 1 AND row >= 16 AND row < 24"))


def test_a_flipped_value_fails(spark, tmp_path):
    folder = str(tmp_path / "s")
    shards.write_shards(activations(spark), folder, "float32", block=8)
    path = tmp_path / "s" / "t8-test-000002.npy"
    raw = bytearray(path.read_bytes())
    raw[256 + 20 * 12] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="differs from the index in rows 16 to 23"):
        shards.read_shards(spark, folder).count()
    assert shards.read_shards(spark, folder, rows=(0, 16)).where("shard = 2").count() == 16  # other blocks are sound


def test_faults_of_shards(spark, tmp_path):
    rows = activations(spark)
    for k, (bad, what) in enumerate(((rows.where("row <> 5"), "0, 1, 2"), (rows.withColumn("vec", F.when(F.col("row") == 3, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vec"))), "lengths"), (rows.withColumn("vec", F.when(F.col("row") == 3, F.array(*[F.lit(float("nan")).cast("float")] * 3)).otherwise(F.col("vec"))), "finite"), (rows.withColumn("vec", F.transform("vec", lambda x: x + 1e6)), "finite"))):
        with pytest.raises(Exception, match=what):
            shards.write_shards(bad, str(tmp_path / f"x{k}"))
    folder = str(tmp_path / "s")
    shards.write_shards(rows, folder, block=8)
    kept = spark.read.parquet(f"{folder}/index.parquet").where("NOT (shard = 1 AND first = 8)").collect()
    spark.createDataFrame(kept).write.mode("overwrite").parquet(f"{folder}/index.parquet")
    with pytest.raises(ValueError, match="gaps"):
        shards.read_shards(spark, folder)
