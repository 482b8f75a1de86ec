import gzip

import pytest

from quillon.sources import annotation as an
from quillon.sources import sinks


def test_bed_modes_and_classes(spark, tmp_path):
    path = str(tmp_path / "a.bed")
    rows = "#c\ntrack x\nchr1\t100\t300\tx\tPLS\nchr1\t500\t700\tx\tpELS,CTCF-bound\nchr1\t900\t1000\tx\tCTCF-only,CTCF-bound\nbroken\tq\t3\nchr2\t5\t9\tx\t.\n"
    open(path, "w").write(rows)
    assert an.read_bed(spark, path).count() == 4
    labelled = an.read_bed(spark, path, class_column=4)
    assert [(r["start"], r["end"]) for r in an.class_intervals(labelled, "pELS").collect()] == [(500, 700)]
    assert an.class_intervals(labelled, "CTCF-bound").count() == 2
    with pytest.raises(Exception, match="bad record"):
        an.read_bed(spark, path, strict=True).collect()


def gtf(tmp_path):
    lines = []
    for chrom, strand in (("chr1", "+"), ("chr2", "-")):
        for n, (a, b) in enumerate(((101, 200), (301, 400)), 1):
            lines.append(f'{chrom}\ts\texon\t{a}\t{b}\t.\t{strand}\t.\tgene_id "g"; transcript_id "t_{chrom}"; exon_number {n}; tag "x"; tag "y";')
    lines.append('chr1\ts\ttranscript\t1001\t2000\t.\t+\t.\tgene_id "g"; transcript_id "t";')
    lines.append('chr2\ts\ttranscript\t1001\t2000\t.\t-\t.\tgene_id "g"; transcript_id "t";')
    path = tmp_path / "a.gtf.gz"
    path.write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    return str(path)


def test_gtf_splice_and_starts(spark, tmp_path):
    path = gtf(tmp_path)
    exons = an.read_gtf(spark, path, ["exon"])
    donor = {r["chrom"]: (r["start"], r["end"]) for r in an.splice_sites(exons, "donor", 10).collect()}
    acceptor = {r["chrom"]: (r["start"], r["end"]) for r in an.splice_sites(exons, "acceptor", 10).collect()}
    assert donor == {"chr1": (190, 210), "chr2": (290, 310)} and acceptor == {"chr1": (290, 310), "chr2": (190, 210)}
    starts = an.transcription_starts(an.read_gtf(spark, path, ["transcript"]), 100)
    assert {(r["start"], r["end"]) for r in starts.collect()} == {(900, 1101), (1899, 2100)}
    assert an.gtf_attributes(exons).first()["pairs"]["tag"] == ["x", "y"]
    assert sorted(r["exon_number"] for r in exons.collect()) == [1, 1, 2, 2]


def test_fasta_fetch_pads(spark, tmp_path):
    path = str(tmp_path / "a.fa")
    open(path, "w").write(">chr1 note\nacgt\nAC\n>chr2\nGGG\n")
    seqs = an.read_fasta(spark, path)
    assert {r["chrom"]: r["sequence"] for r in seqs.collect()} == {"chr1": "ACGTAC", "chr2": "GGG"}
    places = spark.createDataFrame([("chr1", 4, 8), ("chr1", 0, 6), ("chr1", 9, 11), ("chr3", 0, 2), ("chr2", 1, 1)], "chrom string, start long, end long")
    for size in (2, 3, 100):
        out = {(r["chrom"], r["start"]): r["bases"] for r in an.fetch(seqs, places, size).collect()}
        assert out == {("chr1", 4): "ACNN", ("chr1", 0): "ACGTAC", ("chr1", 9): "NN", ("chr3", 0): None, ("chr2", 1): ""}


def test_matrices(spark, tmp_path):
    path = str(tmp_path / "m.txt")
    open(path, "w").write(">MA1 CTCF\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8.5 ]\n")
    rows = {(r["base"], r["pos"]): r["w"] for r in an.read_matrices(spark, path).collect()}
    assert rows["C", 1] == 4.0 and rows["T", 1] == 8.5 and len(rows) == 8
    open(path, "w").write(">MA1 CTCF\nA [ 1 2 ]\n")
    with pytest.raises(Exception, match="not four rows"):
        an.read_matrices(spark, path).collect()


def test_folds(spark, tmp_path):
    path = str(tmp_path / "f.bed")
    open(path, "w").write("chr1\t0\t10\tfold0\n")
    assert an.read_folds(spark, path).first()["fold"] == "fold0"
    open(path, "w").write("chr1\t0\t10\tfold9\n")
    with pytest.raises(Exception, match="unknown fold"):
        an.read_folds(spark, path).collect()


def test_bedgraph_and_resume(spark, tmp_path):
    bins = spark.createDataFrame([("chr7", 1000 + 128 * i, 1128 + 128 * i, v) for i, v in enumerate([0.0, 1.5, 0.0, 2.0, 0.0, 0.0])], "chrom string, start long, end long, value double")
    path = str(tmp_path / "out")
    sinks.write_bedgraph(bins, path, name="x")
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert len(lines) == 3 and lines[0].startswith("track") and lines[1] == "chr7\t1128\t1256\t1.5"
    assert lines[0] == 'track type=bedGraph name="x" description="x" color=42,120,214 visibility=full autoScale=on'
    assert sinks.receipts(bins, "chrom").select("sha256").distinct().count() == 6


def test_digests(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    assert an.file_digests(spark, str(tmp_path / "x")).first()["md5"] == "900150983cd24fb0d6963f7d28e17f72"


def test_numbers_as_in_c(spark):
    import math

    values = [0.0, 1e-7, 1234567.5, 100000.0, 999999.5, 0.0001, 0.0000999999951, -2.5, 1 / 3, 123456.0, 1e100, 5e-300, 1e22, -0.00012345678]
    rows = spark.createDataFrame([(v,) for v in values], "value double").select("value", sinks.short_number("value").alias("t")).collect()
    assert all(r["t"] == "%.6g" % r["value"] or (r["value"] == 0 and r["t"] == "0") for r in rows), [(r["t"], "%.6g" % r["value"]) for r in rows]
    bad = spark.createDataFrame([("c", 0, 5, math.inf)], "chrom string, start long, end long, value double")
    with pytest.raises(Exception, match="bad bin"):
        sinks.bedgraph_lines(bad, "x").collect()
    with pytest.raises(Exception, match="bad bin"):
        sinks.bedgraph_lines(bad.withColumns({"value": bad["value"] * 0 + 1, "end": bad["start"]}), "x").collect()


def test_tables_and_documents(spark, tmp_path):
    import json

    import numpy as np

    spans = spark.createDataFrame([("chr2", 5, 9), ("chr1", 7, 8)], "chrom string, start long, end long")
    sinks.write_bed(spans, str(tmp_path / "b"), "n", "#010203")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "b")).collect()] == ['track name="n" itemRgb="On" color=1,2,3', "chr1\t7\t8\tn\t0\t.", "chr2\t5\t9\tn\t0\t."]
    assert sinks.write_concept_bed(spans, str(tmp_path / "c"), "n") == 2
    sinks.write_csv(spans, str(tmp_path / "t"))
    assert an.read_results(spark, str(tmp_path / "t")).count() == 2
    sinks.write_json({"a": 1}, str(tmp_path / "j"))
    assert json.load(open(tmp_path / "j")) == {"a": 1}
    with pytest.raises(ValueError):
        sinks.write_json({"a": float("nan")}, str(tmp_path / "j"))
    with pytest.raises(ValueError):
        sinks.write_matrix(np.array([np.inf]), str(tmp_path / "m"))
    sinks.write_matrix(np.eye(2), str(tmp_path / "m"))
    assert np.load(tmp_path / "m").sum() == 2 and json.load(open(tmp_path / "j")) == {"a": 1}
    with pytest.raises(ValueError):
        sinks.igv_session("g", "l", [sinks.igv_track("a", "u"), sinks.igv_track("a", "v")])


def test_empty_sources_fail(spark, tmp_path):
    (tmp_path / "e.bed").write_text("")
    with pytest.raises(ValueError, match="folds"):
        an.read_folds(spark, str(tmp_path / "e.bed"))
    exons = an.read_gtf(spark, gtf(tmp_path), ["exon"])
    with pytest.raises(ValueError, match="records"):
        an.read_gtf(spark, gtf(tmp_path), ["gene"])
    with pytest.raises(ValueError, match="introns"):
        an.splice_sites(an.first_exons(exons), "donor", 5)
    assert an.first_exons(exons).count() == 2
    (tmp_path / "s.json").write_text('{"assembly": "GRCh38", "sources": {"a": {}}}')
    assert an.read_sources(str(tmp_path / "s.json"), {"a"}) == {"a": {}}
    for known, assembly in ((set(), "GRCh38"), ({"a"}, "hg19")):
        with pytest.raises(ValueError):
            an.read_sources(str(tmp_path / "s.json"), known, assembly)
    (tmp_path / "x").write_bytes(b"abc")
    an.check_files(spark, str(tmp_path / "x"), {"x": "900150983cd24fb0d6963f7d28e17f72"})
    with pytest.raises(ValueError, match="x"):
        an.check_files(spark, str(tmp_path / "x"), {"x": "0" * 32})
