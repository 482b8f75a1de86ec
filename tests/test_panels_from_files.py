"""A panel built from files by all six derivations, windows from folds, and enrichment against plain Python."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main
from quillon.functions.sequence import gc_quantile_bins
from quillon.operators import enrichment, panels
from quillon.sources import panel_files


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "c.bed").write_text("".join(f"chr1\t{a}\t{b}\tx\t{c}\n" for a, b, c in ((100, 200, "PLS,CTCF"), (150, 260, "PLS"), (500, 600, "dELS"), (900, 950, "CTCF"))))
    gtf = [("transcript", 101, 400, "+"), ("exon", 101, 150, "+"), ("exon", 301, 400, "+"), ("transcript", 701, 900, "-"), ("exon", 701, 750, "-"), ("exon", 851, 900, "-")]
    (tmp_path / "g.gtf").write_text("".join(f'chr1\ts\t{k}\t{a}\t{b}\t.\t{s}\t.\tgene_id "g{s}"; transcript_id "t{s}";\n' for k, a, b, s in gtf))
    rng = random.Random(4)
    sequence = "".join(rng.choice("GC" if i // 100 % 5 == 2 else "ACGT") for i in range(2000))
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(sequence[i : i + 60] for i in range(0, 2000, 60)) + "\n")
    (tmp_path / "sizes.tsv").write_text("chr1\t2000\n")
    (tmp_path / "gaps.bed").write_text("chr1\t0\t50\nchr1\t1500\t2000\n")
    concepts = [
        ("PLS", "primary", {"kind": "ccre_class", "source": "bed", "label": "PLS"}),
        ("any", "contextual", {"kind": "ccre_union", "source": "bed"}),
        ("donor", "local", {"kind": "gencode_splice", "source": "gtf", "site": "donor", "flank_bp": 3}),
        ("tss", "primary", {"kind": "gencode_tss_window", "source": "gtf", "window_bp": 10}),
        ("rich", "contextual", {"kind": "gc_quantile", "source": "fasta", "quantile": 0.9}),
        ("shuffled_PLS", "negative_control", {"kind": "shuffle_of", "concept": "PLS", "seed": 5}),
    ]
    digest = lambda name: hashlib.md5((tmp_path / name).read_bytes()).hexdigest()
    panel = {"bin_bp": 100, "sources": {"bed": {"md5": digest("c.bed"), "class_column_0based": 4}, "gtf": {"md5": digest("g.gtf")}, "fasta": {"md5": digest("g.fa")}}, "concepts": [{"name": n, "role": r, "derivation": d} for n, r, d in concepts]}
    (tmp_path / "panel.json").write_text(json.dumps(panel))
    return tmp_path, panel, {k: str(tmp_path / f) for k, f in (("bed", "c.bed"), ("gtf", "g.gtf"), ("fasta", "g.fa"))}, sequence


def test_all_six_derivations(spark, sources):
    folder, panel, paths, sequence = sources
    out = str(folder / "out")
    summary = {r["concept"]: (r["role"], r["n"], r["bases"]) for r in panel_files.build_from_files(spark, panel, paths, out, str(folder / "sizes.tsv"), str(folder / "gaps.bed")).collect()}
    got = {}
    for r in panel_files.read_panel(spark, out).orderBy("start").collect():
        got.setdefault(r["concept"], []).append((r["start"], r["end"]))
    assert got["PLS"] == [(100, 260)] and got["any"] == [(100, 260), (500, 600), (900, 950)]
    assert got["donor"] == [(147, 153), (847, 853)] and got["tss"] == [(90, 111), (889, 910)]
    share = [sum(c in "GC" for c in sequence[i : i + 100]) / 100 for i in range(0, 2000, 100)]
    edge = float(np.quantile(share, 0.9))
    want = []
    for i, x in enumerate(share):
        if x >= edge:
            if want and want[-1][1] == i * 100:
                want[-1] = (want[-1][0], i * 100 + 100)
            else:
                want.append((i * 100, i * 100 + 100))
    assert got["rich"] == want
    (a, b), = got["shuffled_PLS"]
    assert b - a == 160 and 50 <= a and b <= 1500
    assert summary["PLS"] == ("primary", 1, 160) and len(summary) == 6
    assert sum(1 for _ in (folder / "out" / "any.bed").glob("part*")) == 1


def test_faults_of_a_panel(spark, sources):
    folder, panel, paths, _ = sources
    assert panel_files.verify_sources(spark, panel, {"bed": paths["bed"]}) == {"bed": "ok", "gtf": "not supplied", "fasta": "not supplied"}
    with pytest.raises(ValueError, match="mismatch"):
        panel_files.verify_sources(spark, panel, {"gtf": paths["bed"]})
    with pytest.raises(ValueError, match="unknown concepts"):
        panel_files.build_from_files(spark, panel, paths, str(folder / "x"), only=["none"])
    with pytest.raises(ValueError, match="not built"):
        panel_files.build_from_files(spark, panel, paths, str(folder / "y"), only=["shuffled_PLS"])
    left = panel_files.build_from_files(spark, panel, {"gtf": paths["gtf"]}, str(folder / "z"), only=["donor", "PLS"])
    assert [r["concept"] for r in left.collect()] == ["donor"]


def test_command_line_builds_panels_and_windows(spark, sources, capsys):
    folder, panel, paths, _ = sources
    args = ["panel", "--panel", str(folder / "panel.json"), "--out", str(folder / "cli"), "--source", f"bed={paths['bed']}", "--only", "PLS", "any"]
    assert main(args) == 0 and "PLS\tprimary\t1\t160" in capsys.readouterr().out
    (folder / "folds.bed").write_text("".join(f"chr1\t{i * 1000}\t{i * 1000 + 1000}\tfold{i % 8}\n" for i in range(40)))
    args = ["windows", "--folds", str(folder / "folds.bed"), "--valid", "fold3", "--test", "fold4", "--out", str(folder / "w"), "--context", "200", "--target", "100", "--held-out", "test=3", "--held-out", "dev=0", "--trained", "train=0"]
    assert main(args) == 0
    found = spark.read.parquet(str(folder / "w")).collect()
    splits = {s: [r for r in found if r["split"] == s] for s in ("test", "dev", "train")}
    assert len(splits["test"]) == 3 and splits["dev"] and splits["train"]
    assert all(r["win_end"] - r["win_start"] == 200 for r in found)
    assert all(3 <= r["win_start"] // 1000 % 8 <= 4 for s in ("test", "dev") for r in splits[s])
    assert main(["--list"]) == 0 and len(capsys.readouterr().out.split()) > 140
    assert main(["nothing"]) == 2


@pytest.mark.parametrize("quantile", [0.1, 0.5, 0.75, 0.9])
def test_gc_quantile_equals_numpy(spark, quantile):
    rng = random.Random(7)
    texts = {c: "".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(n)) for c, n in (("a", 3000), ("b", 95), ("c", 640))}
    chunks = spark.createDataFrame([(c, i, t[i : i + 160]) for c, t in texts.items() for i in range(0, len(t), 160)], "chrom string, start long, bases string")
    got = {c: set() for c in texts}
    for r in gc_quantile_bins(chunks, 16, quantile, 10).collect():
        got[r["chrom"]] |= set(range(r["start"] // 16, r["end"] // 16))
    for c, t in texts.items():
        share = {i: (t[i * 16 : i * 16 + 16].count("G") + t[i * 16 : i * 16 + 16].count("C")) / 16 for i in range(len(t) // 16) if set(t[i * 16 : i * 16 + 16]) <= set("ACGT")}
        edge = float(np.quantile(list(share.values()), quantile)) if len(share) >= 10 else math.inf
        assert got[c] == {i for i, x in share.items() if x >= edge}


def test_enrichment_equals_plain_kernels(spark):
    rng = random.Random(9)
    bins = []
    for chrom in "ab":
        for i in range(120):
            if rng.random() > 0.08:  # gaps cut runs
                bins.append((chrom, i * 10, i * 10 + 10, rng.random() < 0.25, None if rng.random() < 0.03 else rng.random()))
    frame = spark.createDataFrame(bins, "chrom string, bin_start long, bin_end long, label boolean, score double")
    for cell in (None, 70):
        got = {r["block"]: r for r in enrichment.event_blocks(frame, 10, 300, 1.5, 2, cell).collect()}
        own = {(c, s): (lab, v) for c, s, _, lab, v in bins if v is not None}
        events, reached = {}, set()
        for c, s in own:
            if own[c, s][0] and not ((c, s - 10) in own and own[c, s - 10][0]):
                run = [s]
                while (c, run[-1] + 10) in own and own[c, run[-1] + 10][0]:
                    run.append(run[-1] + 10)
                centre = run[(len(run) + 1) // 2 - 1]
                near = [centre]
                for step in (-10, 10):
                    at = centre + step
                    while (c, at) in own and abs(at - centre) <= 20:
                        near.append(at)
                        at += step
                w = [math.exp(-(((x - centre) / 15) ** 2) / 2) for x in near]
                events.setdefault(centre // 300, []).append(sum(a * own[c, x][1] for a, x in zip(w, near, strict=True)) / sum(w))
                reached |= {(c, x) for x in near}
        outside = {}
        for (c, s), (lab, v) in own.items():
            if not lab and (c, s) not in reached:
                outside.setdefault(s // 300, []).append(v)
        assert set(got) == set(events) | set(outside)
        for b, r in got.items():
            assert (r["en"], r["bn"]) == (len(events.get(b, [])), len(outside.get(b, [])))
            assert r["es"] == pytest.approx(sum(events.get(b, []))) and r["bs"] == pytest.approx(sum(outside.get(b, [])))
    row = enrichment.log_enrichment(enrichment.event_blocks(frame, 10, 300), draws=200).first()
    assert row["low"] <= row["log_enrichment"] <= row["high"] and row["n_draws"] == 200
    none = enrichment.log_enrichment(enrichment.event_blocks(frame.withColumn("label", F.lit(False)), 10, 300), draws=20).first()
    assert none["log_enrichment"] is None and none["n_draws"] == 0


def test_consensus_names_tracks_and_grids(spark):
    marked = spark.createDataFrame([(1, "K4", "x"), (1, "K4", "y"), (1, "K4", "y"), (2, "K4", "x"), (3, "black", "-")], "bin int, mark string, cell string")
    got = {(r["bin"], r["mark"]): (r["cells"], r["consensus"]) for r in panels.consensus(marked, ("bin",), 2).collect()}
    assert got == {(1, "K4"): (2, True), (2, "K4"): (1, False), (3, "black"): (1, True)}
    panels.consensus(marked, ("bin",), 2, strict=True)
    with pytest.raises(ValueError, match="K4: 2 files can't meet 3"):
        panels.consensus(marked, ("bin",), 3, strict=True)

    own = spark.createDataFrame([("1", 0), ("M", 1), ("chr2", 2), ("9", 3)], "chrom string, start int")
    bins = lambda *names: spark.createDataFrame([(n,) for n in names] or [], "chrom string")
    aligned = lambda *names: sorted((r["chrom"], r["start"]) for r in panels.align_chroms(own, bins(*names)).collect())
    assert aligned("chr1", "chr2", "chrM") == [("chr1", 0), ("chr2", 2), ("chrM", 1)]
    assert aligned("1", "2", "MT") == [("1", 0), ("2", 2), ("MT", 1)]
    for names, what in (((), "no chromosomes"), (("1", "chr2"), "mix")):
        with pytest.raises(ValueError, match=what):
            panels.align_chroms(own, bins(*names))

    rows = [("rna", 0, "a", "b1", "total RNA-seq", "+", False), ("rna", 1, "b", "b1", "polyA", "+", False), ("rna", 2, "c", "b2", "total RNA-seq", "-", False), ("cage", 3, "d", "b2", "CAGE", "+", None), ("cage", 4, "e", "b2", "CAGE", "+", True)]
    tracks = spark.createDataFrame(rows, "output string, index int, name string, biosample string, assay string, strand string, modified boolean")
    assert sorted(r["index"] for r in panels.select_tracks(tracks, "+", {"rna": "total RNA-seq", "cage": None}).collect()) == [0, 3]
    with pytest.raises(ValueError, match="cage"):
        panels.select_tracks(tracks, "-", {"rna": None, "cage": None})
    grid = spark.createDataFrame([(t, s) for t in "ab" for s in (0, 1, 1)], "tap string, seed int")
    assert sorted(map(tuple, panels.unfinished(grid, grid.where("tap = 'a' AND seed = 1"), ("tap", "seed")).collect())) == [("a", 0), ("b", 0), ("b", 1)]


def test_roles_by_name(spark):
    from quillon.operators.reports import role

    rows = [("cCRE_pELS", 0.01, "exploratory"), ("K562_CTCF", 0.01, "exploratory"), ("H1_x", 0.0001, "exploratory"), ("H1x", 0.01, "confirmatory"), ("shuffled_PLS", 0.5, "negative_control")]
    frame = spark.createDataFrame(rows, "c string, p double, want string")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", role(F.col("c"), F.col("p"))).collect())
