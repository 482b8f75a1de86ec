"""Command line.

python -m quillon --list
python -m quillon NAME SF_DIR OUT
    one query, its result as Parquet
python -m quillon panel --panel JSON --out DIR [--source NAME=PATH ...] [--chrom-sizes TSV] [--exclude BED] [--only NAME ...] [--skip-md5]
    a concept panel from its files
python -m quillon windows --folds BED --valid FOLD --test FOLD --out DIR [--exclude BED] [--context N] [--target N] [--held-out SPLIT=N ...] [--trained SPLIT=N ...]
    a window manifest
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from quillon.plans.cohorts import QUERIES
from quillon.sources import panel_files


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _pairs(values: list[str]) -> dict[str, str]:
    return dict(v.split("=", 1) for v in values)


def panel(args: list[str]) -> int:
    p = argparse.ArgumentParser("quillon panel")
    p.add_argument("--panel", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--source", action="append", default=[])
    p.add_argument("--chrom-sizes")
    p.add_argument("--exclude")
    p.add_argument("--only", nargs="+")
    p.add_argument("--skip-md5", action="store_true")
    a = p.parse_args(args)
    spark, paths = _session(), _pairs(a.source)
    with open(a.panel) as source:
        spec = json.load(source)
    print(json.dumps(panel_files.verify_sources(spark, spec, paths, strict=not a.skip_md5), indent=1))
    for r in panel_files.build_from_files(spark, spec, paths, a.out, a.chrom_sizes, a.exclude, a.only).collect():
        print(f"{r['concept']}\t{r['role']}\t{r['n']}\t{r['bases']}")
    return 0


def windows(args: list[str]) -> int:
    p = argparse.ArgumentParser("quillon windows")
    for name in ("--folds", "--valid", "--test", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--exclude")
    p.add_argument("--context", type=int, default=1_048_576)
    p.add_argument("--target", type=int, default=131_072)
    p.add_argument("--held-out", action="append", default=[])
    p.add_argument("--trained", action="append", default=[])
    a = p.parse_args(args)
    counts = {k: {s: int(n) for s, n in _pairs(v).items()} for k, v in (("held_out", a.held_out or ["test=0"]), ("trained", a.trained or ["train=0"]))}
    found = panel_files.windows_from_files(_session(), a.folds, a.valid, a.test, a.context, a.target, counts, a.exclude)
    found.write.mode("overwrite").parquet(a.out)
    return 0


def main(args: list[str]) -> int:
    if args == ["--list"]:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args and args[0] in ("panel", "windows"):
        return {"panel": panel, "windows": windows}[args[0]](args[1:])
    if len(args) != 3 or args[0] not in QUERIES:
        print(__doc__, file=sys.stderr)
        return 2
    QUERIES[args[0]](_session(), args[1]).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
