"""Interval algebra on frames (chrom, start, end): 0-based, half-open.

All operators keep to one partitioning, by chrom, so that a chain of them
shuffles once. Orders within a chrom come from window functions, never from
collected groups. Where a chrom holds too much for one task, cell splits the
order: each cell is summed up, the sums are carried over from cell to cell (one
row for each), and then every cell is ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.orders import same

BEFORE = (Window.unboundedPreceding, -1)


def checked(frame: DataFrame) -> DataFrame:
    """frame, which fails when a row has end <= start (on use)."""
    bad = F.concat(F.lit("end <= start: "), F.col("start").cast("string"), F.lit(", "), F.col("end").cast("string"))
    return frame.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.raise_error(bad).cast("long")))


def scan(frame: DataFrame, keys: tuple[str, ...], pos: str, into: dict[str, tuple[str, str]], cell: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """frame with running values in the order of pos and ties within keys.

    into: name to (what, column), where what is sum or max (with the own row),
    sum_before or max_before (without it; null at first), lag or lead (of the
    row before or after). cell: width of the parts of pos that are ordered
    apart; lagging and leading columns are not null then.
    """
    order, parts = [pos, *ties], [*keys, *(["__cell"] if cell else [])]
    own = Window.partitionBy(*parts).orderBy(*order)
    upto, before_ = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(*BEFORE)
    local = {
        "sum": lambda c: F.sum(c).over(upto),
        "max": lambda c: F.max(c).over(upto),
        "sum_before": lambda c: F.sum(c).over(before_),
        "max_before": lambda c: F.max(c).over(before_),
        "lag": lambda c: F.lag(c).over(own),
        "lead": lambda c: F.lead(c).over(own),
    }
    if not cell:
        return frame.withColumns({name: local[what](c) for name, (what, c) in into.items()})
    cut = frame.withColumn("__cell", F.floor(F.col(pos) / cell))
    at = F.struct(*order)
    whole = {"sum": F.sum, "max": F.max, "lag": lambda c: F.max_by(F.col(c), at), "lead": lambda c: F.min_by(F.col(c), at)}
    kind = {name: what.removesuffix("_before") for name, (what, _) in into.items()}
    sums = cut.groupBy(*parts).agg(*[whole[kind[name]](c).alias(f"__w_{name}") for name, (_, c) in into.items()])
    along = Window.partitionBy(*keys).orderBy("__cell")
    past = along.rowsBetween(*BEFORE)
    carry = {"sum": lambda c: F.sum(c).over(past), "max": lambda c: F.max(c).over(past), "lag": lambda c: F.lag(c).over(along), "lead": lambda c: F.lead(c).over(along)}
    carried = sums.select(*parts, *[carry[kind[name]](f"__w_{name}").alias(f"__c_{name}") for name in into])
    both = same(cut, carried, parts).withColumns({name: local[what](c) for name, (what, c) in into.items()})
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "lag": F.coalesce, "lead": F.coalesce}
    return both.withColumns({name: join[kind[name]](F.col(name), F.col(f"__c_{name}")) for name in into}).drop("__cell", *[f"__c_{name}" for name in into])


def islands(frame: DataFrame, keys: tuple[str, ...] = ("chrom",), gap: int = 0, cell: int | None = None) -> DataFrame:
    """frame with island: rows that overlap, abut or lie within gap of what came before share one."""
    reach = scan(frame, keys, "start", {"__reach": ("max_before", "end")}, cell, ("end",))
    new = (F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + gap)).cast("long")
    return scan(reach.withColumn("__new", new), keys, "start", {"island": ("sum", "__new")}, cell, ("end",)).drop("__reach", "__new")


def merge(frame: DataFrame, keys: tuple[str, ...] = ("chrom",), validate: bool = True, cell: int | None = None) -> DataFrame:
    """Union of overlapping or abutting intervals.

    cell: merge within cells of that width first, and order by cells, so that a
    key with a large share of the rows is spread over tasks.
    """
    frame = checked(frame) if validate else frame
    if cell is not None:
        cut = frame.withColumn("__cell", F.floor(F.col("start") / cell))
        frame = merge(cut, (*keys, "__cell"), validate=False).drop("__cell")
    found = islands(frame, keys, cell=cell).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return found.drop("island")


def span(frame: DataFrame) -> DataFrame:
    return frame.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("bases"))


def subtract(left: DataFrame, right: DataFrame, cell: int | None = None) -> DataFrame:
    """The parts of left that right doesn't cover: one sweep over both sides' ends. Each side is made once."""

    def steps(frame: DataFrame, l: int, r: int) -> DataFrame:  # noqa: E741
        of = lambda c, sign: F.struct(F.col(c).alias("pos"), F.lit(sign * l).alias("l"), F.lit(sign * r).alias("r"))
        return frame.select("chrom", F.inline(F.array(of("start", 1), of("end", -1))))

    ends = steps(left, 1, 0).union(steps(right, 0, 1))
    ends = ends.groupBy("chrom", "pos").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    depth = scan(ends, ("chrom",), "pos", {"end": ("lead", "pos"), "in_l": ("sum", "l"), "in_r": ("sum", "r")}, cell)
    pieces = depth.where("in_l > 0 AND in_r = 0 AND end IS NOT NULL").select("chrom", F.col("pos").alias("start"), "end")
    return merge(pieces, validate=False, cell=cell)


def pad(frame: DataFrame, margin: int) -> DataFrame:
    if margin < 0:
        raise ValueError("margin < 0")
    return merge(frame.select("chrom", F.greatest(F.col("start") - margin, F.lit(0)).alias("start"), (F.col("end") + margin).alias("end")))


def tile(frame: DataFrame, width: int) -> DataFrame:
    """Whole windows from each interval's start; the rest is dropped."""
    n = F.floor((F.col("end") - F.col("start")) / width)
    at = frame.where(n >= 1).select("chrom", F.explode(F.sequence(F.col("start"), F.col("start") + (n - 1) * width, F.lit(width))).alias("start"))
    return at.withColumn("end", F.col("start") + width)


def bin_grid(frame: DataFrame, width: int) -> DataFrame:
    """Bins of width over each interval, whose length width must divide."""
    rest = (F.col("end") - F.col("start")) % width
    stop = F.when(rest == 0, F.col("end") - width).otherwise(F.raise_error("width does not divide an interval").cast("long"))
    keep = [c for c in frame.columns if c not in ("start", "end")]
    bins = frame.select(*keep, F.explode(F.sequence(F.col("start"), stop, F.lit(width).cast("long"))).alias("bin_start"))
    return bins.withColumn("bin_end", F.col("bin_start") + width)


def label_bins(bins: DataFrame, intervals: DataFrame, into: str = "label", width: int = 3600) -> DataFrame:
    """bins (chrom, bin_start, bin_end, ...) with whether any interval overlaps.

    Both sides are cut into cells of width, on which they join; best where
    intervals span few cells. For long intervals use label_bins_sweep.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    cut = intervals.select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), cells(F.col("start"), F.col("end")).alias("__cell")).distinct()
    own = bins.select("chrom", "bin_start", "bin_end").distinct().select("*", cells(F.col("bin_start"), F.col("bin_end")).alias("__cell"))
    hit = (own["chrom"] == cut["__c"]) & (own["__cell"] == cut["__cell"]) & (cut["__s"] < own["bin_end"]) & (cut["__e"] > own["bin_start"])
    found = own.join(cut, hit, "left_semi").select("chrom", "bin_start", "bin_end").distinct().withColumn(into, F.lit(True))
    return bins.join(found, ["chrom", "bin_start", "bin_end"], "left").withColumn(into, F.coalesce(into, F.lit(False)))


def label_bins_sweep(bins: DataFrame, intervals: DataFrame, into: str = "label", cell: int | None = None) -> DataFrame:
    """As label_bins by one ordered pass: the farthest end among intervals that start before the bin ends."""
    own = bins.select("chrom", "bin_start", "bin_end").distinct().select("chrom", F.col("bin_end").alias("pos"), F.lit(0).alias("kind"), "bin_start", F.lit(None).cast("long").alias("reach"))
    starts = intervals.select("chrom", F.col("start").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("bin_start"), F.col("end").alias("reach"))
    swept = scan(own.unionByName(starts), ("chrom",), "pos", {"far": ("max_before", "reach")}, cell, ("kind",)).where("kind = 0")
    found = swept.select("chrom", "bin_start", F.col("pos").alias("bin_end"), F.coalesce(F.col("far") > F.col("bin_start"), F.lit(False)).alias(into))
    return bins.join(found, ["chrom", "bin_start", "bin_end"])


def as_of(bins: DataFrame, intervals: DataFrame, cell: int | None = None) -> DataFrame:
    """bins with last_start: the last start of an interval before the bin's end."""
    own = bins.select("chrom", F.col("bin_end").alias("pos"), F.lit(0).alias("kind"), "bin_start", F.lit(None).cast("long").alias("at"))
    starts = intervals.select("chrom", F.col("start").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("bin_start"), F.col("start").alias("at"))
    found = scan(own.unionByName(starts), ("chrom",), "pos", {"last_start": ("max_before", "at")}, cell, ("kind",))
    return found.where("kind = 0").select("chrom", "bin_start", F.col("pos").alias("bin_end"), "last_start")


def numbered_runs(bins: DataFrame, among: dict[str, Column], keys: tuple[str, ...] = ("chrom",), cell: int | None = None) -> DataFrame:
    """bins with a number for each name of among: that of its run among the bins that meet the condition; null for others.

    A run is cut where a bin doesn't begin at the end of the one before that meets
    the condition too. With cell, bins are read twice, however many names there
    are: once for the sums of cells, once to be numbered.
    """
    own = Window.partitionBy(*keys, *(["__cell"] if cell else [])).orderBy("bin_start")
    marked = bins.withColumns(({"__cell": F.floor(F.col("bin_start") / cell)} if cell else {}) | {f"__in_{name}": F.coalesce(one, F.lit(False)) for name, one in among.items()})
    known = {name: F.col(f"__in_{name}") for name in among}
    first = F.lit(0) if cell else F.lit(1)  # a cell's first one depends on the cells before it
    last = marked.withColumns({f"__last_{name}": F.last(F.when(one, F.col("bin_end")), ignorenulls=True).over(own.rowsBetween(*BEFORE)) for name, one in known.items()})
    new = {name: F.when(one, F.coalesce((F.col("bin_start") != F.col(f"__last_{name}")).cast("int"), first)) for name, one in known.items()}
    local = last.withColumns({name: F.sum(x).over(own.rowsBetween(Window.unboundedPreceding, 0)) for name, x in new.items()}).drop(*[f"__last_{name}" for name in among])
    if not cell:
        return local.withColumns({name: F.when(one, F.col(name)) for name, one in known.items()}).drop(*[f"__in_{name}" for name in among])
    parts, along = [*keys, "__cell"], Window.partitionBy(*keys).orderBy("__cell")
    at = {name: F.when(one, F.col("bin_start")) for name, one in known.items()}
    sums = local.groupBy(*parts).agg(*[x for name in among for x in (F.min(at[name]).alias(f"__a_{name}"), F.max_by("bin_end", at[name]).alias(f"__z_{name}"), F.coalesce(F.max(name), F.lit(0)).alias(f"__n_{name}"))])
    past = along.rowsBetween(*BEFORE)
    opens = sums.withColumns({f"__o_{name}": (F.col(f"__a_{name}").isNotNull() & ~F.col(f"__a_{name}").eqNullSafe(F.last(f"__z_{name}", ignorenulls=True).over(past))).cast("long") for name in among})
    carried = opens.select(*parts, *[(F.col(f"__o_{name}") + F.coalesce(F.sum(F.col(f"__n_{name}") + F.col(f"__o_{name}")).over(past), F.lit(0))).alias(f"__c_{name}") for name in among])
    both = same(local, carried, parts)
    return both.withColumns({name: F.when(one, F.col(name) + F.col(f"__c_{name}")) for name, one in known.items()}).drop("__cell", *[f"__{x}_{name}" for x in ("in", "c") for name in among])


def contiguous_runs(bins: DataFrame, keys: tuple[str, ...] = ("chrom",), cell: int | None = None) -> DataFrame:
    """bins with run, cut where a bin doesn't begin at the end of the one before."""
    return numbered_runs(bins, {"run": F.lit(True)}, keys, cell)


def domains(labelled: DataFrame, keys: tuple[str, ...] = ("chrom",), cell: int | None = None) -> DataFrame:
    """Runs of positive bins (label true): (keys, run, start, end, n_bins)."""
    runs = contiguous_runs(labelled.where("label"), keys, cell)
    return runs.groupBy(*keys, "run").agg(F.min("bin_start").alias("start"), F.max("bin_end").alias("end"), F.count("*").alias("n_bins"))


def domain_centres(labelled: DataFrame, keys: tuple[str, ...] = ("chrom",), cell: int | None = None) -> DataFrame:
    """The lower middle bin of each run of positive bins."""
    runs = contiguous_runs(labelled.where("label"), keys, cell).withColumn("__one", F.lit(1))
    numbered = scan(runs, keys, "bin_start", {"__i": ("sum", "__one")}, cell)
    middle = numbered.groupBy(*keys, "run").agg((F.min("__i") + F.floor((F.count("*") + 1) / 2) - 1).alias("__middle"))
    return same(numbered, middle, [*keys, "run"]).where("__i = __middle").select(*keys, "run", F.col("bin_start").alias("centre"))


def block_id(start: Column, width: int) -> Column:
    return F.floor(start / width)


def concept_domains(bins: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    return bins.groupBy(*keys).agg(F.min("bin_start").alias("low"), F.max("bin_end").alias("high"))


def circular_shift(spans: DataFrame) -> DataFrame:
    """spans (low, high, start, end, offset, ...) moved by offset within [low, high); a wrapped span becomes two."""
    length = F.col("high") - F.col("low")
    wide = F.least(F.col("end") - F.col("start"), length)
    begin = F.col("low") + F.pmod(F.col("start") - F.col("low") + F.col("offset"), length)
    whole = F.struct(begin.alias("start"), F.least(begin + wide, F.col("high")).alias("end"))
    over = F.struct(F.col("low").alias("start"), (F.col("low") + begin + wide - F.col("high")).alias("end"))
    keep = [c for c in spans.columns if c not in ("start", "end")]
    pieces = F.filter(F.array(whole, over), lambda p: p["end"] > p["start"])
    return spans.select(*keep, F.explode(pieces).alias("p")).select(*keep, "p.start", "p.end")


def introns(exons: DataFrame, key: str = "transcript") -> DataFrame:
    """Gaps between consecutive exons (key, start, end) of a transcript."""
    order = Window.partitionBy(key).orderBy("start", "end")
    gaps = exons.select(key, F.col("end").alias("start"), F.lead("start").over(order).alias("next"))
    return gaps.where("next > start").select(key, "start", F.col("next").alias("end"))


def bin_weights(intervals: DataFrame, width: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Covered bases of each bin: (keys, bin, bases)."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    parts = intervals.where("end > start").select(*keys, "start", "end", cells.alias("bin"))
    covered = F.least(F.col("end"), (F.col("bin") + 1) * width) - F.greatest(F.col("start"), F.col("bin") * width)
    return parts.groupBy(*keys, "bin").agg(F.sum(covered).cast("long").alias("bases"))


def map_to_grid(grid: DataFrame, bins: DataFrame, column: str) -> DataFrame:
    """grid with positive and observed: a bin that wasn't observed isn't negative."""
    seen = bins.select("chrom", "bin_start", F.col(column).alias("__value"), F.lit(True).alias("__seen"))
    return grid.join(seen, ["chrom", "bin_start"], "left").withColumn("positive", F.coalesce(F.col("__value"), F.lit(False))).withColumn("observed", F.col("__seen").isNotNull()).drop("__value", "__seen")


def first_containing(points: DataFrame, windows: DataFrame, margin: int, cell: int = 1 << 20) -> DataFrame:
    """For each point (chrom, pos, ...), the first window (chrom, start, end) that holds it at least margin from both ends.

    Windows less their margins are cut into cells of that width, on which they
    meet the points; best where cell is about a window's width.
    """
    low, high = F.col("start") + margin, F.col("end") - margin
    w = windows.where(high > low).select(F.col("chrom").alias("__c"), F.col("start").alias("win_start"), F.col("end").alias("win_end"), F.explode(F.sequence(F.floor(low / cell), F.floor((high - 1) / cell))).alias("__cell"))
    placed = points.withColumn("__at", F.floor(F.col("pos") / cell))
    inside = (placed["chrom"] == w["__c"]) & (placed["__at"] == w["__cell"]) & (placed["pos"] >= w["win_start"] + margin) & (placed["pos"] < w["win_end"] - margin)
    first = placed.join(w, inside).groupBy(*points.columns).agg(F.min(F.struct("win_start", "win_end")).alias("w"))
    return first.select(*points.columns, "w.win_start", "w.win_end")


def overlaps(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("chrom",), cell: int = 1 << 16) -> DataFrame:
    """Pairs of rows of left and right that overlap, each once; right's columns come with r_ before their names.

    An equi join on (on, cell): a pair is found in the cell where the later of
    the two begins, or in left's first cell.
    """
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))
    a = left.where("end > start").withColumn("__cell", cells())
    b = right.where("end > start").select(*[F.col(c).alias(f"r_{c}") for c in right.columns], cells().alias("__cell_r"))
    meet = F.col("__cell") == F.col("__cell_r")
    for c in on:
        meet = meet & (F.col(c) == F.col(f"r_{c}"))
    once = F.col("__cell") == F.floor(F.greatest(F.col("start"), F.col("r_start")) / cell)
    return a.join(b, meet & once & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))).drop("__cell", "__cell_r")


def largest_gap(gaps: DataFrame) -> DataFrame:
    """Per chrom the widest interval, the first of equals."""
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("width"), (-F.col("start")).alias("first"), F.col("end").alias("end"))).alias("g")
    return gaps.groupBy("chrom").agg(best).select("chrom", (-F.col("g.first")).alias("start"), F.col("g.end").alias("end"))


def territory(regions: DataFrame, valid: str, test: str, margin: int, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Held-out and trained intervals of folds (chrom, start, end, fold): held out is valid and test less the padded rest.

    Parts that are read several times are persisted.
    """
    own = ["chrom", "start", "end"]
    held = merge(regions.where(F.col("fold").isin(valid, test)).select(*own))
    train = merge(regions.where(~F.col("fold").isin(valid, test)).select(*own)).persist()
    held = subtract(held, pad(train, margin)).persist()
    trained = subtract(train, held)
    if exclude is not None:
        exclude = merge(exclude.select(*own)).persist()
        held, trained = subtract(held, exclude), subtract(trained, exclude)
    return held, trained


def shuffle_within(spans: DataFrame, seed: str) -> DataFrame:
    """Each span (chrom, low, high, start, end) at a place within [low, high) drawn by hash; too long ones are dropped."""
    from quillon.functions.scalar import draw

    room = F.col("high") - F.col("low") - (F.col("end") - F.col("start"))
    at = F.col("low") + F.pmod(draw(F.lit(seed), F.col("chrom"), F.col("start"), F.col("end")), room + 1)
    return spans.where(room >= 0).select("chrom", at.alias("start"), (at + F.col("end") - F.col("start")).alias("end"))


def shuffle_avoiding(spans: DataFrame, sizes: DataFrame, exclude: DataFrame, seed: str, strict: bool = True) -> DataFrame:
    """Each span (chrom, start, end) at a free place of its chrom (chrom, size), drawn by hash among all places.

    A place is free if no excluded interval (chrom, start, end) overlaps it. The
    places of each length are counted over the gaps between excluded parts, a
    draw is a place's number, and the last gap that begins at or before it has
    the place: no tries, and one order for gaps and draws together. Spans for
    which nothing is free, or whose chrom has no size, fail (strict) or have a
    null start. Result: chrom, old_start, old_end, start, end.
    """
    from quillon.functions.scalar import draw

    whole = sizes.where("size > 0").select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    free = subtract(whole, merge(exclude.select("chrom", F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("end > start"), validate=False))
    own = spans.select("chrom", F.col("start").cast("long").alias("old_start"), F.col("end").cast("long").alias("old_end"), (F.col("end") - F.col("start")).cast("long").alias("length"))
    lengths = own.select("chrom", "length").distinct()
    gaps = lengths.join(free, "chrom").withColumn("places", F.col("end") - F.col("start") - F.col("length") + 1).where("places > 0")
    order = Window.partitionBy("chrom", "length").orderBy("start")
    gaps = gaps.withColumn("first", F.coalesce(F.sum("places").over(order.rowsBetween(*BEFORE)), F.lit(0)))
    total = gaps.groupBy("chrom", "length").agg(F.sum("places").alias("total"))
    asked = own.join(total, ["chrom", "length"], "left").withColumn("at", F.pmod(draw(F.lit(seed), F.col("chrom"), F.col("old_start"), F.col("old_end")) * (1 << 20) + draw(F.lit(f"{seed}+"), F.col("chrom"), F.col("old_start"), F.col("old_end")), F.col("total")))
    none = F.lit(None).cast("long")
    both = gaps.select("chrom", "length", F.col("first").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("first"), F.col("start").alias("gap")).alias("g"), none.alias("old_start"), none.alias("old_end")).unionByName(
        asked.select("chrom", "length", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<first:long,gap:long>").alias("g"), "old_start", "old_end")
    )
    placed = both.withColumn("g", F.max("g").over(Window.partitionBy("chrom", "length").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    start = F.when(F.col("at").isNotNull(), F.col("g.gap") + F.col("at") - F.col("g.first"))
    if strict:
        start = F.coalesce(start, F.raise_error(F.concat(F.lit("no free place on "), F.col("chrom"))).cast("long"))
    return placed.select("chrom", "old_start", "old_end", start.alias("start"), (start + F.col("length")).alias("end"))


def n_runs(sequences: DataFrame, least: int, letter: str = "N") -> DataFrame:
    """Runs of a letter of at least `least` in sequences (chrom, offset, sequence), joined across pieces.

    Shorter ones leave the text only where they touch a piece's end.
    """
    wanted = f"(?i:{letter}{{{least},}}|\\A{letter}+|{letter}+\\z)"
    parts = F.split("sequence", wanted, -1)
    found = F.regexp_extract_all("sequence", F.lit(f"({wanted})"), 1)
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    sizes = F.transform(F.arrays_zip(parts.alias("gap"), found.alias("run")), lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["run"]).alias("run")))
    piece = sequences.where(F.regexp_like("sequence", F.lit(wanted))).select("chrom", "offset", F.posexplode(sizes).alias("i", "s")).select("chrom", "offset", "i", "s.gap", "s.run")
    upto = Window.partitionBy("chrom", "offset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("offset") + F.sum(F.col("gap") + F.col("run")).over(upto)
    placed = piece.withColumn("end", end).where("run > 0").select("chrom", (F.col("end") - F.col("run")).alias("start"), "end")
    return merge(placed, validate=False).where(F.col("end") - F.col("start") >= least)
