"""One query for each operator, over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import scalar, sequence
from quillon.operators import controls, enrichment, inference, intervals, panels, ranks, reports, vectors
from quillon.plans.stand_ins import CHANNELS, CODES, EV, HOURS, ONE_HOT, SEQ, WIDTH, channels, codes, draw_sql, hours, merged_sql, one_hot, sequences, spans, subtracted_sql, table, weights
from quillon.sources import receipts

#: Two weeks: the parts of a chrom's seconds that are ordered apart.
CELL = 14 * 86400

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(F.col(c), digits) for c in columns})


RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM ch)"
DENSE = f"WITH {CHANNELS}, {ONE_HOT}, {RANKED}, sums AS (SELECT feature, concept, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS q, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM rk JOIN lab USING (id) GROUP BY feature, concept), au AS (SELECT feature, concept, p, q, (rs - p * (p + 1) / 2) / (p * q) AS a FROM sums WHERE p > 0 AND q > 0)"


@query(
    DENSE
    + """, best AS (SELECT concept, feature, a, greatest(a, 1 - a) AS f, row_number() OVER (PARTITION BY concept ORDER BY greatest(a, 1 - a) DESC, feature) AS r FROM au),
prev AS (SELECT concept, avg(y) AS prevalence, CAST(sum(y) AS BIGINT) AS n_pos FROM lab GROUP BY concept)
SELECT concept, feature AS best_feature, round(f, 6) AS best_auroc, round(a, 6) AS raw_auroc, a < 0.5 AS inverse, n_pos, round(prevalence, 6) AS prevalence FROM best JOIN prev USING (concept) WHERE r = 1"""
)
def auroc_dense_best_channel(spark: SparkSession, sf: str) -> DataFrame:
    labels = one_hot(spark, sf)
    best = ranks.best_feature(ranks.auroc_dense(channels(spark, sf), labels))
    prevalence = labels.groupBy("concept").agg(F.sum("y").cast("long").alias("n_pos"), F.avg("y").alias("prevalence"))
    return rounded(best.join(prevalence, "concept"), "best_auroc", "raw_auroc", "prevalence").select("concept", "best_feature", "best_auroc", "raw_auroc", "inverse", "n_pos", "prevalence")


@query(DENSE + " SELECT feature, concept, CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg, round(a, 6) AS auroc FROM au")
def auroc_dense_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranks.auroc_dense(channels(spark, sf), one_hot(spark, sf)), "auroc")


@query(f"WITH {CHANNELS}, {CODES} SELECT id, feature, round(CAST(value AS DOUBLE), 6) AS value FROM codes")
def topk_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes(spark, sf).withColumn("value", F.round(F.col("value").cast("double"), 6))


SPARSE = f"""WITH {CHANNELS}, {CODES}, {ONE_HOT}, tot AS (SELECT concept, CAST(sum(y) AS DOUBLE) AS np, CAST(count(*) - sum(y) AS DOUBLE) AS nn FROM lab GROUP BY concept),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM codes),
s AS (SELECT feature, concept, CAST(sum(y) AS DOUBLE) AS a, CAST(sum(1 - y) AS DOUBLE) AS b, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs FROM rk JOIN lab USING (id) GROUP BY feature, concept),
f AS (SELECT CAST(i AS INTEGER) AS feature, tot.concept, np, nn, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(rs, 0) AS rs FROM range(0, 64) r(i) CROSS JOIN tot LEFT JOIN s ON s.feature = i AND s.concept = tot.concept),
au AS (SELECT feature, concept, a, b, np, nn, (a * (nn - b) + 0.5 * (np - a) * (nn - b) + rs - a * (a + 1) / 2) / (np * nn) AS auroc FROM f WHERE np > 0 AND nn > 0)"""


def _sparse(spark: SparkSession, sf: str) -> DataFrame:
    dictionary = spark.range(64).select(F.col("id").cast("int").alias("feature"))
    return ranks.auroc_sparse(codes(spark, sf), one_hot(spark, sf), dictionary)


@query(SPARSE + " SELECT feature, concept, CAST(a + b AS BIGINT) AS n_fired, round(auroc, 6) AS auroc FROM au")
def auroc_sparse_all_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sparse(spark, sf), "auroc")


@query(
    SPARSE
    + """, t AS (SELECT *, (a + b) / (np + nn) AS firing, CASE WHEN auroc >= 0.5 THEN np / (np + nn) ELSE nn / (np + nn) END AS mass FROM au),
c AS (SELECT *, least(1.0, 0.5 + firing / (2 * mass)) AS ceiling FROM t)
SELECT feature, concept, round(firing, 6) AS firing, round(ceiling, 6) AS ceiling, round(CASE WHEN ceiling > 0.5 THEN (greatest(auroc, 1 - auroc) - 0.5) / (ceiling - 0.5) END, 6) AS captured, greatest(auroc, 1 - auroc) >= 0.7 AS recovered FROM c"""
)
def auroc_sparse_ceiling_captured(spark: SparkSession, sf: str) -> DataFrame:
    totals = one_hot(spark, sf).groupBy("concept").agg(F.avg("y").alias("prevalence"), F.count("*").alias("n"))
    joined = _sparse(spark, sf).join(totals, "concept").withColumn("firing", F.col("n_fired") / F.col("n"))
    sign = F.when(F.col("auroc") >= 0.5, 1).otherwise(-1)
    joined = joined.withColumn("ceiling", scalar.auroc_ceiling(F.col("prevalence"), F.col("firing"), sign)).withColumn("best", scalar.directed(F.col("auroc")))
    captured = F.when(F.col("ceiling") > 0.5, (F.col("best") - 0.5) / (F.col("ceiling") - 0.5))
    return rounded(joined.select("feature", "concept", "firing", "ceiling", captured.alias("captured"), (F.col("best") >= 0.7).alias("recovered")), "firing", "ceiling", "captured")


@query(
    f"""WITH {CHANNELS}, {ONE_HOT}, g AS (SELECT feature, concept, value, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM ch JOIN lab USING (id) GROUP BY ALL),
c AS (SELECT feature, concept, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY feature, concept) AS al FROM g WINDOW w AS (PARTITION BY feature, concept ORDER BY value DESC ROWS UNBOUNDED PRECEDING))
SELECT feature, concept, round(sum(CASE WHEN al > 0 THEN p / al * tp / seen END), 6) AS ap FROM c GROUP BY feature, concept"""
)
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranks.average_precision_dense(channels(spark, sf), one_hot(spark, sf)), "ap")


@query(
    """WITH r AS (SELECT value, CAST(event_type = 'purchase' AS INTEGER) AS y, hour(ts) // 6 AS stratum FROM events),
k AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY CAST(value AS FLOAT)) + (count(*) OVER (PARTITION BY stratum, CAST(value AS FLOAT)) - 1) / 2.0 AS rk, rank() OVER (ORDER BY CAST(value AS FLOAT)) + (count(*) OVER (PARTITION BY CAST(value AS FLOAT)) - 1) / 2.0 AS rka FROM r),
s AS (SELECT stratum, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q, sum(CASE WHEN y = 1 THEN rk END) AS rs FROM k GROUP BY stratum),
a AS (SELECT CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q, sum(CASE WHEN y = 1 THEN rka END) AS rs FROM k)
SELECT round((SELECT (rs - p * (p + 1) / 2) / (p * q) FROM a), 6) AS unadjusted, round(sum(CASE WHEN p >= 10 AND q >= 10 THEN rs - p * (p + 1) / 2 END) / sum(CASE WHEN p >= 10 AND q >= 10 THEN p * q END), 6) AS adjusted, CAST(sum(CASE WHEN p >= 10 AND q >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS used, CAST(sum(CASE WHEN p >= 10 AND q >= 10 THEN 0 ELSE 1 END) AS BIGINT) AS skipped FROM s"""
)
def stratified_auroc(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("value", (F.col("event_type") == "purchase").cast("int").alias("y"), F.floor(F.hour("ts") / 6).alias("stratum"))
    return rounded(ranks.stratified_auroc(rows), "unadjusted", "adjusted")


@query(
    f"""WITH {CHANNELS}, {CODES}, j AS (SELECT ch.feature, CAST(ch.value AS DOUBLE) AS v, CAST(codes.value AS DOUBLE) AS k FROM ch LEFT JOIN codes USING (id, feature)),
p AS (SELECT feature, sum((v - coalesce(k, 0)) ** 2) AS err, sum(v * v) AS sq, sum(v) AS s, count(*) AS n, count(k) AS fired FROM j GROUP BY feature)
SELECT round(sum(err) / sum(sq - s * s / n), 6) AS fvu, round(sum(err) / sum(n), 6) AS mse, round(CAST(sum(fired) AS DOUBLE) / max(n), 6) AS mean_l0, CAST(sum(CAST(fired > 0 AS INTEGER)) AS BIGINT) AS used, round(sum(CAST(fired > 0 AS INTEGER)) / 64.0, 6) AS dictionary_use FROM p"""
)
def fvu_l0_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.reconstruction(channels(spark, sf), codes(spark, sf), 64), "fvu", "mse", "mean_l0", "dictionary_use")


@query(f"WITH {CHANNELS} SELECT feature, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(var_pop(CAST(value AS DOUBLE)) * count(*), 6) AS m2 FROM ch GROUP BY feature")
def channel_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.channel_moments(channels(spark, sf)), "mean", "m2")


@query(f"WITH {CHANNELS} SELECT feature, round(CASE WHEN max(value) > 1e-8 THEN max(CAST(value AS DOUBLE)) WHEN max(abs(value)) > 1e-8 THEN max(abs(CAST(value AS DOUBLE))) ELSE 1.0 END, 6) AS scale FROM ch GROUP BY feature")
def channel_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vectors.channel_scale(channels(spark, sf)), "scale")


@query(f'WITH {EV}, {merged_sql("ev", "m")} SELECT chrom, s AS "start", e AS "end" FROM m')
def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge(spans(spark, sf))


@query(f"WITH {EV}, {merged_sql('ev', 'm')} SELECT CAST(sum(e - s) AS BIGINT) AS bases FROM m")
def interval_span(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.span(intervals.merge(spans(spark, sf)))


CLICKS = "cl AS (SELECT * FROM ev WHERE concept = 'click'), pu AS (SELECT * FROM ev WHERE concept <> 'click')"


@query(f'WITH {EV}, {CLICKS}, {merged_sql("cl", "a")}, {merged_sql("pu", "b")}, {subtracted_sql("a", "b", "d")} SELECT chrom, s AS "start", e AS "end" FROM d')
def interval_subtract(spark: SparkSession, sf: str) -> DataFrame:
    ev = spans(spark, sf)
    own, other = (intervals.merge(ev.where(f"concept {op} 'click'"), cell=CELL) for op in ("=", "<>"))
    return intervals.subtract(own, other, CELL)


@query(f'WITH {EV}, p AS (SELECT chrom, greatest(s - 600, 0) AS s, e + 600 AS e FROM ev), {merged_sql("p", "m")} SELECT chrom, s AS "start", e AS "end" FROM m')
def interval_pad(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.pad(spans(spark, sf), 600)


@query(f'WITH {EV}, {merged_sql("ev", "m")}, t AS (SELECT chrom, unnest(range(s, s + (e - s) // 700 * 700, 700)) AS s FROM m) SELECT chrom, s AS "start", s + 700 AS "end" FROM t')
def interval_tile(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.tile(intervals.merge(spans(spark, sf)), 700)


@query(f"WITH {EV}, {HOURS}, d AS (SELECT chrom, min(b) AS lo, max(be) AS hi FROM hours GROUP BY chrom), g AS (SELECT chrom, unnest(range(lo, hi, 3600)) AS b FROM d) SELECT chrom, b AS bin_start, b + 3600 AS bin_end FROM g")
def bin_grid_expand(spark: SparkSession, sf: str) -> DataFrame:
    domain = intervals.concept_domains(hours(spark, sf)).select("chrom", F.col("low").alias("start"), F.col("high").alias("end"))
    return intervals.bin_grid(domain, WIDTH)


LABELLED = f"WITH {EV}, {HOURS}, l AS (SELECT chrom, b, be, EXISTS (SELECT 1 FROM ev WHERE ev.chrom = hours.chrom AND concept = 'purchase' AND ev.s < be AND ev.e > b) AS label FROM hours)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.label_bins(hours(spark, sf), spans(spark, sf).where("concept = 'purchase'"), width=WIDTH)


@query(LABELLED + " SELECT chrom, b AS bin_start, be AS bin_end, label FROM l")
def label_bins_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf)


@query(LABELLED + " SELECT chrom, b AS bin_start, be AS bin_end, label FROM l")
def label_bins_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.label_bins_sweep(hours(spark, sf), spans(spark, sf).where("concept = 'purchase'"), cell=CELL)


@query(f"WITH {EV}, {HOURS} SELECT chrom, b AS bin_start, be AS bin_end, (SELECT max(s) FROM ev WHERE ev.chrom = hours.chrom AND concept = 'purchase' AND s < be) AS last_start FROM hours")
def as_of_join(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.as_of(hours(spark, sf), spans(spark, sf).where("concept = 'purchase'"), CELL)


RUNS = f"WITH {EV}, {HOURS}, g AS (SELECT *, coalesce(CAST(b <> lag(be) OVER (PARTITION BY chrom ORDER BY b) AS INTEGER), 1) AS new FROM hours), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g)"


@query(RUNS + " SELECT chrom, b AS bin_start, be AS bin_end, run FROM r")
def contiguous_runs(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.contiguous_runs(hours(spark, sf), cell=CELL)


@query(f"WITH {EV}, {HOURS} SELECT chrom, b // 86400 AS block, count(*) AS n_bins FROM hours GROUP BY ALL")
def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    return hours(spark, sf).groupBy("chrom", intervals.block_id(F.col("bin_start"), 86400).alias("block")).agg(F.count("*").alias("n_bins"))


CENTRES = LABELLED + ", g AS (SELECT *, coalesce(CAST(b <> lag(be) OVER (PARTITION BY chrom ORDER BY b) AS INTEGER), 1) AS new FROM l WHERE label), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY chrom ORDER BY b ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g), c AS (SELECT *, count(*) OVER (PARTITION BY chrom, run) AS n, row_number() OVER (PARTITION BY chrom, run ORDER BY b) AS i FROM r)"


@query(CENTRES + " SELECT chrom, run, b AS centre FROM c WHERE i = (n + 1) // 2")
def domain_centres(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.domain_centres(_labelled(spark, sf))


@query(CENTRES + ' SELECT chrom, run, min(b) AS "start", max(be) AS "end", count(*) AS n_bins FROM c GROUP BY chrom, run')
def concept_domain_runs(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.domains(_labelled(spark, sf))


SHIFT = draw_sql("concat_ws('|', 'shift', chrom)")


@query(
    f"""WITH {EV}, {HOURS}, d AS (SELECT chrom, min(b) AS lo, max(be) AS hi FROM hours GROUP BY chrom),
x AS (SELECT event_id, chrom, lo, hi, lo + (s - lo + {SHIFT} % (hi - lo)) % (hi - lo) AS st, least(e - s, hi - lo) AS w FROM ev JOIN d USING (chrom)),
p AS (SELECT event_id, chrom, st AS s, least(st + w, hi) AS e FROM x UNION ALL SELECT event_id, chrom, lo, lo + st + w - hi FROM x WHERE st + w > hi)
SELECT event_id, chrom, s AS "start", e AS "end" FROM p"""
)
def circular_shift(spark: SparkSession, sf: str) -> DataFrame:
    domain = intervals.concept_domains(hours(spark, sf))
    offset = F.pmod(scalar.draw(F.lit("shift"), F.col("chrom")), F.col("high") - F.col("low"))
    moved = spans(spark, sf).select("event_id", "chrom", "start", "end").join(domain, "chrom").withColumn("offset", offset)
    return intervals.circular_shift(moved).select("event_id", "chrom", "start", "end")


@query('WITH x AS (SELECT l_orderkey AS transcript, CAST(floor(epoch(l_shipdate)) AS BIGINT) // 86400 AS s FROM lineitem), g AS (SELECT transcript, s + 2 AS s, lead(s) OVER (PARTITION BY transcript ORDER BY s, s + 2) AS n FROM x) SELECT transcript, s AS "start", n AS "end" FROM g WHERE n > s')
def introns_from_exons(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    exons = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript"), day.alias("start"), (day + 2).alias("end"))
    return intervals.introns(exons)


@query(f"WITH {EV}, {merged_sql('ev', 'm')}, c AS (SELECT chrom, s, e, unnest(range(s // 3600, (e - 1) // 3600 + 1)) AS bin FROM m) SELECT chrom, bin, CAST(sum(least(e, (bin + 1) * 3600) - greatest(s, bin * 3600)) AS BIGINT) AS bases FROM c GROUP BY chrom, bin")
def exon_bin_weights(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.bin_weights(intervals.merge(spans(spark, sf)), WIDTH)


@query(f"WITH {EV}, pad AS (SELECT chrom, greatest(s - 7200, 0) AS s, e + 7200 AS e FROM ev WHERE concept = 'click'), {merged_sql('pad', 'w')} SELECT event_id, ev.chrom, ev.s AS pos, min(w.s) AS win_start, arg_min(w.e, w.s) AS win_end FROM ev JOIN w ON ev.chrom = w.chrom AND ev.s >= w.s + 900 AND ev.s < w.e - 900 WHERE concept = 'purchase' GROUP BY ALL")
def containment_first_window(spark: SparkSession, sf: str) -> DataFrame:
    ev = spans(spark, sf)
    points = ev.where("concept = 'purchase'").select("event_id", "chrom", F.col("start").alias("pos"))
    return intervals.first_containing(points, intervals.pad(ev.where("concept = 'click'"), 7200), 900, 14400)


@query(LABELLED + ", d AS (SELECT chrom, min(b) AS lo, max(be) AS hi FROM hours GROUP BY chrom), g AS (SELECT chrom, unnest(range(lo, hi, 3600)) AS b FROM d) SELECT g.chrom, g.b AS bin_start, g.b + 3600 AS bin_end, coalesce(label, false) AS positive, label IS NOT NULL AS observed FROM g LEFT JOIN l ON g.chrom = l.chrom AND g.b = l.b")
def grid_left_map(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.map_to_grid(bin_grid_expand(spark, sf), _labelled(spark, sf), "label")


@query(f"WITH {EV}, n AS (SELECT DISTINCT concept, s // 3600 * 3600 AS b, chrom FROM ev), c AS (SELECT b, concept, count(*) AS cells FROM n GROUP BY b, concept) SELECT b AS bin_start, concept, cells, cells >= 4 AS consensus FROM c")
def consensus_threshold(spark: SparkSession, sf: str) -> DataFrame:
    marked = spans(spark, sf).select(F.col("concept").alias("mark"), F.col("chrom").alias("cell"), (F.floor(F.col("start") / WIDTH) * WIDTH).alias("bin_start"))
    return panels.consensus(marked, ("bin_start",), 4).withColumnRenamed("mark", "concept")


@query(
    f"""WITH {EV}, {HOURS}, c AS (SELECT DISTINCT concept FROM ev), h AS (SELECT DISTINCT concept, chrom, s // 3600 * 3600 AS b FROM ev), n AS (SELECT count(*) AS n FROM hours),
p AS (SELECT concept, count(*) AS n_pos, count(*) / (SELECT CAST(n AS DOUBLE) FROM n) AS prevalence FROM h GROUP BY concept)
SELECT concept, n_pos, round(prevalence, 6) AS prevalence, CASE WHEN concept = 'blacklist' THEN 'artifact_control' WHEN starts_with(concept, 'shuffled_') THEN 'negative_control' WHEN prevalence > 0.03 THEN 'exploratory' WHEN prevalence >= 0.001 THEN 'confirmatory' ELSE 'excluded_too_rare' END AS role FROM p"""
)
def prevalence_roles(spark: SparkSession, sf: str) -> DataFrame:
    total = hours(spark, sf).agg(F.count("*").cast("double").alias("n"))
    seen = spans(spark, sf).select("concept", "chrom", F.floor(F.col("start") / WIDTH)).distinct().groupBy("concept").agg(F.count("*").alias("n_pos"))
    shares = seen.join(total, F.lit(True)).select("concept", "n_pos", (F.col("n_pos") / F.col("n")).alias("prevalence"))
    return rounded(shares.withColumn("role", reports.role(F.col("concept"), F.col("prevalence"))), "prevalence")


@query(f"WITH {EV}, {HOURS} SELECT count(*) AS n, CAST(sum(CAST(chrom IS NULL OR b IS NULL OR be IS NULL AS INTEGER)) AS BIGINT) AS nulls, CAST(sum(CAST(be - b <> 3600 AS INTEGER)) AS BIGINT) AS bad_width, CAST(sum(CAST(b < 0 AS INTEGER)) AS BIGINT) AS negative, (SELECT count(*) FROM (SELECT chrom, b FROM hours GROUP BY chrom, b HAVING count(*) > 1)) AS repeated FROM hours")
def coordinate_validation(spark: SparkSession, sf: str) -> DataFrame:
    return reports.validation(hours(spark, sf), WIDTH)


@query(f"WITH {EV}, {HOURS} SELECT chrom, b // 86400 AS day, count(*) = 24 AND max(b) - min(b) = 3600 * 23 AS complete FROM hours GROUP BY ALL")
def complete_grid(spark: SparkSession, sf: str) -> DataFrame:
    bins = hours(spark, sf).withColumn("day", F.floor(F.col("bin_start") / 86400)).withColumn("kept", F.lit(True))
    return reports.complete_grids(bins, WIDTH, 24, ("chrom", "day"))


@query(
    LABELLED
    + """, x AS (SELECT l.*, EXISTS (SELECT 1 FROM ev WHERE ev.chrom = l.chrom AND concept = 'click' AND ev.s < be AND ev.e > b) AS pred FROM l), g AS (SELECT *, coalesce(CAST(b <> lag(be) OVER (PARTITION BY chrom ORDER BY b) AS INTEGER), 1) AS new FROM x WHERE label), r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY b ROWS UNBOUNDED PRECEDING) AS run FROM g),
d AS (SELECT bool_or(pred) AS hit FROM r GROUP BY chrom, run), k AS (SELECT count(*) AS n_domains, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS n_recovered FROM d), q AS (SELECT sum(CAST(pred AS INTEGER)) AS np, sum(CAST(pred AND label AS INTEGER)) AS nt FROM x), f AS (SELECT n_domains, n_recovered, nt / CAST(np AS DOUBLE) AS precision, n_recovered / CAST(n_domains AS DOUBLE) AS recall FROM k, q)
SELECT n_domains, n_recovered, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM f"""
)
def domain_precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    both = intervals.label_bins(_labelled(spark, sf), spans(spark, sf).where("concept = 'click'"), into="pred", width=WIDTH)
    return rounded(ranks.domain_f1(both), "precision", "recall", "f1")


ENRICH = LABELLED + ", v AS (SELECT chrom, s // 3600 * 3600 AS b, avg(value) AS score FROM ev GROUP BY ALL), x AS (SELECT l.chrom, l.b, l.be, label, score, l.b // 86400 AS block FROM l JOIN v ON l.chrom = v.chrom AND l.b = v.b), g AS (SELECT *, coalesce(CAST(b <> lag(be) OVER (PARTITION BY chrom ORDER BY b) AS INTEGER), 1) AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY b ROWS UNBOUNDED PRECEDING) AS run FROM g), lg AS (SELECT *, coalesce(CAST(b <> lag(be) OVER (PARTITION BY chrom ORDER BY b) AS INTEGER), 1) AS lnew FROM r WHERE label), lr AS (SELECT *, sum(lnew) OVER (PARTITION BY chrom ORDER BY b ROWS UNBOUNDED PRECEDING) AS lrun FROM lg), c AS (SELECT *, count(*) OVER (PARTITION BY chrom, lrun) AS n, row_number() OVER (PARTITION BY chrom, lrun ORDER BY b) AS i FROM lr), ce AS (SELECT chrom, run, b AS centre, block FROM c WHERE i = (n + 1) // 2), k AS (SELECT ce.chrom, ce.centre, ce.block, r.b, r.score, exp(-(((r.b - ce.centre) / 3600.0) ** 2) / 2) AS w FROM ce JOIN r ON r.chrom = ce.chrom AND r.run = ce.run AND abs(r.b - ce.centre) <= 7200), e AS (SELECT chrom, centre, block, sum(w * score) / sum(w) AS event FROM k GROUP BY chrom, centre, block), bg AS (SELECT r.block, r.score FROM r WHERE NOT label AND NOT EXISTS (SELECT 1 FROM k WHERE k.chrom = r.chrom AND k.b = r.b)), eb AS (SELECT block, sum(event) AS es, count(*) AS en FROM e GROUP BY block), bb AS (SELECT block, sum(score) AS bs, count(*) AS bn FROM bg GROUP BY block), blocks AS (SELECT coalesce(eb.block, bb.block) AS block, coalesce(es, 0) AS es, coalesce(en, 0) AS en, coalesce(bs, 0) AS bs, coalesce(bn, 0) AS bn FROM eb FULL JOIN bb ON eb.block = bb.block)"


def _event_blocks(spark: SparkSession, sf: str) -> DataFrame:
    ev = spans(spark, sf)
    means = ev.groupBy("chrom", (F.floor(F.col("start") / WIDTH) * WIDTH).alias("bin_start")).agg(F.avg("value").alias("score"))
    bins = means.where("chrom IS NOT NULL AND bin_start IS NOT NULL").withColumn("bin_end", F.col("bin_start") + WIDTH)  # hours with their scores
    return enrichment.event_blocks(intervals.label_bins(bins, ev.where("concept = 'purchase'"), width=WIDTH), WIDTH, 86400, cell=CELL)


@query(ENRICH + " SELECT block, round(es, 6) AS event_sum, en AS n_events, round(bs, 6) AS background_sum, bn AS n_background FROM blocks")
def event_enrichment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = _event_blocks(spark, sf)
    return b.select("block", F.round("es", 6).alias("event_sum"), F.col("en").alias("n_events"), F.round("bs", 6).alias("background_sum"), F.col("bn").alias("n_background"))


@query(
    ENRICH
    + f""", o AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS n FROM blocks), d AS (SELECT rep, slot, {draw_sql("concat_ws('|', 'boot', CAST(rep AS VARCHAR), CAST(slot AS VARCHAR))")} % (SELECT max(n) FROM o) AS i FROM range(0, 2000) a(rep), range(0, (SELECT max(n) FROM o)) b(slot)),
t AS (SELECT rep, ln((sum(es) / sum(en) + 1e-12) / (sum(bs) / sum(bn) + 1e-12)) AS v FROM d JOIN o USING (i) GROUP BY rep HAVING sum(en) > 0 AND sum(bn) > 0)
SELECT round((SELECT ln((sum(es) / sum(en) + 1e-12) / (sum(bs) / sum(bn) + 1e-12)) FROM o), 6) AS log_enrichment, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM t"""
)
def event_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(enrichment.log_enrichment(_event_blocks(spark, sf)).drop("n_draws"), "log_enrichment", "low", "high")



#: Draws of a null: with ten concepts the least p has to be below .005 for a discovery at .05.
DRAWS = 319
NULLS = f"""{CHANNELS}, {ONE_HOT}, rk AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM ch),
pl AS (SELECT vec_id AS id, vec_id % 5 AS run, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY vec_id % 5) AS n FROM embeddings),
of AS (SELECT draw, run, max(n) AS n, {draw_sql("concat_ws('|', 'null', CAST(draw AS VARCHAR), CAST(run AS VARCHAR))")} % max(n) AS off FROM pl, range(0, {DRAWS}) r(draw) GROUP BY draw, run),
ps AS MATERIALIZED (SELECT draw, lab.concept, p2.id FROM lab JOIN pl USING (id) JOIN of USING (run) JOIN pl p2 ON p2.run = pl.run AND p2.i = (pl.i + off) % of.n WHERE y = 1),
nu AS (SELECT draw, concept, feature, CAST(count(*) AS DOUBLE) AS p, (SELECT count(*) FROM pl) - CAST(count(*) AS DOUBLE) AS q, sum(rk) AS rs FROM rk JOIN ps USING (id) GROUP BY ALL),
sc AS (SELECT draw, concept, max(greatest((rs - p * (p + 1) / 2) / (p * q), 1 - (rs - p * (p + 1) / 2) / (p * q))) AS v FROM nu GROUP BY draw, concept),
mx AS MATERIALIZED (SELECT draw, concept, coalesce(v, 0.5) AS v FROM (SELECT DISTINCT concept FROM lab) c CROSS JOIN range(0, {DRAWS}) r(draw) LEFT JOIN sc USING (draw, concept))"""


def _null(spark: SparkSession, sf: str) -> DataFrame:
    """(draw, concept, value): the best folded area over channels with labels turned within runs."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(5)).alias("run"))
    order = Window.partitionBy("run")
    places = own.withColumn("i", (F.row_number().over(order.orderBy("id")) - 1).cast("long")).withColumn("n", F.count("*").over(order))
    labels = one_hot(spark, sf)
    offsets = inference.hashed_offsets(places.groupBy("run").agg(F.max("n").alias("n")), DRAWS, "null")
    positives = inference.rolled_positives(places.join(labels, "id"), places, offsets)
    return inference.dense_null(ranks.average_rank(channels(spark, sf)), positives, labels.select("concept").distinct(), places, DRAWS)


@query(f"WITH {NULLS} SELECT concept, CAST(draw AS INTEGER) AS draw, round(v, 6) AS value FROM mx")
def max_feature_null(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_null(spark, sf), "value").select("concept", "draw", "value")


@query(
    f"WITH {NULLS}, ob AS (SELECT concept, max(greatest(a, 1 - a)) AS o FROM (SELECT concept, feature, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS a FROM rk JOIN lab USING (id) GROUP BY ALL) GROUP BY concept) SELECT concept, round(o, 6) AS observed, round((1 + sum(CASE WHEN v >= o THEN 1 ELSE 0 END)) / (1.0 + count(*)), 6) AS p, round(quantile_cont(v, 0.95), 6) AS null_p95 FROM ob JOIN mx USING (concept) GROUP BY concept, o"
)
def empirical_p(spark: SparkSession, sf: str) -> DataFrame:
    best = ranks.best_feature(ranks.auroc_dense(channels(spark, sf), one_hot(spark, sf))).select("concept", F.col("best_auroc").alias("value"))
    null = _null(spark, sf).persist()  # a row a concept and draw, read twice
    p95 = null.groupBy("concept").agg(F.percentile("value", 0.95).alias("null_p95"))
    found = inference.empirical_p(best, null, "concept").join(p95, "concept").withColumnRenamed("value", "observed")
    return rounded(found, "observed", "p", "null_p95").select("concept", "observed", "p", "null_p95")


SHIFTED = f"""{CHANNELS}, {CODES}, rk AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM codes), sz AS (SELECT feature, count(*) AS m FROM codes GROUP BY feature),
bi AS (SELECT vec_id AS id, 'c' || vec_id // 128 AS chrom, vec_id % 128 * 128 AS s, label AS concept FROM embeddings),
el AS (SELECT concept, chrom, min(s) AS s, max(s) + 128 AS e FROM (SELECT *, s - 128 * row_number() OVER (PARTITION BY concept, chrom ORDER BY s) AS g FROM bi) GROUP BY concept, chrom, g),
doms AS (SELECT chrom, min(s) AS lo, max(s) + 128 AS hi FROM bi GROUP BY chrom),
dr AS (SELECT chrom, lo, hi, draw, {draw_sql("concat_ws('|', 'shift', CAST(draw AS VARCHAR), chrom, CAST(lo AS VARCHAR))")} % (hi - lo) AS off FROM doms, range(0, {DRAWS}) r(draw)),
sh AS (SELECT draw, concept, chrom, lo, hi, lo + (s - lo + off) % (hi - lo) AS a, least(e - s, hi - lo) AS w FROM el JOIN dr USING (chrom)),
pc AS (SELECT draw, concept, chrom, a AS s, least(a + w, hi) AS e FROM sh UNION ALL SELECT draw, concept, chrom, lo, lo + a + w - hi FROM sh WHERE a + w > hi),
ps AS MATERIALIZED (SELECT DISTINCT draw, pc.concept, id FROM pc JOIN bi ON pc.chrom = bi.chrom AND pc.s < bi.s + 128 AND pc.e > bi.s),
np AS (SELECT draw, concept, CAST(count(*) AS DOUBLE) AS p, (SELECT count(*) FROM bi) - CAST(count(*) AS DOUBLE) AS q FROM ps GROUP BY ALL),
hh AS (SELECT draw, concept, feature, CAST(count(*) AS DOUBLE) AS a, sum(rk) AS rs FROM ps JOIN rk USING (id) GROUP BY ALL),
fu AS (SELECT np.draw, np.concept, p, q, m, coalesce(a, 0) AS a, coalesce(rs, 0) AS rs FROM np CROSS JOIN sz LEFT JOIN hh ON hh.draw = np.draw AND hh.concept = np.concept AND hh.feature = sz.feature WHERE q > 0),
ar AS (SELECT draw, concept, (a * (q - m + a) + 0.5 * (p - a) * (q - m + a) + rs - a * (a + 1) / 2) / (p * q) AS v FROM fu),
be AS MATERIALIZED (SELECT draw, concept, max(greatest(v, 1 - v)) AS v FROM ar GROUP BY ALL),
nv AS MATERIALIZED (SELECT draw, concept, coalesce(v, 0.5) AS v FROM (SELECT DISTINCT concept FROM el) c CROSS JOIN range(0, {DRAWS}) r(draw) LEFT JOIN be USING (draw, concept))"""


def _positional(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as bins of 128 bases, 128 to a chrom; each label's neighbouring bins as its elements; and the domains."""
    at = F.pmod("vec_id", F.lit(128)) * 128
    bins = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.floor(F.col("vec_id") / 128)).alias("chrom"), at.alias("bin_start"), (at + 128).alias("bin_end"), F.col("label").alias("concept"))
    elements = intervals.merge(bins.select("concept", "chrom", F.col("bin_start").alias("start"), F.col("bin_end").alias("end")), ("concept", "chrom"))
    return bins, elements, intervals.concept_domains(bins)


def _shifted_null(spark: SparkSession, sf: str) -> DataFrame:
    bins, elements, domains = _positional(spark, sf)
    return inference.shifted_sparse_null(codes(spark, sf), bins, elements, domains, DRAWS, "shift")


@query(f"WITH {SHIFTED} SELECT concept, CAST(draw AS INTEGER) AS draw, round(v, 6) AS value FROM nv")
def shifted_sparse_null(spark: SparkSession, sf: str) -> DataFrame:
    """The best feature's area for elements that slide along their domains, for every draw."""
    return rounded(_shifted_null(spark, sf), "value").select("concept", "draw", "value")


@query(
    f"""WITH {SHIFTED}, la AS (SELECT concept, id, p, (SELECT count(*) FROM bi) - p AS q FROM bi JOIN (SELECT concept, CAST(count(*) AS DOUBLE) AS p FROM bi GROUP BY concept) USING (concept)),
oh AS (SELECT concept, feature, CAST(count(*) AS DOUBLE) AS a, sum(rk) AS rs FROM la JOIN rk USING (id) GROUP BY ALL),
oa AS (SELECT c.concept, sz.feature, (coalesce(a, 0) * (q - m + coalesce(a, 0)) + 0.5 * (p - coalesce(a, 0)) * (q - m + coalesce(a, 0)) + coalesce(rs, 0) - coalesce(a, 0) * (coalesce(a, 0) + 1) / 2) / (p * q) AS v FROM (SELECT DISTINCT concept, p, q FROM la) c CROSS JOIN sz LEFT JOIN oh ON oh.concept = c.concept AND oh.feature = sz.feature),
ob AS (SELECT concept, max(greatest(v, 1 - v)) AS o FROM oa GROUP BY concept),
pv AS (SELECT concept, o, (1 + count(*) FILTER (v >= o)) / (1.0 + count(*)) AS p FROM ob JOIN nv USING (concept) GROUP BY ALL),
rn AS (SELECT *, row_number() OVER (ORDER BY p, concept) AS rank, CAST(count(*) OVER () AS DOUBLE) AS m FROM pv), kk AS (SELECT max(CASE WHEN p <= 0.05 * rank / m THEN rank END) AS k FROM rn)
SELECT concept, round(o, 6) AS observed, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank, coalesce(rank <= k, false) AS significant FROM rn, kk"""
)
def shifted_null_discoveries(spark: SparkSession, sf: str) -> DataFrame:
    """Each concept's best feature against its sliding elements, with its false discovery rank."""
    bins, _, _ = _positional(spark, sf)
    labels = one_hot(spark, sf)
    fired = codes(spark, sf)
    best = ranks.best_feature(ranks.auroc_sparse(fired, labels, fired)).select("concept", F.col("best_auroc").alias("value"))
    p = inference.empirical_p(best, _shifted_null(spark, sf), "concept").select(F.col("concept").alias("id"), F.col("value").alias("observed"), "p")
    return rounded(inference.benjamini_hochberg(p), "observed", "p").withColumnRenamed("id", "concept")


CL = draw_sql("concat_ws('|', 'swap', CAST(draw AS VARCHAR), CAST(cluster AS VARCHAR))")
SITES = "st AS (SELECT * FROM (SELECT vec_id % 20 AS cluster, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS i, CAST(embedding[1] AS DOUBLE) AS effect, CAST(label < 5 AS INTEGER) AS y FROM embeddings) WHERE i <= (SELECT count(*) // 20 FROM embeddings))"


@query(
    f"""WITH {SITES}, cl AS (SELECT DISTINCT cluster FROM st), sl AS (SELECT cluster AS dst, row_number() OVER (ORDER BY cluster) AS slot FROM cl), mx AS (SELECT draw, cluster, row_number() OVER (PARTITION BY draw ORDER BY {CL}, cluster) AS slot FROM cl, range(0, 50) r(draw)),
lb AS (SELECT draw, dst AS cluster, i, y FROM mx JOIN sl USING (slot) JOIN st USING (cluster)), nu AS (SELECT draw, avg(CASE WHEN lb.y = 1 THEN effect END) - avg(CASE WHEN lb.y = 0 THEN effect END) AS v FROM lb JOIN st USING (cluster, i) GROUP BY draw), ob AS (SELECT avg(CASE WHEN y = 1 THEN effect END) - avg(CASE WHEN y = 0 THEN effect END) AS o FROM st)
SELECT round(o, 6) AS observed, round((1 + sum(CASE WHEN abs(v) >= abs(o) THEN 1 ELSE 0 END)) / 51.0, 6) AS p FROM nu, ob GROUP BY o"""
)
def cluster_permutation_p(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    size = e.agg(F.floor(F.count("*") / 20).alias("size"))
    order = Window.partitionBy("cluster").orderBy("vec_id")
    sites = e.select("vec_id", F.pmod("vec_id", F.lit(20)).alias("cluster"), F.get("embedding", F.lit(0)).cast("double").alias("effect"), (F.col("label") < 5).cast("int").alias("y")).withColumn("i", F.row_number().over(order))
    sites = sites.join(size, F.col("i") <= F.col("size")).select("cluster", "i", "effect", "y")
    return rounded(inference.cluster_permutation(sites, 50, "swap"), "observed", "p")


@query(
    """WITH t AS (SELECT 'u' || user_id AS id, 1.0 / (1 + count(*)) AS p FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rank, CAST(count(*) OVER () AS DOUBLE) AS m FROM t), k AS (SELECT max(CASE WHEN p <= 0.05 * rank / m THEN rank END) AS k FROM r)
SELECT id, round(p, 9) AS p, CAST(rank AS INTEGER) AS rank, coalesce(rank <= k, false) AS significant FROM r, k"""
)
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    tests = table(spark, sf, "events").groupBy("user_id").agg((F.lit(1.0) / (1 + F.count("*"))).alias("p")).select(F.concat(F.lit("u"), "user_id").alias("id"), "p")
    return rounded(inference.benjamini_hochberg(tests), "p", digits=9)


DELTAS = "d AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(round(l_extendedprice * (l_discount - l_tax) * 100) AS BIGINT) AS delta FROM lineitem)"


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    delta = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) * 100).cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), delta.alias("delta"))


@query(f"WITH {DELTAS} SELECT flag, status, count(*) AS n, round(avg(delta), 6) AS mean, round(CAST(median(delta) AS DOUBLE), 6) AS median, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t, round(avg(CAST(delta < 0 AS DOUBLE)), 6) AS negative FROM d GROUP BY flag, status")
def paired_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inference.paired_stats(_deltas(spark, sf), ("flag", "status")), "mean", "median", "t", "negative")


@query(
    f"WITH {DELTAS}, r AS (SELECT *, rank() OVER (PARTITION BY flag, status ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY flag, status, abs(delta)) - 1) / 2.0 AS rk, CAST(count(*) OVER (PARTITION BY flag, status, abs(delta)) AS DOUBLE) AS t FROM d WHERE delta <> 0) SELECT flag, status, count(*) AS n, least(sum(CASE WHEN delta > 0 THEN rk ELSE 0 END), sum(CASE WHEN delta < 0 THEN rk ELSE 0 END)) AS w, sum(t * t - 1) AS ties FROM r GROUP BY flag, status"
)
def wilcoxon_w(spark: SparkSession, sf: str) -> DataFrame:
    return inference.wilcoxon_w(_deltas(spark, sf), ("flag", "status"))


#: Two-sided p values in other terms than the operator's: the finite series of the t distribution, counts of subsets, and erf's series.
TESTS = """o AS (SELECT k1, k2, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd FROM d GROUP BY ALL),
t AS (SELECT *, CASE WHEN n < 2 OR (sd = 0 AND mean = 0) THEN NULL WHEN sd = 0 THEN sign(mean) * 'inf'::DOUBLE ELSE mean / (sd / sqrt(n)) END AS t FROM o),
th AS (SELECT *, atan(abs(t) / sqrt(n - 1)) AS h, n - 1 AS v FROM t),
tp AS (SELECT k1, k2, n, t, CASE WHEN t IS NULL OR n < 2 THEN 1.0 WHEN isinf(t) THEN 0.0 WHEN v % 2 = 0 THEN 1 - sin(h) * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) + 2 * j * ln(cos(h))) / sqrt(pi())))
ELSE 1 - 2 / pi() * (h + sin(h) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos(h))) * sqrt(pi()) / 2)), 0)) END AS t_p FROM th),
rk AS (SELECT *, rank() OVER (PARTITION BY k1, k2 ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY k1, k2, abs(delta)) - 1) / 2.0 AS rk, CAST(count(*) OVER (PARTITION BY k1, k2, abs(delta)) AS DOUBLE) AS tie FROM d WHERE delta <> 0),
w AS (SELECT k1, k2, count(*) AS m, least(sum(CASE WHEN delta > 0 THEN rk ELSE 0 END), sum(CASE WHEN delta < 0 THEN rk ELSE 0 END)) AS w, sum(tie * tie - 1) AS ties FROM rk GROUP BY ALL),
su(m, c) AS (SELECT CAST(0 AS BIGINT), [1.0::DOUBLE] UNION ALL SELECT m + 1, list_transform(range(0, len(c) + m + 1), lambda i: coalesce(c[i + 1], 0) + CASE WHEN i > m THEN coalesce(c[i - m], 0) ELSE 0 END) FROM su WHERE m < 50),
z AS (SELECT tp.k1, tp.k2, tp.n, t, t_p, coalesce(m, 0) AS m, w, ties, least(abs(w - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48) / sqrt(2), 12) AS z FROM tp LEFT JOIN w ON w.k1 = tp.k1 AND w.k2 = tp.k2),
r AS (SELECT z.*, CASE WHEN z.m = 0 THEN 1.0 WHEN z.m <= 50 AND ties = 0 THEN least(1.0, 2 * list_sum(c[1:CAST(floor(w) AS BIGINT) + 1]) / pow(2, z.m)) WHEN z.m * (z.m + 1) * (2 * z.m + 1) / 24.0 - ties / 48 <= 0 THEN 1.0 WHEN z = 0 THEN 1.0
ELSE 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 500), lambda j: exp(j * ln(2) + (2 * j + 1) * ln(z) - lgamma(j + 1.5) - (j + 1) * ln(2) + ln(pi()) / 2))) END AS w_p FROM z LEFT JOIN su ON su.m = z.m)"""


@query(f"WITH RECURSIVE {DELTAS.replace('AS flag', 'AS k1').replace('AS status', 'AS k2')}, {TESTS} SELECT k1 AS flag, k2 AS status, n, round(t, 6) AS t, m AS w_n, coalesce(w, 0) AS w, round(t_p, 6) AS t_p, round(w_p, 6) AS w_p FROM r")
def paired_p_values(spark: SparkSession, sf: str) -> DataFrame:
    tested = inference.paired_tests(_deltas(spark, sf), ("flag", "status"))
    return rounded(tested.select("flag", "status", "n", "t", "w_n", "w", "t_p", "w_p"), "t", "t_p", "w_p")


@query(f"WITH RECURSIVE d AS (SELECT l_partkey AS k1, 0 AS k2, CAST(round(l_extendedprice * (l_discount - l_tax) * 100) AS BIGINT) AS delta FROM lineitem), {TESTS} SELECT k1 AS part, n, round(t, 6) AS t, m AS w_n, coalesce(w, 0) AS w, round(t_p, 6) AS t_p, round(w_p, 6) AS w_p FROM r")
def paired_p_values_by_part(spark: SparkSession, sf: str) -> DataFrame:
    """Many small groups: exact signed ranks where no two pairs tie."""
    delta = F.round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) * 100).cast("long")
    tested = inference.paired_tests(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), delta.alias("delta")), ("part",))
    return rounded(tested.select("part", "n", "t", "w_n", "w", "t_p", "w_p"), "t", "t_p", "w_p")


@query(f"WITH {CHANNELS}, {CODES} SELECT id, feature, round(CAST(value AS DOUBLE), 6) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, id) AS rank FROM codes) WHERE rank <= 10")
def top_bins_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_rows(codes(spark, sf), 10).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"WITH {CHANNELS}, {CODES}, {ONE_HOT}, t AS (SELECT id, feature FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY value DESC, id) AS rank FROM codes) WHERE rank <= 10), s AS (SELECT feature, concept, avg(y) AS share FROM t JOIN lab USING (id) GROUP BY feature, concept) SELECT feature, CASE WHEN share > 0 THEN CAST(concept AS VARCHAR) ELSE 'none' END AS dominant, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY share DESC, concept) AS r FROM s) WHERE r = 1")
def feature_concept_shares(spark: SparkSession, sf: str) -> DataFrame:
    labels = one_hot(spark, sf).withColumn("concept", F.col("concept").cast("string"))
    return rounded(reports.concept_shares(reports.top_rows(codes(spark, sf), 10), labels), "share")


@query("WITH d AS (SELECT event_type AS concept, day(ts) % 2 AS split, avg(value) AS v FROM events GROUP BY ALL) SELECT a.concept, round(a.v, 6) AS value_unseen, round(b.v, 6) AS value_trained, round(b.v - a.v, 6) AS gap FROM d a JOIN d b ON a.concept = b.concept AND a.split = 0 AND b.split = 1")
def memorisation_gap(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy(F.col("event_type").alias("concept"), (F.dayofmonth("ts") % 2).alias("split")).agg(F.avg("value").alias("value"))
    return rounded(reports.memorisation_gap(per.where("split = 0"), per.where("split = 1")), "value_unseen", "value_trained", "gap")


HALVES = "nrm AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda z: z * z))) + 1e-12)) AS v FROM nrm)"


@query(f"WITH {HALVES}, c AS (SELECT a.id AS left_id, b.id AS right_id, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.id % 2 = 0 AND b.id % 2 <> 0) SELECT left_id, right_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY c DESC, right_id) AS r FROM c) WHERE r = 1")
def seed_agreement_cosine(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    two = (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0"))  # every row is in one of the two dictionaries
    return rounded(vectors.nearest_by_cosine(*two), "cosine")


RATES = f"{CHANNELS}, {CODES}, rt AS (SELECT feature, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM embeddings) AS rate FROM codes GROUP BY feature)"


@query(f"WITH {RATES}, l2 AS (SELECT feature, sqrt(sum(CAST(value AS DOUBLE) ** 2)) AS l2 FROM codes GROUP BY feature), p AS (SELECT a.feature AS target, b.feature AS control, a.l2 / b.l2 AS scale, row_number() OVER (PARTITION BY a.feature ORDER BY abs(ln(round(b.l2 / a.l2, 9))), b.feature) AS r FROM l2 a JOIN l2 b ON a.feature <> b.feature) SELECT target, control, round(scale, 6) AS scale, scale BETWEEN 0.75 AND 1.25 AS within FROM p WHERE r = 1")
def dose_matched_control(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value").cast("double")
    norms = codes(spark, sf).groupBy("feature").agg(F.sqrt(F.sum(v * v)).alias("l2"))
    return rounded(controls.nearest_dose(norms), "scale")


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS before, round(list_sum(list_transform(list_zip(v, list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125 ELSE -0.125 END)), lambda z: (z[1] - v[1] * z[2]) ** 2)), 6) AS after FROM e")
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    direction = F.array(*[F.lit(0.125 if i % 2 == 0 else -0.125) for i in range(64)])
    e = table(spark, sf, "embeddings")
    cut = vectors.ablate(F.col("embedding"), F.get("embedding", F.lit(0)).cast("double"), direction)
    return rounded(e.select("vec_id", scalar.dot(F.col("embedding"), F.col("embedding")).alias("before"), scalar.dot(cut, cut).alias("after")), "before", "after")


@query(f"WITH {CHANNELS}, {ONE_HOT}, s AS (SELECT concept, feature, CAST(value AS DOUBLE) ** 2 AS effect, y FROM ch JOIN lab USING (id)) SELECT concept, feature, round(avg(CASE WHEN y = 1 THEN effect END), 6) AS on_effect, round(avg(CASE WHEN y = 0 THEN effect END), 6) AS off_effect, round(avg(CASE WHEN y = 1 THEN effect END) / avg(CASE WHEN y = 0 THEN effect END), 6) AS ratio FROM s GROUP BY ALL")
def ablation_selectivity(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value").cast("double")
    sites = channels(spark, sf).select("id", "feature", (v * v).alias("effect")).join(one_hot(spark, sf), "id")
    return rounded(vectors.selectivity(sites, ("concept", "feature")), "on_effect", "off_effect", "ratio")


@query("WITH g AS (SELECT o_orderpriority AS modality, log2((o_totalprice + 1.0) / (c_acctbal + 1001.0)) AS r FROM orders JOIN customer ON o_custkey = c_custkey) SELECT modality, count(*) AS n, round(median(r), 6) AS median_log2, round(avg(CAST(r > 0 AS DOUBLE)), 6) AS increased FROM g GROUP BY modality")
def log2_effects(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = joined.select(F.col("o_orderpriority").alias("modality"), scalar.log2_ratio(F.col("o_totalprice"), F.col("c_acctbal") + 1000.0, 1.0).alias("r"))
    return rounded(r.groupBy("modality").agg(F.count("*").alias("n"), F.percentile("r", 0.5).alias("median_log2"), F.avg((F.col("r") > 0).cast("double")).alias("increased")), "median_log2", "increased")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_tax) > 1e-4 THEN greatest(-2.0, least(2.0, l_discount / l_tax)) END, 6) AS ratio FROM lineitem")
def mediation_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalar.guarded_ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio")), "ratio")


CONTRASTS = f"{CHANNELS}, {ONE_HOT}, x AS (SELECT concept, id % 7 AS win, feature, CAST(value AS DOUBLE) AS v, y FROM ch JOIN lab USING (id)), p AS (SELECT concept, win, feature, avg(CASE WHEN y = 1 THEN v END) - avg(CASE WHEN y = 0 THEN v END) AS c FROM x GROUP BY ALL), k AS (SELECT concept, feature, avg(c) AS contrast, count(*) AS n_windows FROM p WHERE c IS NOT NULL GROUP BY ALL)"


def _contrasts(spark: SparkSession, sf: str) -> DataFrame:
    rows = channels(spark, sf).join(one_hot(spark, sf), "id").select("concept", (F.col("id") % 7).alias("window"), "feature", F.col("value").cast("double").alias("value"), "y")
    return vectors.contrastive_feature(rows, ("concept",))


@query(f"WITH {CONTRASTS} SELECT concept, feature, round(contrast, 6) AS contrast, n_windows FROM k")
def contrastive_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_contrasts(spark, sf), "contrast")


@query(f"WITH {CONTRASTS}, r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY contrast DESC, feature) AS r FROM k) SELECT concept, feature, round(contrast, 6) AS contrast FROM r WHERE r = 1")
def discovered_features(spark: SparkSession, sf: str) -> DataFrame:
    """Each concept's feature of the largest contrast."""
    return rounded(vectors.discovered(_contrasts(spark, sf)), "contrast")


@query(f"WITH {SEQ} SELECT id, length(sequence) AS n, round(CASE WHEN length(sequence) > 0 THEN length(regexp_replace(sequence, '[^GC]', '', 'g')) / CAST(length(sequence) AS DOUBLE) END, 6) AS gc FROM seq")
def gc_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("id", F.length("sequence").cast("long").alias("n"), F.round(scalar.gc_fraction(F.col("sequence")), 6).alias("gc"))


WIN = "w AS (SELECT id, st, substr(sequence, CAST(st + 1 AS BIGINT), 64) AS win FROM (SELECT id, sequence, unnest(range(0, length(sequence) - 64 + 1, 64)) AS st FROM seq WHERE length(sequence) >= 64))"


@query(f"WITH {SEQ}, {WIN}, g AS (SELECT id, st, length(regexp_replace(win, '[^GC]', '', 'g')) / 64.0 AS gc FROM w), q AS (SELECT id, quantile_cont(gc, 0.75) AS q FROM g GROUP BY id HAVING count(*) >= 2), k AS (SELECT CAST(id AS VARCHAR) AS chrom, st AS s, st + 64 AS e FROM g JOIN q USING (id) WHERE gc >= q), {merged_sql('k', 'm')} SELECT chrom, s AS \"start\", e AS \"end\" FROM m")
def gc_quantile(spark: SparkSession, sf: str) -> DataFrame:
    chunks = sequences(spark, sf).select(F.col("id").cast("string").alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("sequence").alias("bases"))
    return sequence.gc_quantile_bins(chunks, 64, 0.75, 2)


@query(
    f"""WITH {SEQ}, w AS (SELECT id, st, substr(sequence, CAST(st + 1 AS BIGINT), 50) AS win FROM (SELECT id, sequence, unnest(range(0, length(sequence) - 49, 25)) AS st FROM seq WHERE length(sequence) >= 50)),
c AS (SELECT id, st, length(win) - length(replace(win, 'C', '')) AS c, length(win) - length(replace(win, 'G', '')) AS g, (length(win) - length(replace(win, 'CG', ''))) / 2.0 AS cg FROM w), r AS (SELECT id, st, (c + g) / 50.0 AS gc, CASE WHEN c * g > 0 THEN cg * 50 / (c * g) ELSE 0 END AS ratio FROM c)
SELECT id, CAST(st AS INTEGER) AS "start", CAST(st + 50 AS INTEGER) AS "end", round(gc, 6) AS gc, round(ratio, 6) AS ratio FROM r WHERE gc >= 0.3 AND ratio >= 0.4"""
)
def cpg_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sequence.cpg_windows(sequences(spark, sf), 50, 25, 0.3, 0.4), "gc", "ratio")


PWM = f"{SEQ}, l AS (SELECT CAST(i AS INTEGER) AS pos, substr(sequence, CAST(i + 1 AS BIGINT), 1) AS base FROM seq, range(0, 6) r(i) WHERE length(sequence) >= 6), n AS (SELECT pos, base, CAST(count(*) AS DOUBLE) AS w FROM l GROUP BY ALL), f AS (SELECT p.pos, b.base, coalesce(w, 0) + 0.25 AS w FROM (SELECT DISTINCT pos FROM n) p CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS base) b LEFT JOIN n ON n.pos = p.pos AND n.base = b.base), pw AS (SELECT pos, base, w / sum(w) OVER (PARTITION BY pos) AS p FROM f)"


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.position_weights(sequence.base_counts(sequences(spark, sf).withColumn("weight", F.lit(1.0)), 6))


@query(f"WITH {PWM} SELECT pos, base, round(p, 6) AS p, round(p * greatest(2 + sum(p * log2(p)) OVER (PARTITION BY pos), 0), 6) AS height FROM pw")
def pwm_information(spark: SparkSession, sf: str) -> DataFrame:
    w = _weights(spark, sf)
    return rounded(w.join(sequence.information(w), ["pos", "base"]), "p", "height")


@query(
    f"""WITH {PWM}, sc AS MATERIALIZED (SELECT pos, base, log2(p / 0.25) AS v FROM pw), bk AS (SELECT 5 - pos AS pos, translate(base, 'ACGT', 'TGCA') AS base, v FROM sc), th AS (SELECT 0.8 * sum(m) AS t FROM (SELECT max(v) AS m FROM sc GROUP BY pos)),
wn AS MATERIALIZED (SELECT id, CAST(i AS BIGINT) AS i, substr(sequence, CAST(i + 1 AS BIGINT), 6) AS w FROM (SELECT id, sequence, unnest(range(0, length(sequence) - 5)) AS i FROM seq WHERE length(sequence) >= 6)),
kinds AS (SELECT DISTINCT w FROM wn), le AS (SELECT w, CAST(j AS INTEGER) AS pos, substr(w, CAST(j + 1 AS BIGINT), 1) AS base FROM kinds, range(0, 6) r(j)),
tot AS (SELECT w, '+' AS strand, sum(v) AS score FROM le JOIN sc USING (pos, base) GROUP BY w UNION ALL SELECT w, '-', sum(v) FROM le JOIN bk USING (pos, base) GROUP BY w)
SELECT id, i AS "start", i + 6 AS "end", strand, round(score, 6) AS score, w AS "window" FROM wn JOIN tot USING (w), th WHERE score >= t"""
)
def motif_scan_both_strands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sequence.scan_motif(sequences(spark, sf), sequence.log_odds(_weights(spark, sf)), 6, 0.8), "score")


LETTERS = "substr(sequence, 3, 6)"
_ORDER = draw_sql("concat_ws('|', CAST(id AS VARCHAR), CAST(k AS VARCHAR), CAST(i AS VARCHAR))")


@query(
    f"""WITH {SEQ}, pt AS (SELECT id, sequence, {LETTERS} AS part FROM seq WHERE length(sequence) >= 8),
c AS (SELECT id, sequence, part, list_concat(list_transform(range(0, 10), lambda k: array_to_string(list_transform(list_sort(list_transform(range(0, length(part)), lambda i: {{'key': {_ORDER}, 'i': i, 'x': part[i + 1]}})), lambda s: s.x), '')), list_transform(range(1, length(part)), lambda k: part[k + 1:] || part[1:k])) AS others FROM pt)
SELECT id, substr(sequence, 1, 2) || list_filter(others, lambda x: x <> part)[1] || substr(sequence, 9) AS mutated FROM c"""
)
def anchor_mutation(spark: SparkSession, sf: str) -> DataFrame:
    """Six letters of each sequence in another order."""
    own = sequences(spark, sf).where(F.length("sequence") >= 8)
    return own.select("id", scalar.mutate_anchor(F.col("sequence"), F.lit(2), F.lit(6), F.col("id")).alias("mutated"))


@query("WITH p AS (SELECT user_id, count(*) AS cost, round(avg(value), 9) AS loss FROM events GROUP BY user_id), m AS (SELECT *, min(loss) OVER (ORDER BY cost, loss ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM p) SELECT user_id, cost, round(loss, 6) AS loss FROM m WHERE least IS NULL OR loss < least")
def pareto_frontier(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cost"), F.round(F.avg("value"), 9).alias("loss"))
    return rounded(reports.pareto(points, "cost", "loss"), "loss")


@query("SELECT event_type AS concept, event_id AS id, round(value, 6) AS value, round(1 - (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) / CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS above FROM events")
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select(F.col("event_type").alias("concept"), F.col("event_id").alias("id"), "value")
    return rounded(reports.ecdf(values, ("concept",)), "value", "above")


@query("WITH p AS (SELECT event_type AS concept, event_id AS s, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT concept, CAST(CASE WHEN n <= 90 THEN i ELSE i * 90 // n END AS BIGINT) AS part, min(s) AS \"start\", round(max(value), 6) AS value FROM p GROUP BY ALL")
def maxpool_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = table(spark, sf, "events").select(F.col("event_type").alias("concept"), F.col("event_id").alias("start"), "value")
    return rounded(reports.max_pool(profile, 90, ("concept",)), "value")


@query(f"WITH k AS (SELECT o_orderkey, {draw_sql("concat_ws('|', 'manifest', CAST(o_orderkey AS VARCHAR))")} AS d FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY d, o_orderkey) AS r, count(*) OVER () AS n FROM k) SELECT o_orderkey, CASE WHEN r <= n // 4 THEN 'test' WHEN r <= n // 4 + n // 8 THEN 'dev' ELSE 'train' END AS split FROM r WHERE r <= n // 4 + n // 8 + n // 2")
def manifest_draw(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter, an eighth and a half of all orders, in hash order."""
    pool = table(spark, sf, "orders").select("o_orderkey", scalar.draw(F.lit("manifest"), F.col("o_orderkey")).alias("key"))
    n = pool.count()
    return reports.draw_splits(pool, "key", [("test", n // 4), ("dev", n // 8), ("train", n // 2)], ("o_orderkey",)).drop("key")


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('seed|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 5")
def hash_rank_selection(spark: SparkSession, sf: str) -> DataFrame:
    key = F.sha2(F.concat_ws("|", F.lit("seed"), F.col("o_orderkey").cast("string")), 256)
    order = Window.partitionBy("o_orderpriority").orderBy(key, "o_orderkey")
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(order)).where("r <= 5").select("o_orderkey", "o_orderpriority")


@query("SELECT count(*) AS shared FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def fold_intersection_empty(spark: SparkSession, sf: str) -> DataFrame:
    """How many orders two sets share: those with returned lines, and those with open ones."""
    lines = table(spark, sf, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_orderkey").intersect(lines.where("l_linestatus = 'O'").select("l_orderkey")).agg(F.count("*").alias("shared"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IS NOT NULL)")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without a returned line."""
    return table(spark, sf, "orders").select("o_orderkey").subtract(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))


TERR = f"rg AS (SELECT chrom, b AS s, be AS e, (b // 86400) % 8 AS fold FROM hours), hf AS (SELECT chrom, s, e FROM rg WHERE fold IN (3, 4)), tf AS (SELECT chrom, s, e FROM rg WHERE fold NOT IN (3, 4)), {merged_sql('hf', 'h0')}, {merged_sql('tf', 't0')}, tp AS (SELECT chrom, greatest(s - 1800, 0) AS s, e + 1800 AS e FROM t0), {merged_sql('tp', 'tq')}, {subtracted_sql('h0', 'tq', 'h1')}, {subtracted_sql('t0', 'h1', 't1')}"


@query(f"WITH {EV}, {HOURS}, {TERR} SELECT 'heldout' AS part, chrom, s AS \"start\", e AS \"end\" FROM h1 UNION ALL SELECT 'trained', chrom, s, e FROM t1")
def territory(spark: SparkSession, sf: str) -> DataFrame:
    fold = F.concat(F.lit("fold"), F.pmod(F.floor(F.col("bin_start") / 86400), F.lit(8)).cast("string"))
    regions = hours(spark, sf).select("chrom", F.col("bin_start").alias("start"), F.col("bin_end").alias("end"), fold.alias("fold"))
    held, trained = intervals.territory(regions, "fold3", "fold4", 1800)
    return held.select(F.lit("heldout").alias("part"), "chrom", "start", "end").union(trained.select(F.lit("trained"), "chrom", "start", "end"))


@query(f'WITH {EV}, {merged_sql("ev", "m")}, g AS (SELECT chrom, e AS s, lead(s) OVER (PARTITION BY chrom ORDER BY s) AS e FROM m) SELECT chrom, s AS "start", e AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY e - s DESC, s) AS r FROM g WHERE e IS NOT NULL) WHERE r = 1')
def largest_gap(spark: SparkSession, sf: str) -> DataFrame:
    gaps = intervals.introns(intervals.merge(spans(spark, sf)).withColumnRenamed("chrom", "transcript")).withColumnRenamed("transcript", "chrom")
    return intervals.largest_gap(gaps)


@query(f"WITH {EV}, q AS (SELECT quantile_cont(value, [0.2, 0.4, 0.6000000000000001, 0.8]) AS q FROM ev) SELECT event_id, CAST(len(list_filter(q, lambda x: x <= value)) AS INTEGER) AS stratum FROM ev, q")
def quantile_strata(spark: SparkSession, sf: str) -> DataFrame:
    ev = spans(spark, sf)
    edges = ev.agg(F.percentile("value", F.array(*[F.lit(float(x)) for x in np.linspace(0, 1, 6)[1:-1]])).alias("edges"))
    return ev.join(edges, F.lit(True)).select("event_id", scalar.quantile_stratum(F.col("value"), F.col("edges")).alias("stratum"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


W_SQL = f"wt AS MATERIALIZED (SELECT CAST(c AS INTEGER) AS channel, CAST(f AS INTEGER) AS feature, ({draw_sql("concat_ws('|', 'w', CAST(c AS VARCHAR), CAST(f AS VARCHAR))")} % 20001 - 10000) / 10000.0::DOUBLE AS w FROM range(0, 64) a(c), range(0, 256) b(f))"
ENCODED = f"""{CHANNELS}, {W_SQL}, mo AS (SELECT id, avg(CAST(value AS DOUBLE)) AS m, stddev_samp(CAST(value AS DOUBLE)) + 1e-5 AS s FROM ch GROUP BY id),
xs AS (SELECT id, ch.feature AS channel, (CAST(value AS DOUBLE) - m) / s AS v FROM ch JOIN mo USING (id)), hs AS (SELECT id, wt.feature, sum(v * w) AS value FROM xs JOIN wt USING (channel) GROUP BY id, wt.feature),
en AS (SELECT id, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, feature) AS r FROM hs) WHERE r <= 16 AND value > 0)"""


@query(f"WITH {ENCODED} SELECT id, feature, round(value, 6) AS value FROM en")
def encode_topk_udf(spark: SparkSession, sf: str) -> DataFrame:
    """The encoder by Arrow batch: one matrix product a batch."""
    w = vectors.weight_matrix(weights(spark), 64, 256)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    codes_ = vectors.encode_topk(rows, "embedding", w, np.zeros(256), np.zeros(64), 16, layernorm=True, exact=True)
    each = codes_.select("id", F.explode(F.arrays_zip("features", "code_values")).alias("c"))
    return rounded(each.select("id", F.col("c.features").alias("feature"), F.col("c.code_values").alias("value")), "value")


@query(f"WITH {ENCODED} SELECT id, feature, round(value, 6) AS value FROM en")
def encode_relational(spark: SparkSession, sf: str) -> DataFrame:
    """The encoder as a join and a sum, for dictionaries of any size."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vectors.layer_norm(F.col("embedding")).alias("vec"))
    return rounded(vectors.encode_relational(rows, weights(spark), k=16), "value")


@query(f"WITH {CHANNELS}, {CODES}, {W_SQL} SELECT id, wt.feature AS channel, round(sum(CAST(value AS DOUBLE) * w), 6) AS value FROM codes JOIN wt ON wt.channel = codes.feature GROUP BY ALL")
def decode_relational(spark: SparkSession, sf: str) -> DataFrame:
    """Codes back to channels by a dictionary's columns."""
    back = weights(spark).select(F.col("channel").alias("feature"), F.col("feature").alias("channel"), "w")
    return rounded(vectors.decode_relational(codes(spark, sf), back), "value")


@query(
    f"""WITH {NULLS}, au AS (SELECT concept, feature, CAST(sum(y) AS BIGINT) AS n_pos, avg(y) AS prevalence, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS a FROM rk JOIN lab USING (id) GROUP BY concept, feature),
b AS (SELECT * FROM (SELECT *, greatest(a, 1 - a) AS f, row_number() OVER (PARTITION BY concept ORDER BY greatest(a, 1 - a) DESC, feature) AS r FROM au) WHERE r = 1),
e AS (SELECT concept, feature, n_pos, prevalence, a, f, (1 + sum(CASE WHEN v >= f THEN 1 ELSE 0 END)) / (1.0 + count(*)) AS p, quantile_cont(v, 0.95) AS p95 FROM b JOIN mx USING (concept) GROUP BY ALL),
q AS (SELECT *, row_number() OVER (ORDER BY p, concept) AS rank, CAST(count(*) OVER () AS DOUBLE) AS m FROM e), k AS (SELECT max(CASE WHEN p <= 0.05 * rank / m THEN rank END) AS k FROM q)
SELECT concept, feature AS best_feature, n_pos, round(prevalence, 6) AS prevalence, round(f, 6) AS best_auroc, round(a, 6) AS raw_best_auroc, a < 0.5 AS inverse, round(p95, 6) AS null_p95, round(p, 6) AS p, CAST(rank AS INTEGER) AS fdr_rank, coalesce(rank <= k, false) AS significant, f >= 0.7 AND f > p95 AS recovered FROM q, k"""
)
def match_table(spark: SparkSession, sf: str) -> DataFrame:
    """Everything known of each concept's best channel: area, null, p, false discovery, recovery."""
    labels = one_hot(spark, sf)
    best = ranks.best_feature(ranks.auroc_dense(channels(spark, sf), labels))
    totals = labels.groupBy("concept").agg(F.sum("y").cast("long").alias("n_pos"), F.avg("y").alias("prevalence"))
    null = _null(spark, sf).persist()  # a row a concept and draw, read twice
    p = inference.empirical_p(best.select("concept", F.col("best_auroc").alias("value")), null, "concept").select(F.col("concept").alias("id"), "p")
    tested = inference.benjamini_hochberg(p).withColumnRenamed("id", "concept")
    table_ = best.join(totals, "concept").join(null.groupBy("concept").agg(F.percentile("value", 0.95).alias("null_p95")), "concept").join(tested, "concept")
    recovered = (F.col("best_auroc") >= 0.7) & (F.col("best_auroc") > F.col("null_p95"))
    out = table_.select("concept", "best_feature", "n_pos", "prevalence", "best_auroc", F.col("raw_auroc").alias("raw_best_auroc"), "inverse", "null_p95", "p", F.col("rank").alias("fdr_rank"), "significant", recovered.alias("recovered"))
    return rounded(out, "prevalence", "best_auroc", "raw_best_auroc", "null_p95", "p")


@query(
    f"WITH {HALVES}, s AS (SELECT id, id % 3 AS seed, v FROM u), c AS (SELECT a.seed AS seed_a, b.seed AS seed_b, a.id, max(list_dot_product(a.v, b.v)) AS c FROM s a JOIN s b ON a.seed < b.seed GROUP BY ALL) SELECT seed_a, seed_b, count(*) AS n, round(avg(c), 6) AS mean_cosine, CAST(sum(CAST(c >= 0.7 AS INTEGER)) AS BIGINT) AS agreed FROM c GROUP BY ALL"
)
def seed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of three dictionaries: how near each direction's best match is."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3).alias("seed"))
    pairs = None
    for a, b in ((0, 1), (0, 2), (1, 2)):
        found = vectors.nearest_by_cosine(rows.where(F.col("seed") == a), rows.where(F.col("seed") == b))
        one = found.agg(F.count("*").alias("n"), F.avg("cosine").alias("mean_cosine"), F.sum((F.col("cosine") >= 0.7).cast("long")).alias("agreed")).select(F.lit(a).cast("long").alias("seed_a"), F.lit(b).cast("long").alias("seed_b"), "*")
        pairs = one if pairs is None else pairs.union(one)
    return rounded(pairs, "mean_cosine")


@query("WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), s AS (SELECT c_custkey, c_name FROM customer) SELECT coalesce(o_custkey, c_custkey) AS custkey, count(o_orderkey) AS n_orders, count(c_name) > 0 AS planned FROM r FULL JOIN s ON o_custkey = c_custkey GROUP BY ALL")
def planned_status_check(spark: SparkSession, sf: str) -> DataFrame:
    """Planned records against what came: a full outer join keeps what either side lacks."""
    o, c = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", "c_name")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "full")
    return both.groupBy(F.coalesce("o_custkey", "c_custkey").alias("custkey")).agg(F.count("o_orderkey").alias("n_orders"), (F.count("c_name") > 0).alias("planned"))


SH = draw_sql("concat_ws('|', 'shuffle', chrom, CAST(s AS VARCHAR), CAST(e AS VARCHAR))")


@query(f'WITH {EV}, {HOURS}, d AS (SELECT chrom, min(b) AS lo, max(be) AS hi FROM hours GROUP BY chrom), x AS (SELECT chrom, lo + {SH} % (hi - lo - (e - s) + 1) AS st, e - s AS w FROM ev JOIN d USING (chrom) WHERE hi - lo >= e - s) SELECT chrom, st AS "start", st + w AS "end" FROM x')
def shuffled_intervals(spark: SparkSession, sf: str) -> DataFrame:
    domain = intervals.concept_domains(hours(spark, sf))
    return intervals.shuffle_within(spans(spark, sf).join(domain, "chrom").select("chrom", "low", "high", "start", "end"), "shuffle")


AV = lambda seed: draw_sql(f"concat_ws('|', '{seed}', x.chrom, CAST(x.s AS VARCHAR), CAST(x.e AS VARCHAR))")


@query(
    f"""WITH {EV}, ex AS (SELECT chrom, s, e FROM ev WHERE concept = 'purchase'), {merged_sql("ex", "mx")}, wh AS (SELECT chrom, CAST(0 AS BIGINT) AS s, max(e) AS e FROM ev GROUP BY chrom), {subtracted_sql("wh", "mx", "fr")},
x AS (SELECT chrom, s, e, e - s AS n FROM ev WHERE concept = 'click'), ln AS (SELECT DISTINCT chrom, n FROM x),
gp AS (SELECT ln.chrom, ln.n, fr.s, fr.e - fr.s - ln.n + 1 AS c FROM ln JOIN fr ON fr.chrom = ln.chrom AND fr.e - fr.s >= ln.n),
pf AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY chrom, n ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, sum(c) OVER (PARTITION BY chrom, n) AS total FROM gp),
dr AS (SELECT DISTINCT x.chrom, x.s, x.e, x.n, ({AV("avoid")} * 1048576 + {AV("avoid+")}) % total AS at FROM x JOIN pf ON pf.chrom = x.chrom AND pf.n = x.n),
pl AS (SELECT dr.chrom, dr.s AS old_start, dr.e AS old_end, CAST(pf.s + dr.at - pf.f AS BIGINT) AS st, dr.n FROM dr JOIN pf ON pf.chrom = dr.chrom AND pf.n = dr.n AND dr.at >= pf.f AND dr.at < pf.f + pf.c)
SELECT chrom, old_start, old_end, st AS "start", st + n AS "end" FROM pl"""
)
def shuffled_avoiding(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks at drawn places of their chrom that no purchase overlaps."""
    ev = spans(spark, sf)
    clicks = ev.where("concept = 'click'").select("chrom", "start", "end").distinct()
    sizes = ev.groupBy("chrom").agg(F.max("end").alias("size"))
    return intervals.shuffle_avoiding(clicks, sizes, ev.where("concept = 'purchase'"), "avoid")


RECEIPTS = """rc AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) AS seq, CAST(o_orderkey AS VARCHAR) AS key, concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus) AS body FROM orders),
sl AS MATERIALIZED (SELECT *, sha256(concat_ws('|', CAST(seq AS VARCHAR), key, body)) AS sha256 FROM rc), ch AS MATERIALIZED (SELECT *, coalesce(lag(sha256) OVER (ORDER BY seq), 'plan') AS previous FROM sl)"""


def _receipts(orders: DataFrame, *keep: str) -> DataFrame:
    body = F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus")
    return receipts.freeze(orders, "o_orderkey", "o_orderkey", "plan", body, keep)


@query(f"WITH {RECEIPTS} SELECT seq, key, body, sha256, previous FROM ch")
def receipt_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _receipts(table(spark, sf, "orders"))


@query(
    f"""WITH {RECEIPTS}, tm AS MATERIALIZED (SELECT seq, key, CASE WHEN body LIKE '%|P' THEN body || '?' ELSE body END AS body, sha256, previous FROM ch WHERE key NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'))
SELECT 'changed' AS fault, seq, key FROM tm WHERE sha256 <> sha256(concat_ws('|', CAST(seq AS VARCHAR), key, body)) UNION ALL SELECT 'gap', seq, key FROM tm WHERE seq > 1 AND seq - 1 NOT IN (SELECT seq FROM tm)
UNION ALL SELECT 'missing', NULL, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def receipt_faults(spark: SparkSession, sf: str) -> DataFrame:
    """What an audit finds when urgent orders' receipts are gone and those of status P have other content."""
    urgent = F.coalesce(F.max(F.col("o_orderpriority") == "1-URGENT").over(Window.partitionBy("o_orderkey")), F.lit(False)) & F.col("o_orderkey").isNotNull()
    held = _receipts(table(spark, sf, "orders").withColumn("urgent", urgent), "urgent").where(~F.col("urgent"))
    damaged = held.withColumn("body", F.when(F.col("body").endswith("|P"), F.concat("body", F.lit("?"))).otherwise(F.col("body")))
    return receipts.audit(damaged, "plan", table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")))


@query(f"WITH {EV} SELECT concept, count(*) AS n, min(s) AS low, max(e) AS high, CAST(sum(e - s) AS BIGINT) AS bases FROM ev GROUP BY concept")
def quantity_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).groupBy("concept").agg(F.count("*").alias("n"), F.min("start").alias("low"), F.max("end").alias("high"), F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))
