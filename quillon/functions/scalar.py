"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def draw(*parts: Column) -> Column:
    """A reproducible 32-bit number from the parts: the first 8 hex digits of their md5, joined by |."""
    key = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def gc_fraction(sequence: Column) -> Column:
    """Share of G and C; null if empty or with letters other than A, C, G, T."""
    known = ~sequence.rlike("[^ACGTacgt]") & (F.length(sequence) > 0)
    return F.when(known, F.length(F.regexp_replace(sequence, "[^GCgc]", "")) / F.length(sequence).cast("double"))


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), "ACGTNacgtn", "TGCANtgcan")


def mutate_anchor(sequence: Column, start: Column, width: Column, seed: Column, tries: int = 10) -> Column:
    """sequence whose part [start, start + width) has its letters in another order, drawn from seed.

    The first of some drawn orders that reads differently is taken, else the
    first turn of the part that does; null where all letters of the part are
    the same, or there is none.
    """
    part = F.substring(sequence, start + 1, width)
    letters = F.filter(F.split(part, ""), lambda x: x != "")

    def order(k: Column) -> Column:
        keyed = F.transform(letters, lambda x, i: F.struct(draw(seed, k, i).alias("key"), i.alias("i"), x.alias("x")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["x"]), "")

    turn = lambda k: F.concat(F.substring(part, k + 1, F.length(part)), F.substring(part, F.lit(1), k))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), order)
    turned = F.transform(F.sequence(F.lit(1), F.greatest(F.length(part) - 1, F.lit(1))), turn)
    other = F.get(F.filter(F.concat(drawn, turned), lambda x: x != part), F.lit(0))
    return F.concat(F.substring(sequence, F.lit(1), start), other, F.substring(sequence, start + width + 1, F.length(sequence)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))


def auroc_ceiling(prevalence: Column, firing: Column, sign: Column | None = None) -> Column:
    """The best AUROC that a feature firing on that share of rows can reach."""
    mass = prevalence if sign is None else F.when(sign >= 0, prevalence).otherwise(1 - prevalence)
    return F.least(F.lit(1.0), F.lit(0.5) + firing / (2 * mass))


def directed(auroc: Column) -> Column:
    return F.greatest(auroc, 1 - auroc)


def log2_ratio(a: Column, b: Column, offset: float) -> Column:
    return F.log2((a + offset) / (b + offset))


def guarded_ratio(a: Column, b: Column, least: float = 1e-4, clip: float = 2.0) -> Column:
    """a / b where b is far enough from 0, held within +-clip."""
    return F.when(F.abs(b) > least, F.greatest(F.lit(-clip), F.least(F.lit(clip), a / b)))


def quantile_stratum(value: Column, edges: Column) -> Column:
    """Number of inner edges at or below value; -1 for null and non-finite values."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.size(F.filter(edges, lambda e: e <= value))).otherwise(-1)


def aligned_chrom(name: Column, prefixed: bool) -> Column:
    """chr1 <-> 1 and chrM <-> MT."""
    bare = F.regexp_replace(name, "^chr", "")
    bare = F.when(bare == "M", "MT").otherwise(bare)
    return F.concat(F.lit("chr"), F.when(bare == "MT", "M").otherwise(bare)) if prefixed else bare
