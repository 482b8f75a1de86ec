"""Frozen plans and the chained receipts of what was run after them.

A receipt holds its number, the key and content of its record, the hash of
these, and the hash of the receipt before it; the first one holds that of the
plan. Hashes are made where the rows are, and the link needs only the row
before, so that neither writing nor checking follows the chain on one machine.
The record's order is range-sorted; numbers come from counts of its parts.
Neighbours meet in parts of PART numbers, each with a copy of what has the
number before its first: records are sent once to be linked, and once to be
checked against their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.orders import before
from quillon.operators.validators import content_hash, row_text


def _sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def plan_hash(plan: DataFrame) -> str:
    """One hash for a plan's rows, whatever their order: it stands for the plan in every receipt."""
    row = content_hash(plan).first()
    return f"{row['n']}:{row['hash']}"


#: Numbers that are linked together, a power of two.
PART = 1 << 12


def _parts(rows: DataFrame) -> DataFrame:
    """rows by parts of their seq, __part; the last number of a part is in the next one too, where __copy is true."""
    own = F.shiftright("seq", PART.bit_length() - 1)
    last = F.col("seq").bitwiseAND(F.lit(PART - 1).cast("long")) == PART - 1
    copied = rows.withColumn("__part", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    return copied.withColumn("__copy", ~F.col("__part").eqNullSafe(own))


def freeze(records: DataFrame, order: str, key: str, plan: str, body: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, key, body, sha256, previous, keep): the receipts of records in the order of the numeric column order.

    order tells all records apart; body is their content as text (that of all
    columns unless given). plan is what the first receipt links to. keep:
    columns of records that go along beside the receipts.
    """
    own = records.select(F.col(order).alias("__at"), F.col(key).cast("string").alias("key"), (body if body is not None else row_text(records)).alias("body"), *keep)
    numbered = before(own.withColumn("__one", F.lit(1)), (), "__at", {"__before": ("sum", "__one")})
    parts = _parts(numbered.select((F.col("__before") + 1).cast("long").alias("seq"), "key", "body", *keep))
    beside = Window.partitionBy("__part").orderBy("seq")
    met = parts.withColumns({f"__{c}": F.lag(c).over(beside) for c in ("key", "body")}).where(~F.col("__copy"))
    # Hashes are made after the rows are sent, from the content of both.
    previous = F.when(F.col("seq") == 1, F.lit(plan)).otherwise(_sha(F.col("seq") - 1, F.col("__key"), F.col("__body")))
    return met.select("seq", "key", "body", _sha(F.col("seq"), F.col("key"), F.col("body")).alias("sha256"), previous.alias("previous"), *keep)


def _each(rows: DataFrame, found: dict[str, tuple[Column, str]]) -> DataFrame:
    """(fault, seq, key) for every row and every fault whose condition holds; found: fault to condition and column of the key."""
    marks = [F.when(test, F.struct(F.lit(fault).alias("fault"), F.col(key).alias("key"))) for fault, (test, key) in found.items()]
    return rows.select("seq", F.explode(F.array_compact(F.array(*marks))).alias("__m")).select("__m.fault", "seq", "__m.key")


def _chain_faults(receipts: DataFrame, plan: str) -> DataFrame:
    changed = ~F.col("sha256").eqNullSafe(_sha(F.col("seq"), F.col("key"), F.col("body")))
    parts = _parts(receipts.select("seq", "key", "sha256", "previous", changed.alias("__changed")))
    order = Window.partitionBy("__part").orderBy("seq")
    peers, below = order.rangeBetween(0, 0), order.rangeBetween(-1, -1)
    met = parts.withColumns(
        {
            "__n": F.count(F.lit(1)).over(peers),
            "__least": F.min("key").over(peers),
            "__first": F.row_number().over(order) == F.rank().over(order),
            "__below": F.count(F.lit(1)).over(below),
            "__held": F.collect_set("sha256").over(below),  # more than one only at a fork
        }
    ).where(~F.col("__copy"))
    seq, previous = F.col("seq"), F.col("previous")
    fits = F.when(seq == 1, previous.eqNullSafe(F.lit(plan))).otherwise(F.coalesce(F.array_contains("__held", previous), F.lit(False)))
    return _each(
        met,
        {
            "changed": (F.col("__changed"), "key"),
            "fork": ((F.col("__n") > 1) & F.col("__first"), "__least"),
            "gap": ((seq > 1) & (F.col("__below") == 0), "key"),
            "unlinked": (seq.isNotNull() & ~fits & ((seq == 1) | (F.col("__below") > 0)), "key"),
        },
    )


def _key_faults(receipts: DataFrame, planned: DataFrame | None) -> DataFrame:
    if planned is None:
        twice = receipts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq")).where("n > 1")
        return twice.select(F.lit("repeated").alias("fault"), "seq", "key")
    held = receipts.select("seq", "key", F.lit(0).alias("__wanted"))
    named = held.unionByName(planned.select(F.lit(None).cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.lit(1).alias("__wanted")))
    order = Window.partitionBy("key").orderBy("__wanted", F.col("seq").asc_nulls_last())  # receipts before plans
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = named.withColumns({"__n": F.sum(1 - F.col("__wanted")).over(whole), "__plans": F.sum("__wanted").over(whole), "__i": F.row_number().over(order)})
    own, nameless = F.col("__wanted") == 0, F.col("key").isNull()  # null keys equal none
    return _each(
        met,
        {
            "repeated": (own & (F.col("__i") == 1) & (F.col("__n") > 1), "key"),
            "missing": (~own & (F.col("__i") == F.col("__n") + 1) & ((F.col("__n") == 0) | nameless), "key"),
            "unplanned": (own & ((F.col("__plans") == 0) | nameless), "key"),
        },
    )


def audit(receipts: DataFrame, plan: str, planned: DataFrame | None = None) -> DataFrame:
    """(fault, seq, key) of all that is wrong with receipts, in no order; empty if nothing is.

    changed: the content isn't that of the hash. fork: a number stands there
    twice. gap: the number before is missing. unlinked: what is held of the one
    before (or of the plan) isn't its hash. repeated: a key twice. Against
    planned (key): missing and unplanned keys.
    """
    own = receipts.select(F.col("seq").cast("long").alias("seq"), "key", "body", "sha256", "previous")
    return _chain_faults(own, plan).unionByName(_key_faults(own, planned))


def finalize(receipts: DataFrame, plan: str, planned: DataFrame | None = None) -> dict[str, object]:
    """The closing record of a run: plan, number of receipts, hash of the last one, and one over all; ValueError on any fault."""
    wrong = {r["fault"]: r["n"] for r in audit(receipts, plan, planned).groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}
    if wrong:
        raise ValueError(f"receipts are not in order: {dict(sorted(wrong.items()))}")
    last = receipts.agg(F.count(F.lit(1)).alias("n"), F.max_by("sha256", "seq").alias("head")).first()
    return {"plan": plan, "n": last["n"], "head": last["head"], "content": plan_hash(receipts.select("seq", "key", "sha256", "previous"))}


def at_rank(ordered: DataFrame, order: list[Column], rank: int) -> dict[str, object]:
    """The record of a rank (from 0) in an order that tells all apart; IndexError beyond the end. Only rank + 1 rows are ordered."""
    if rank < 0:
        raise IndexError(f"rank {rank}")
    top = ordered.orderBy(*order).limit(rank + 1)
    found = top.withColumn("__i", F.row_number().over(Window.orderBy(*order))).where(F.col("__i") == rank + 1).drop("__i").collect()
    if not found:
        raise IndexError(f"rank {rank} of {ordered.count()} records")
    return found[0].asDict()
