"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components.

Signatures: one permutation spreads a shingle over all 64-bit values, a second
one, shifted circularly by k, gives coordinate k (C-MinHash). COORDINATES
coordinates of eight bits make BANDS bands of BAND_ROWS rows. Two sets with
similarity 0.75 miss all bands with a chance of 4e-6.

Equal sets are one class first, so that copies cost nothing later. Bands then
say which classes may be alike:

1. in each band key's group, all are compared with the smallest id;
2. groups whose members the links found so far don't join into one component
   go on: members outside the group's largest component (probes) are compared
   with all others. Probes and members are cut into parts of bounded numbers
   and bounded sets, and a task compares one part of each: signatures choose,
   full sets decide, and only links leave the task.

Every link counts only after its full sets are compared. Sets travel as
sorted 64-bit hashes, packed; texts are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import bucket_bounds, pack_sorted, unpack_sorted
from quillon.llm.bpe import slices
from quillon.llm.common import cut_lineage
from quillon.llm.words import U, splitmix, window_hashes, word_hashes

SHINGLE = 5
BAND_ROWS, BANDS = 6, 64
COORDINATES = BAND_ROWS * BANDS
#: Percent of the union that the intersection has at least.
SIMILAR = 75
#: Pairs estimated below this are not compared further: six deviations under SIMILAR.
LEAST_ESTIMATE = 0.61
BLOCK_ROWS = 2_000
#: What a part of a group holds on average: members, and shingles of all their sets.
PART_ROWS, PART_SHINGLES = 512, 1_000_000

_SHIFTS = np.arange(1, COORDINATES + 1, dtype=np.uint64)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's different word shingles, A-Z as a-z; fewer words make one shingle, none an empty set."""
    words, counts = word_hashes(texts, fold=True)
    whole = window_hashes(words, width)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(whole[at : at + n - width + 1]))
        else:
            out.append(window_hashes(words[at : at + n], n) if n else np.empty(0, dtype=np.uint64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bytes of all coordinates of a set that isn't empty."""
    spread = splitmix(shingles ^ U(0xA0761D6478BD642F))
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(spread), 256):
        np.minimum(least, splitmix(spread[at : at + 256, None] + _SHIFTS).min(axis=0), out=least)
    return (least & U(0xFF)).astype(np.uint8)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each row of signatures and band."""
    rows = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(BAND_ROWS):
        key = (key << U(8)) | rows[:, :, i]
    return splitmix(key)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, run in slices(batch, "__text", 1_000_000):
            sets = shingle_sets(run)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h1 = np.array([splitmix(s + U(3)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
            h2 = np.array([splitmix(s + U(5)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], dtype=np.uint64)
            known: dict[tuple, bytes] = {}
            signs = []
            for key, s in zip(zip(h1.tolist(), h2.tolist(), strict=True), sets, strict=True):
                if len(s) and key not in known:
                    known[key] = signature(s).tobytes()
                signs.append(known[key] if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("__id").slice(first, len(run)), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(signs, pa.binary())], names=["id", "n", "h1", "h2", "sign"])


def _class_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and band keys of a block's classes, and its different keys, sorted."""
    signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
    keys = band_keys(signs)
    return signs, keys, np.unique(keys)


def _ask(bits: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, keys, _ = _class_keys(table)
        own, counts = np.unique(keys, return_counts=True)
        bounds = bucket_bounds(own, bits)
        used = np.flatnonzero(np.diff(bounds))
        parts = [slice(bounds[i], bounds[i + 1]) for i in used]
        return pa.table({"bucket": pa.array(used, pa.int32()), "__block": pa.array([key[0].as_py()] * len(used), pa.int32()), "names": pa.array([pack_sorted(own[p]) for p in parts], pa.binary()), "twice": pa.array([np.packbits(counts[p] > 1).tobytes() for p in parts], pa.binary())})

    return work


def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    names = [unpack_sorted(x) for x in table.column("names").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(n)] for x, n in zip(table.column("twice").to_pylist(), names, strict=True)]
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    seen = np.bincount(back, weights=1.0 + np.concatenate(twice))[back] > 1
    flags = [np.packbits(x).tobytes() for x in np.split(seen, np.cumsum([len(n) for n in names])[:-1])]
    return pa.table({"__block": table.column("__block"), "bucket": pa.array([key[0].as_py()] * len(flags), pa.int32()), "flags": pa.array(flags, pa.binary())})


def _candidates(bits: int):
    def work(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        signs, keys, own = _class_keys(table)
        flags = dict(zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True))
        sizes = np.diff(bucket_bounds(own, bits))
        known = np.concatenate([np.unpackbits(np.frombuffer(flags[i], np.uint8))[: sizes[i]] for i in np.flatnonzero(sizes)]).astype(bool)
        shared = known[np.searchsorted(own, keys)]
        rows = np.flatnonzero(shared.any(axis=1))
        lists = [keys[i][shared[i]].view(np.int64) for i in rows]
        at = pa.array(rows, pa.int64())
        return pa.table({"rep": table.column("rep").take(at), "n": table.column("n").take(at), "sign": table.column("sign").take(at), "keys": pa.array(lists, pa.list_(pa.int64()))})

    return work


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every v of links (a, b): the smallest id reachable.

    Every round takes the neighbours' least label and then the label's label,
    so that rounds grow as the logarithm of the longest path.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")))
    while True:
        near = edges.join(labels, edges["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(near, labels["v"] == near["a"], "left").select("v", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("mid"))
        parent = labels.select(F.col("v").alias("p"), F.col("comp").alias("up"))
        labels_new = cut_lineage(moved.join(parent, moved["mid"] == parent["p"], "left").select("v", "old", F.least("mid", F.coalesce("up", "mid")).alias("comp")))
        done = labels_new.where("old <> comp").limit(1).count() == 0
        labels = labels_new.select("v", "comp")
        if done:
            return labels


def _set(packed: bytes) -> np.ndarray:
    return unpack_sorted(packed) if packed else np.empty(0, dtype=np.uint64)


def _packed_sets(texts: DataFrame) -> DataFrame:
    """(rep, text) to (rep, set): each text's shingles, packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in slices(batch, "text", 1_000_000):
                packed = [pack_sorted(x) if len(x) else b"" for x in shingle_sets(run)]
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(first, len(run)), pa.array(packed, pa.binary())], names=["rep", "set"])

    return texts.mapInArrow(work, "rep long, set binary")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar. sets: (rep, set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [i for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)) if similar(_set(x.as_py()), _set(y.as_py()))]
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long"))


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of a to rows of b from their coordinates (chance hits of one byte taken off)."""
    hit = (a[:, None, :] == b[None, :, :]).mean(axis=2)
    return (hit - 1 / 256) / (1 - 1 / 256)


def _may_link(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule a link out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb")]
            hit = (x[0] == x[1]).mean(axis=1)
            mask = pa.array((hit - 1 / 256) / (1 - 1 / 256) >= LEAST_ESTIMATE)
            yield batch.select(["a", "b"]).filter(mask)

    left = signs.select(F.col("rep").alias("a"), F.col("sign").alias("sa"))
    right = signs.select(F.col("rep").alias("b"), F.col("sign").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between the tile's probes and its members that are not yet of one component.

    Signatures choose the pairs, full sets decide; what isn't a link stays here.
    """
    reps, comps = table.column("rep").to_numpy(), table.column("comp").to_numpy()
    probe = np.array(table.column("probe").to_pylist(), dtype=bool)
    signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
    packed = table.column("set")
    rows, cols = np.flatnonzero(probe), np.flatnonzero(~probe)
    found = []
    for at in range(0, len(rows), 64):
        r = rows[at : at + 64]
        maybe = (_estimates(signs[r], signs[cols]) >= LEAST_ESTIMATE) & (comps[r][:, None] != comps[cols][None, :])
        sets: dict[int, np.ndarray] = {}
        for i, j in zip(*(x.tolist() for x in (r[maybe.nonzero()[0]], cols[maybe.nonzero()[1]])), strict=True):
            for x in (i, j):
                if x not in sets:
                    sets[x] = _set(packed[x].as_py())
            if similar(sets[i], sets[j]):
                found.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return pa.table({"a": pa.array([int(e[0]) for e in found], pa.int64()), "b": pa.array([int(e[1]) for e in found], pa.int64())})


def _tiles(named: DataFrame, sizes: DataFrame, part_rows: int, part_shingles: int) -> DataFrame:
    """(key, row, col, rep, comp, probe) of those groups of named (key, rep, comp) that are not one component.

    A group's members outside its largest component are its probes. Each probe
    part meets each part of all members in one tile, so that a tile's content
    is bounded on both sides; a group with few probes is sent once.
    """
    weighed = named.join(sizes, "rep")
    member = lambda salt: F.sum(F.xxhash64("rep", F.lit(salt)).bitwiseAND((1 << 36) - 1))
    by_comp = weighed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("weight"), member(1).alias("m1"), member(2).alias("m2"))
    main = F.max(F.struct("n", "comp", "weight")).alias("main")
    groups = by_comp.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.sum("weight").alias("weight"), main, F.sum("m1").alias("m1"), F.sum("m2").alias("m2")).where("comps > 1")
    # Bands whose groups have the same members ask the same question: one of them asks it.
    parts = lambda n, w: F.ceil(F.greatest(n / part_rows, w / part_shingles, F.lit(1))).cast("int")
    groups = groups.groupBy("size", "m1", "m2").agg(F.min(F.struct("key", "main", "weight")).alias("g"))
    groups = groups.select("g.key", F.col("g.main.comp").alias("main"), parts(F.col("size"), F.col("g.weight")).alias("cols"), parts(F.col("size") - F.col("g.main.n"), F.col("g.weight") - F.col("g.main.weight")).alias("rows"))
    own = named.join(groups, "key")
    part = lambda of: F.array(F.pmod(F.xxhash64("rep"), F.col(of)).cast("int"))
    all_of = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    sides = F.array(F.when(F.col("comp") != F.col("main"), F.struct(F.lit(True).alias("probe"), part("rows").alias("r"), all_of("cols").alias("c"))), F.struct(F.lit(False).alias("probe"), all_of("rows").alias("r"), part("cols").alias("c")))
    sided = own.select("key", "rep", "comp", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s"))
    return sided.select("key", "rep", "comp", "s.probe", F.explode("s.r").alias("row"), F.col("s.c").alias("c")).select("key", "rep", "comp", "probe", "row", F.explode("c").alias("col"))


def _of_one_id(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that several texts share."""
    one = F.struct("h1", "h2", "n")
    several = some.groupBy("id").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high").select("id")
    own = some.join(several, "id", "left_semi").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).select("id", "rep").distinct()
    least = own.groupBy("id").agg(F.min("rep").alias("a"))
    return own.join(least, "id").where("rep > a").select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Per row: id, n_shingles, component_id and kept.

    Documents of 100 * |A and B| >= 75 * |A or B| are linked; component_id is
    the smallest id reachable, kept whether it is the row's own. Documents
    without words link with nothing and are kept. The id is an integer. Rows of
    null id join their copies' component if those have an id; their component is
    null otherwise, and they are kept. Rows of equal id are one document: each
    of its texts links it. Texts of any length are one row with one set, read
    whole. Other columns of docs, whatever their names, don't go through. An
    empty table gives an empty result.

    part_rows and part_shingles bound what a task holds of a large group whose
    members aren't linked; they change no result.
    """
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    signed = cut_lineage(rows.mapInArrow(_signed, "id long, n long, h1 long, h2 long, sign binary"))
    total = signed.count()
    some = signed.where("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sign").alias("sign"))
    n_blocks = max(16, -(-total // BLOCK_ROWS))
    bits = max(4, int(np.ceil(np.log2(n_blocks / 4))))
    in_block = classes.select(F.pmod(F.xxhash64("h1", "h2"), F.lit(n_blocks)).cast("int").alias("__block"), "rep", "n", "sign")
    blocks = in_block.groupBy("__block")
    asked = blocks.applyInArrow(_ask(bits), "bucket int, __block int, names binary, twice binary")
    shared = asked.groupBy("bucket").applyInArrow(_shared, "__block int, bucket int, flags binary")
    found = cut_lineage(blocks.cogroup(shared.groupBy("__block")).applyInArrow(_candidates(bits), "rep long, n long, sign binary, keys array<long>"))
    signs = found.select("rep", "sign")
    texts = rows.join(found.select("rep"), F.col("__id") == F.col("rep")).select("rep", F.coalesce("__text", F.lit("")).alias("text")).distinct()
    sets = cut_lineage(_packed_sets(texts))
    members = found.select("rep", F.explode("keys").alias("key"))

    first = members.groupBy("key").agg(F.min("rep").alias("a"))
    pairs = members.join(first, "key").where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    links = _verify(_may_link(pairs, signs), sets)
    comps = components(links)

    named = members.join(comps, members["rep"] == comps["v"], "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    tiled = _tiles(named, found.groupBy("rep").agg(F.sum("n").alias("n")), part_rows, part_shingles).join(signs.join(sets, "rep"), "rep")
    more = tiled.groupBy("key", "row", "col").applyInArrow(_tile, "a long, b long").where("a < b").distinct()
    comps = components(links.union(more).union(_of_one_id(some, classes)))

    own = signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    own = own.join(comps, own["rep"] == comps["v"], "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = signed.select("id", "n", "h1", "h2").join(own, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that are near duplicates of a smaller id. Rows of null id stay."""
    gone = near_duplicates(docs, id, text).where("NOT kept").select(F.col(f"`{id}`").cast(docs.schema[id].dataType).alias(id)).where(F.col(f"`{id}`").isNotNull()).distinct()
    return docs.join(gone, id, "left_anti").select(*docs.columns)
