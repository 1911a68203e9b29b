"""Near-duplicate groups by SuperMinHash: signatures, banding, verification on full sets, union-find.

1. Every whole text becomes a shingle set and a signature.  Texts with equal sets form a class; the smallest doc_id
   stands for it.  So thousands of copies cost one row from here on.
2. Classes that share a band key meet in a bucket.  Buckets of any size are split into blocks of about ``BLOCK`` rows,
   with a few rows common to all blocks; no task holds a bucket.
3. Round one compares each row of a block with the rows whose signatures agree best with its own, and with the block's
   most central row.  Sets cut to 16 or 24 bits an element bound the intersection from above; of the pairs that can be
   links a spanning forest goes on, at most one link a row, to be confirmed on the full sets.  Round two does the same for
   rows still outside their bucket's largest component.
4. The last round is what makes the result whole: wherever a bucket of one block still spans two components, every pair
   across them that can reach the threshold (sizes, signatures and cut sets permitting) is confirmed; others never leave
   their task.  Rows of larger buckets that span two components, which may be many rows of little likeness, meet anew by
   a second, longer signature with more rows a band, and the same is done in those buckets.  Pairs inside a component
   need no check.

A pair at similarity s shares no band with probability (1 - s**rows)**(slots // rows): with 64 slots and 4 rows 7e-6 at 0.85;
below a threshold of 0.85 bands have 3 rows: 3e-7 at 0.80.  The second signature's 256 slots have 7 rows a band (9e-7) or 6
(3e-6).  Signatures are compared with a margin of 4.5 standard deviations before a pair is left out.  ``exact_links`` finds
the same links without signatures, by a prefix filter, at a higher cost; the tests hold the two together.

Null and empty texts and texts without words have no set and are linked with nothing.  Rows that repeat a doc_id count
as one document in the grouping, linked by any of their texts; a null doc_id is linked with nothing.  Empty tables give
empty tables; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, restored, shielded, slices, table, tidy, utf8
from .components import connected_components, more_connected
from .superminhash import bands, set_hashes, shingles, signatures
from .words import mix

SLOTS, BLOCK, COMMON, NEAREST, NARROW, LONGER = 64, 1024, 16, 4, 1024, 256
STEP = 1 << 20


def rows_of(percent: int) -> int:
    """Slots a band."""
    return 4 if percent >= 85 else 3


def signed(docs: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """key, n_shingles, h1, h2, sig (16 bits a slot), bands (keys)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for i, j in slices(offsets, STEP):
                e, at = shingles(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], size)
                sig = signatures(e, at, SLOTS)
                keys = bands(sig, rows_of(percent))
                h1, h2 = (h.view(np.int64) for h in set_hashes(e, at))
                low = (sig ^ (sig >> np.uint64(32))).astype(np.uint16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(h1), pa.array(h2), pa.array([x.tobytes() for x in low], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_shingles", "h1", "h2", "sig", "bands"])

    return docs.select(key, "text").mapInArrow(tidy(apply), f"`{key}` {dict(docs.dtypes)[key]}, n_shingles bigint, h1 bigint, h2 bigint, sig binary, bands array<bigint>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """doc, n_shingles, h1, h2, elements (the sorted 64-bit shingles of each text) and brief (their low bits, see ``Briefs``)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = utf8(batch.column(1))
            for i, j in slices(offsets, STEP):
                e, at = shingles(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]], size)
                each = [e[at[k] : at[k + 1]] for k in range(j - i)]
                brief = [(x & np.uint64(0xFFFF)).astype(np.uint16) if len(x) <= NARROW else (x & np.uint64(0xFFFFFF)).astype(np.uint32) for x in each]
                h1, h2 = (pa.array(h.view(np.int64)) for h in set_hashes(e, at))
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), h1, h2, *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (each, brief))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "h1", "h2", "elements", "brief"])

    return docs.select("doc", "text").mapInArrow(tidy(apply), "doc bigint, n_shingles bigint, h1 bigint, h2 bigint, elements binary, brief binary")


def longer_bands(members: DataFrame, percent: int) -> DataFrame:
    """node and the band keys of a second signature, from the elements."""
    rows = 7 if percent >= 85 else 6

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = utf8(batch.column(1))
            for i, j in slices(at, STEP):
                e = np.frombuffer(raw[at[i] : at[j]].tobytes(), np.uint64)
                sig = signatures(mix(e ^ np.uint64(0x5851F42D4C957F2D)), (at[i : j + 1] - at[i]) // 8, LONGER)
                keys = bands(sig, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["node", "bands"])

    return members.select("node", "elements").mapInArrow(apply, "node bigint, bands array<bigint>")


class Briefs:
    """Sets cut to 16 bits an element, or to 24 where they have more than NARROW elements."""

    def __init__(self, t: pa.Table):
        self.at, self.raw = utf8(t.column("brief"))
        self.size = t.column("n_shingles").to_numpy()
        self.tables = {16: np.zeros(1 << 16, bool), 24: None}

    def row(self, i: int, bits: int) -> np.ndarray:
        x = self.raw[self.at[i] : self.at[i + 1]].tobytes()
        x = np.frombuffer(x, np.uint16 if self.size[i] <= NARROW else np.uint32)
        return x if bits == 24 or self.size[i] <= NARROW else x & 0xFFFF

    def reach(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` may have 100 * |A & B| >= percent * |A | B| with row i: an equal pair of elements is equal when cut."""
        out = np.zeros(len(others), bool)
        for wide in (False, True):  # both sets wide, or cut to 16 bits
            pick = np.flatnonzero((np.minimum(self.size[others], self.size[i]) > NARROW) == wide)
            if not len(pick):
                continue
            bits = 24 if wide else 16
            if self.tables[bits] is None:
                self.tables[bits] = np.zeros(1 << bits, bool)
            mine, has = self.row(i, bits), self.tables[bits]
            has[mine] = True
            both = np.array([np.count_nonzero(has[self.row(int(j), bits)]) for j in others[pick]])
            has[mine] = False
            out[pick] = 100 * both >= percent * (self.size[i] + self.size[others[pick]] - both)
        return out


def forest(i: np.ndarray, j: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Positions of the pairs (i, j) that join two trees, in order; trees start from equal names."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    keep = []
    for k, (a, b) in enumerate(zip(name[i].tolist(), name[j].tolist(), strict=True)):
        if (a := root(a)) != (b := root(b)):
            parent[a] = b
            keep.append(k)
    return np.array(keep, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups (rows sorted by their first ``keys`` columns) and where the groups begin, with the end."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        change[:1] = True
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, s[-1]), s
            held = t.slice(s[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.concatenate([starts(t), [t.num_rows]])


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(utf8(t.column("sig"))[1].tobytes(), np.uint16).reshape(-1, SLOTS)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal slots of each row of a with each of b."""
    out = np.empty((len(a), len(b)), np.int16)
    for i in range(0, len(a), 32):
        out[i : i + 32] = (a[i : i + 32, None] == b[None]).sum(2)
    return out


def _bands(t: pa.Table) -> np.ndarray:
    return pc.list_flatten(t.column("bands")).to_numpy().reshape(t.num_rows, -1)


def _earlier(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether rows i of a and b, band keys, meet in a band before this one, too."""
    return (a[:, :band] == b[:, :band]).any(1)


def nearest_links(percent: int) -> callable:
    """A forest of likely links for each block; with a column ``comp``, only links between components."""
    share = percent / 100
    least = share - 4.5 * (share * (1 - share) / SLOTS) ** 0.5

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3):
            band, node, size, sig = t.column("band").to_numpy(), t.column("node").to_numpy(), t.column("n_shingles").to_numpy(), _signatures(t)
            keys = _bands(t)
            comp = t.column("comp").to_numpy() if "comp" in t.column_names else None
            name = comp if comp is not None else node
            briefs = Briefs(t)
            left, right = [], []

            def fits(i, j, agree):
                ok = (agree >= least * SLOTS) & (np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j]))  # noqa: B023
                return ok & (comp[i] != comp[j]) if comp is not None else ok  # noqa: B023

            n = np.diff(starts)
            two = starts[:-1][n == 2]
            ok = fits(two, two + 1, (sig[two] == sig[two + 1]).sum(1))
            for b in np.unique(band[two]):
                pick = two[ok & (band[two] == b)]
                pick = pick[~_earlier(keys[pick], keys[pick + 1], int(b))]
                pick = pick[[bool(briefs.reach(int(x), np.array([x + 1]), percent)[0]) for x in pick]] if len(pick) else pick
                left.append(pick)
                right.append(pick + 1)
            for s, m in zip(starts[:-1][n > 2], n[n > 2], strict=True):
                rows = np.arange(s, s + m)
                agree = _agree(sig[rows], sig[rows])
                i, j = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(m), indexing="ij"))
                ok = fits(rows[i], rows[j], agree.ravel()).reshape(m, m) & ~np.eye(m, dtype=bool)
                ranked = np.where(ok, agree, -1)
                hub = int(ranked.sum(1).argmax())
                best = np.argpartition(-ranked, min(NEAREST, m - 1), 1)[:, :NEAREST] if m > NEAREST else np.tile(np.arange(m), (m, 1))
                best = np.concatenate([np.full((m, 1), hub), best], 1)
                found = []
                for i in range(m):
                    j = np.unique(best[i][ok[i, best[i]]])
                    j = rows[j[(j > i) | ~(best[j] == i).any(1)]]  # of two that choose each other, the first asks
                    if len(j):
                        found.append((rows[i], j[briefs.reach(int(rows[i]), j, percent)]))
                i = np.concatenate([np.zeros(0, np.int64), *(np.full(len(j), i) for i, j in found)]).astype(np.int64)
                j = np.concatenate([np.zeros(0, np.int64), *(j for _, j in found)]).astype(np.int64)
                tree = forest(i, j, name)
                i, j = i[tree], j[tree]
                left.append(i)
                right.append(j)
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    return apply


def all_links(percent: int) -> callable:
    """All pairs across components that can reach the threshold: rows with ``guest`` against the block's own."""
    share = percent / 100
    least = share - 4.5 * (share * (1 - share) / SLOTS) ** 0.5

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3):
            band, node, size, sig = t.column("band").to_numpy(), t.column("node").to_numpy(), t.column("n_shingles").to_numpy(), _signatures(t)
            keys = _bands(t)
            comp, guest, stray = t.column("comp").to_numpy(), t.column("guest").to_numpy(zero_copy_only=False), t.column("stray").to_numpy(zero_copy_only=False)
            briefs = Briefs(t)
            for s, z in zip(starts[:-1], starts[1:], strict=True):
                guests, own = np.flatnonzero(guest[s:z]) + s, np.flatnonzero(~guest[s:z]) + s
                for at in range(0, len(guests), 64):
                    g = guests[at : at + 64]
                    ok = _agree(sig[g], sig[own]) >= least * SLOTS
                    ok &= comp[g][:, None] != comp[own]
                    ok &= np.minimum(size[g][:, None], size[own]) >= share * np.maximum(size[g][:, None], size[own])
                    ok &= ~stray[own] | (node[g][:, None] < node[own])  # two strays meet twice
                    i, j = np.nonzero(ok)
                    i, j = g[i], own[j]
                    new = ~_earlier(keys[i], keys[j], int(band[s]))
                    i, j = i[new], j[new]
                    may = [briefs.reach(int(x), j[i == x], percent) for x in np.unique(i)]
                    may = np.concatenate([np.zeros(0, bool), *may])
                    i, j = i[may], j[may]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    return apply


def confirm(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A & B| >= percent * |A | B| on the full sets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x_at, x), (y_at, y) = utf8(batch.column(2)), utf8(batch.column(3))
            keep = []
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(v[at[k] : at[k + 1]].tobytes(), np.uint64) for v, at in ((x, x_at), (y, y_at)))
                if len(p) > len(q):
                    p, q = q, p
                if not len(p):
                    continue
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    x = members.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    y = members.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    joined = pairs.join(x, "a").select("a", "b", "x").join(y, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(tidy(apply), "a bigint, b bigint")


def blocks(buckets: DataFrame, with_common: bool) -> DataFrame:
    """buckets with block: rows of a bucket dealt by hash over ceil(cnt / BLOCK) blocks, some common to all."""
    n = F.ceil(F.col("cnt") / BLOCK).cast("int")
    home = F.pmod(F.xxhash64("node"), n).cast("int")
    every = F.sequence(F.lit(0), n - 1)
    if not with_common:
        return buckets.withColumn("home", home).withColumn("every", every)
    common = F.pmod(F.xxhash64("node", F.lit("common")), F.col("cnt")) < COMMON
    return buckets.withColumn("block", F.explode(F.when(common & (n > 1), every).otherwise(F.array(home))))


def dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "band", "key", "block").sortWithinPartitions("band", "key", "block")


ROWS = ["band", "key", "block", "node", "n_shingles", "sig", "bands"]


def spanning(buckets: DataFrame) -> DataFrame:
    """Rows (with comp) of the buckets that span two components, with main, the largest, and cnt, the bucket's rows."""
    tally = buckets.groupBy("band", "key", "comp").agg(F.count("*").alias("n")).groupBy("band", "key")
    tally = tally.agg(F.count("*").alias("comps"), F.sum("n").alias("cnt"), F.max(F.struct("n", F.col("comp").alias("main"))).alias("most"))
    return buckets.drop("cnt").join(tally.where("comps > 1").select("band", "key", "cnt", F.col("most.main").alias("main")), ["band", "key"])


def across(mixed: DataFrame, briefs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across the components of a bucket that can reach the threshold: strays against all blocks."""
    mixed = blocks(mixed.withColumn("stray", F.col("comp") != F.col("main")), False).join(briefs, "node")
    rows = [*ROWS, "comp", "brief", "guest", "stray"]
    own = mixed.withColumn("guest", F.lit(False)).withColumn("block", F.col("home")).select(*rows)
    strays = mixed.where("stray").withColumn("guest", F.lit(True)).withColumn("block", F.explode("every")).select(*rows)
    return dealt(own.unionByName(strays)).mapInArrow(all_links(percent), "a bigint, b bigint")


def groups(docs: DataFrame, key: str = "doc_id", size: int = 3, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id, kept for each row of ``docs`` (key: an integer)."""
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), "text")
    # numbers of rows, fixed by the writing; a class goes by that of one of its rows
    table_ = materialize(signed(docs, "doc", size, percent).withColumn("row", F.monotonically_increasing_id()), "signed")
    linked = table_.where("n_shingles > 0 AND doc IS NOT NULL")
    classes = linked.groupBy("n_shingles", "h1", "h2").agg(F.min(F.struct("row", "doc")).alias("first"), F.min("doc").alias("least"))
    classes = materialize(classes.select("n_shingles", "h1", "h2", F.col("first.row").alias("node"), F.col("first.doc").alias("doc"), "least"), "classes")
    reps = linked.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    reps = materialize(reps.select(F.col("row").alias("node"), "n_shingles", "sig", "bands"), "reps")
    keyed = reps.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    buckets = keyed.join(shared, ["band", "key"]).join(reps, "node")
    buckets = materialize(buckets.select("band", "key", "cnt", "node", "n_shingles", "sig", "bands"), "buckets")
    met = classes.join(buckets.select("node").distinct(), "node").select("node", "doc", "n_shingles", "h1", "h2")
    # a merge join at every size, so that small inputs behave like large ones
    found = sets(docs.hint("merge").join(met.select("doc").distinct(), "doc", "left_semi"), size).join(met, ["doc", "n_shingles", "h1", "h2"])
    members = materialize(found.select("node", "elements", "brief").dropDuplicates(["node"]), "sets")  # rows of one node have equal sets
    briefs = members.select("node", "brief")

    rows = blocks(buckets, True).select(*ROWS).join(briefs, "node").select(*ROWS, "brief")
    pairs = dealt(rows).mapInArrow(nearest_links(percent), "a bigint, b bigint").distinct()
    # the texts of one doc_id belong together
    several = linked.groupBy("doc").agg(F.min(F.struct("n_shingles", "h1", "h2")).alias("a"), F.max(F.struct("n_shingles", "h1", "h2")).alias("b")).where("a <> b").select("doc")
    several = linked.select("doc", "n_shingles", "h1", "h2").join(several, "doc").join(classes.select("n_shingles", "h1", "h2", "node"), ["n_shingles", "h1", "h2"])
    same = several.groupBy("doc").agg(F.min("node").alias("a"), F.collect_set("node").alias("b")).select("a", F.explode("b").alias("b")).where("a <> b")
    links = materialize(confirm(pairs, members, percent).unionByName(same), "links")
    roots, old = materialize(connected_components(links), "roots"), [links]
    for last in (False, True):
        mixed = buckets.join(roots, "node", "left").select(*buckets.columns, F.coalesce("root", "node").alias("comp"))
        mixed = materialize(spanning(mixed), "mixed")
        old.append(mixed)
        if not last:
            rows = blocks(mixed, True).select(*ROWS, "comp").join(briefs, "node").select(*ROWS, "comp", "brief")
            pairs = dealt(rows).mapInArrow(nearest_links(percent), "a bigint, b bigint")
        else:
            small, large = mixed.where(F.col("cnt") <= BLOCK), mixed.where(F.col("cnt") > BLOCK)
            pairs = across(small, briefs, percent)
            again = large.select("node", "n_shingles", "sig", "comp").distinct()
            if not again.isEmpty():
                again = again.join(longer_bands(members.join(again.select("node"), "node", "left_semi"), percent), "node")
                again = materialize(again, "again")
                old.append(again)
                again = again.select("*", F.posexplode("bands").alias("band", "key"))
                pairs = pairs.unionByName(across(spanning(again), briefs, percent))
        links = materialize(confirm(pairs.distinct(), members, percent), "links")
        roots, before = materialize(more_connected(roots, links), "roots"), roots
        discard(links, before, *old)
        old = []
    discard(reps, buckets, members)
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = placed.join(names, "root").select("n_shingles", "h1", "h2", "component")
    out = table_.select("doc", "n_shingles", "h1", "h2").join(placed, ["n_shingles", "h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def exact_links(docs: DataFrame, key: str = "doc_id", size: int = 3, percent: int = 85) -> DataFrame:
    """All links (a, b), a < b, between documents, without signatures: the exact way that ``groups`` is held against.

    Prefix filter: with elements in one order, rare ones first, sets that reach the threshold share one of the first
    n - ceil(n * percent / 100) + 1 of each.  Those meet by element and are confirmed on the full sets."""
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), "text").where("doc IS NOT NULL")
    members = materialize(sets(docs, size).where("n_shingles > 0").select("doc", "n_shingles", "elements"), "exact")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = utf8(batch.column(2))
            who = np.repeat(np.arange(batch.num_rows), np.diff(at) // 8)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(who)) for k in (0, 1)), pa.array(np.frombuffer(raw.tobytes(), np.int64))], names=["doc", "n", "e"])

    each = members.mapInArrow(listed, "doc bigint, n bigint, e bigint")
    often = each.groupBy("e").agg(F.count("*").alias("times")).where("times > 1")
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.coalesce("times", F.lit(1)), "e"))
    first = each.join(often, "e", "left").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("times > 1")
    x, y = (first.select(F.col("doc").alias(end), "e", F.col("n").alias(f"n_{end}")) for end in "ab")
    near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("a") < F.col("b"))
    pairs = x.join(y, "e").where(near).select("a", "b").distinct()
    return confirm(pairs, members.withColumnRenamed("doc", "node"), percent)


def query(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """One document of each group; the columns of documents.  Words in fives, similarity 0.8 or more.

    Of the rows that repeat a kept doc_id the first by text stays; rows without a doc_id all stay."""
    rows, own = shielded(docs)
    doc_id = own[[c.lower() for c in docs.columns].index("doc_id")]
    out = groups(docs.select(F.col("`doc_id`"), F.col("`text`")), size=5, percent=80)
    dropped = out.where(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct()
    left = rows.join(dropped, doc_id, "left_anti")
    # rows without an id are spread by their texts
    first = Window.partitionBy(doc_id, F.when(F.col(doc_id).isNull(), F.xxhash64("text"))).orderBy(F.col("text").asc_nulls_last())
    left = left.withColumn("__place", F.row_number().over(first)).where((F.col("__place") == 1) | F.col(doc_id).isNull())
    return left.select(*restored(docs, own))
