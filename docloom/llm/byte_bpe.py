"""Byte-level BPE encoding and decoding: distinct words are folded once, by Spark higher-order functions.

1. Texts are cut once, by the tokenizer's pattern, in Arrow batches.  A text becomes the codes of its units (words, see
   below); about ``CHUNK`` bytes of text share one list of distinct units.  Both are written to the shared folder, in
   buckets by chunk.
2. The distinct units of all chunks meet by crc32, a bucket of them at a time, and each is folded once: the state is the
   pieces and the ranks of the neighbouring pairs, and a step merges the leftmost pair of the lowest rank, until no pair
   has a rank.  Bytes are handled as strings of one character a byte (ISO-8859-1).  Ranks are one value for all rows: an
   array of small maps, indexed by crc32 of the piece, as one large map would be searched from end to end.  Its size is
   the vocabulary's.
3. Ids go back to the chunks, and each chunk's texts are put together from them.

So a word costs one fold for the corpus and one entry a chunk, however often it occurs; texts aren't shuffled at all.
Both ways, the entries that a chunk and a bucket share are one value of packed numbers and bytes, as a row each would take
several times their size.  Buckets grow in number with the entries, so that one holds about ``MEET`` of them at most.
Words that are pieces need no fold; neither do the ``hot`` most frequent units of a bounded sample of documents, which are
folded beforehand and broadcast.  That saves rows and changes no result: every other unit goes the way above.  Codes are
small for frequent units, and their bytes are stored plane by plane, which compresses.

The fold takes time with the square of a unit's length.  Words of more bytes than the longest piece are first cut
wherever no piece that occurs there reaches across; no merge can cross such a place, so the parts are units of their
own.  A part that still has over ``LONGEST`` bytes (a long run of one character, say) is merged from a heap, with the same
result, and its pieces become the units.

Decoding concatenates the ids' binary pieces.  Null and empty texts have no ids; repeated rows get equal results; an
empty table gives an empty table; columns of any name and type are carried along, but ValueError says so if one has the
name of an output.  The texts must come from stored tables (a recomputed partition has its rows in the same order).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import release, shared_dir, table, tidy, utf8

LONGEST = 256
BUCKETS = 1 << 16
CHUNK, HELD = 32 << 20, 4 << 20
#: Entries of a bucket, about; up to BLOBS buckets they may be fewer, for the sake of parallel tasks.
MEET, BLOBS = 1 << 18, 1 << 12
#: Texts of more characters are cut a block of words at a time.
BLOCK = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rank_maps(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map: an array of maps, of which crc32 of the piece picks one.  A subquery of one stored row, as a plan that holds
    the map itself is described with it, megabytes each time, and the driver keeps every description."""
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        maps[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    one = pa.array([[list(m.items()) for m in maps]], pa.list_(pa.map_(pa.string(), pa.int32())))
    return spark.createDataFrame(pa.table({"ranks": one})).scalar()


def look_up(maps: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(maps, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece)


def fold(word: Column, rank) -> Column:
    """ids of one word, given as a string of bytes; ``rank(piece)`` looks a piece up.

    State: the pieces, each with the rank of its concatenation with the next one (null: none)."""

    def merge(state: Column, least: Column) -> Column:
        pieces, ranks = state["pieces"], state["ranks"]
        rest = F.size(pieces)

        def at(i: Column) -> Column:  # from 1: merges pieces i and i + 1
            def joined(both: Column) -> Column:
                last = F.array(F.when(i + 1 < F.size(pieces), rank(F.concat(both, F.get(pieces, i + 1)))))
                new = F.when(i > 1, F.concat(F.slice(ranks, F.lit(1), i - 2), F.array(rank(F.concat(F.get(pieces, i - 2), both))), last, F.slice(ranks, i + 2, rest)))
                new = new.otherwise(F.concat(last, F.slice(ranks, F.lit(3), rest)))
                return F.struct(F.concat(F.slice(pieces, F.lit(1), i - 1), F.array(both), F.slice(pieces, i + 2, rest)).alias("pieces"), new.alias("ranks"))

            return _let(F.concat(F.get(pieces, i - 1), F.get(pieces, i)), joined)

        return _let(F.array_position(ranks, least).cast("int"), at)

    def step(state: Column, _) -> Column:
        return _let(F.array_min(state["ranks"]), lambda least: F.when(least.isNull(), state).otherwise(merge(state, least)))

    size = F.length(word)
    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
    ranks = F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i < size, rank(F.substring(word, i, F.lit(2)))))
    done = F.aggregate(F.sequence(F.lit(1), size), F.struct(pieces.alias("pieces"), ranks.alias("ranks")), step, lambda s: s["pieces"])
    return F.transform(done, rank)


def heap_merge(piece: bytes, ranks: dict[bytes, int], whole: bool = True) -> list[int]:
    """The same merges as ``fold`` for a piece of any length: lowest rank first, leftmost among equals.

    ``whole``: a piece of the vocabulary is itself, without merges."""
    if whole and piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int):
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        pair(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def heap_pieces(part: bytes, ranks: dict[bytes, int]) -> Iterator[bytes]:
    """The pieces that ``part`` merges to, without taking it whole."""
    if len(part) > 1 and part in ranks:
        ends = heap_merge(part, ranks, whole=False)
        if ends == [ranks[part]]:
            yield part
            return
    by_rank = {r: p for p, r in ranks.items()} if len(part) > 1 else {ranks[part]: part}
    yield from (by_rank[r] for r in heap_merge(part, ranks, whole=False))


def parts(word: bytes, ranks: dict[bytes, int], longest: int) -> list[bytes]:
    """``word`` cut wherever no piece that occurs in it there reaches across: merges never cross such a place."""
    n, reach, begin, out = len(word), 0, 0, []
    for i in range(n):
        if i and reach <= i:
            out.append(word[begin:i])
            begin = i
        for j in range(min(n, i + longest), max(reach, i + 1), -1):
            if word[i:j] in ranks:
                reach = j
                break
    return [*out, word[begin:]]


class Cutter:
    """Cuts texts into units and numbers them: those of ``known`` by place, then a chunk's own by appearance.

    What a chunk adds is one entry a distinct word; words are kept as they come out of the text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: Iterable[bytes]):
        import regex

        self.find = regex.compile(pattern)
        self.ranks, self.longest, self.first = ranks, max(map(len, ranks)), 0
        self.known: dict[str, int] = {}
        self.odd: dict[bytes, int] = {}  # pieces that are no text on their own
        for unit in known:
            try:
                self.known[unit.decode()] = self.first
            except UnicodeDecodeError:
                self.odd[unit] = self.first
            self.first += 1
        outer = self

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                """A word's code; of a long one, -1 less its place among the chunk's lists of parts."""
                code = outer.known.get(word)
                if code is None:
                    code = outer._new(word) if len(word) * 4 <= outer.longest or len(word.encode()) <= outer.longest else outer._long(word.encode())
                self[word] = code
                return code

        self._fresh = Codes
        self.start()

    def start(self) -> None:
        """A new chunk."""
        self.own: list[str | bytes] = []
        self.parts: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.codes = self._fresh()

    def units(self) -> list[bytes]:
        """The chunk's own units, in the order of their codes."""
        return [u.encode() if isinstance(u, str) else u for u in self.own]

    def _new(self, unit: str | bytes) -> int:
        self.own.append(unit)
        return self.first + len(self.own) - 1

    def _part(self, raw: bytes) -> int:
        """The code of a part of a long word."""
        if (code := self.odd.get(raw)) is not None:
            return code
        if len(raw) <= self.longest:
            try:
                return self.codes[raw.decode()]
            except UnicodeDecodeError:
                pass
        if raw not in self.parts:
            self.parts[raw] = self._new(raw)
        return self.parts[raw]

    def _long(self, raw: bytes) -> int:
        out = []
        for part in parts(raw, self.ranks, self.longest):
            if part in self.ranks or len(part) > LONGEST:
                out += [self._part(p) for p in heap_pieces(part, self.ranks)]
            else:
                out.append(self._part(part))
        self.lists.append(np.array(out, np.int64))
        return -len(self.lists)

    def words(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield self.find.findall(text)
            return
        found = (m[0] for m in self.find.finditer(text))
        while block := list(itertools.islice(found, BLOCK >> 3)):
            yield block

    def cut(self, text: str | None) -> np.ndarray:
        """Codes of a text's units, in order."""
        out = [np.zeros(0, np.uint32)]
        for words in self.words(text or ""):
            codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
            if len(codes) and codes.min() < 0:
                codes = np.concatenate([self.lists[-c - 1] if c < 0 else np.array([c]) for c in codes.tolist()])
            out.append(codes.astype(np.uint32))
        return np.concatenate(out)


class Tokenizer:
    """One vocabulary: ranks of byte strings and the pattern that cuts texts into words."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark, self.ranks, self.pattern = spark, ranks, pattern
        self.maps = rank_maps(spark, ranks)

    def unit_ids(self, units: DataFrame, unit: str) -> DataFrame:
        """``units`` with ids of its column ``unit``, binary or an array of such; a unit that is a piece itself needs no merges."""
        many = isinstance(units.schema[unit].dataType, ArrayType)

        def ids(ranks: Column) -> Column:
            def rank(piece: Column) -> Column:
                return look_up(ranks, piece)

            def of(raw: Column) -> Column:
                return _let(rank(raw), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold(raw, rank)))

            def one(value: Column) -> Column:
                return _let(F.decode(value, "ISO-8859-1"), of)

            return F.transform(unit, one) if many else one(F.col(unit))

        # functions of arrays take no subquery; the optimizer merges both steps, so that no row gets the maps
        return units.select("*", self.maps.alias("__ranks")).select(*units.columns, _let(F.col("__ranks"), ids).alias("ids"))

    def decode(self, texts: DataFrame, ids: str, name: str) -> DataFrame:
        """``texts`` with the binary pieces of the array ``ids`` concatenated; null ids give null."""
        pieces = [""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            pieces[v] = k.hex()
        each = _let(F.split(F.lit(",".join(pieces)), ","), lambda hex_: F.transform(F.col(ids), lambda i: F.get(hex_, i)))
        return texts.select("*", F.unhex(F.array_join(each, "")).alias(name))

    def known_units(self, texts: DataFrame, documents: int, hot: int) -> tuple[pa.Array, pa.Array]:
        """Units and their ids: the ``hot`` most frequent of about ``documents`` of the texts, then all other pieces."""
        n, ranks, pattern = texts.count(), self.ranks, self.pattern

        def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cutter, named = Cutter(ranks, pattern, ranks), list(ranks)
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    cutter.start()
                    counts: Counter[int] = Counter()
                    for text in batch.column(0).slice(i, 512):
                        codes, times = np.unique(cutter.cut(text.as_py()), return_counts=True)
                        counts.update(dict(zip(codes.tolist(), times.tolist(), strict=True)))
                    units = named + cutter.units()
                    yield pa.RecordBatch.from_arrays([pa.array([units[c] for c in counts], pa.binary()), pa.array(counts.values(), pa.int64())], names=["unit", "times"])

        sample = texts.sample(min(1.0, documents / max(n, 1)), seed=1).mapInArrow(tidy(apply), "unit binary, times bigint")
        top = sample.groupBy("unit").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "unit").limit(hot)
        found = self.unit_ids(top.repartition(min(64, 1 + hot // 4000)), "unit").toArrow().sort_by([("times", "descending"), ("unit", "ascending")])
        units, ids = (found[c].cast(t).combine_chunks() for c, t in (("unit", pa.binary()), ("ids", pa.list_(pa.int32()))))
        pieces, own = pa.array(ranks, pa.binary()), pa.array(([r] for r in ranks.values()), pa.list_(pa.int32()))
        rest = pc.invert(pc.is_in(pieces, units))
        return pa.concat_arrays([units, pieces.filter(rest)]), pa.concat_arrays([ids, own.filter(rest)])


def _runs(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, with the end."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _cut(raw: bytes, at: np.ndarray) -> list[bytes]:
    at = at.tolist()
    return [raw[a:z] for a, z in zip(at, at[1:])]


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers of 32 bits plane by plane: all their lowest bytes, all second ones, and so on."""
    return [p.tobytes() for p in numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def _numbers(planes: Iterable[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).view("<u4").ravel()


def packed(places: np.ndarray, at: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """One value for the entries between each two of ``ends``: their places, their lengths and what they hold, the numbers
    plane by plane.  Entry i is flat[at[i]:at[i + 1]], numbers or bytes."""
    heads = [*_planes(places), *_planes(np.diff(at))]
    bodies = [flat.tobytes()] if flat.itemsize == 1 else _planes(flat)
    inner, ends = at[ends].tolist(), ends.tolist()
    return [b"".join([*[p[a:z] for p in heads], *[p[b:y] for p in bodies]]) for a, z, b, y in zip(ends, ends[1:], inner, inner[1:])]


def unpacked(values: list[bytes], counts: list[int], wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, at, flat) of the entries of all ``values``, which hold ``counts`` of them; ``wide``: of numbers."""
    heads = [b"".join([v[i * n : (i + 1) * n] for v, n in zip(values, counts, strict=True)]) for i in range(8)]
    rest = [v[8 * n :] for v, n in zip(values, counts, strict=True)]
    if wide:
        flat = _numbers(b"".join([r[i * (len(r) >> 2) : (i + 1) * (len(r) >> 2)] for r in rest]) for i in range(4))
    else:
        flat = np.frombuffer(b"".join(rest), np.uint8)
    return _numbers(heads[:4]), _runs(_numbers(heads[4:])), flat


def deal(buckets: int, parts: int):
    """For mapInArrow: the entries of each chunk's units, dealt to buckets by crc32 and packed; ``part`` is a bucket's partition."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, units in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (n := len(units)):
                    continue
                units = units.values
                bucket = np.fromiter((zlib.crc32(u) for u in units.to_pylist()), np.int64, n) % buckets
                order = np.argsort(bucket, kind="stable")
                own, begin = np.unique(bucket[order], return_index=True)
                ends = np.append(begin, n)
                values = packed(order, *utf8(units.take(pa.array(order))), ends)
                columns = [(own % parts, pa.int32()), (own, pa.int64()), ([chunk] * len(own), pa.int64()), (np.diff(ends), pa.int32()), (values, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["part", "bucket", "chunk", "n", "entries"])

    return apply


def meet(rows: pa.Table) -> pa.Table:
    """One row for a bucket: its distinct units, and of all chunks' entries the places and which unit each is."""
    places, at, flat = unpacked(rows["entries"].to_pylist(), rows["n"].to_pylist(), False)
    units = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()

    def one(column: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    chunks, counts = (one(rows[k].combine_chunks()) for k in ("chunk", "n"))
    which = units.indices.to_numpy().astype("<i4").tobytes()
    return pa.Table.from_arrays([chunks, counts, pa.array([places.tobytes()], pa.binary()), pa.array([which], pa.binary()), one(units.dictionary)], names=["chunks", "counts", "places", "which", "units"])


def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of ``meet`` for each chunk, packed, with a unit's ids in its place."""
    for batch in batches:
        columns = [batch.column(k) for k in ("chunks", "counts", "places", "which", "ids")]
        for chunks, counts, places, which, ids in zip(*columns, strict=True):
            found = ids.values.take(pa.array(np.frombuffer(which.as_buffer(), "<i4")))
            at, flat = _runs(found.value_lengths().to_numpy()), found.flatten().to_numpy().astype("<u4")
            values = packed(np.frombuffer(places.as_buffer(), "<u4"), at, flat, _runs(counts.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([chunks.values, counts.values, pa.array(values, pa.binary())], names=["home", "n", "entries"])


class Vocabulary:
    """What a Python worker keeps of the broadcast units: ids and decoded bytes of each known code."""

    held: dict[str, Vocabulary] = {}

    def __init__(self, ranks: dict[bytes, int], ids: pa.Array):
        by_rank = sorted(ranks, key=ranks.get)
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        size[[ranks[p] for p in by_rank]] = [len(p) for p in by_rank]
        self.begin, self.raw = _runs(size), np.frombuffer(b"".join(by_rank), np.uint8)
        flat = ids.flatten().to_numpy().astype("<u4")
        at = _runs(ids.value_lengths().to_numpy())
        self.ids, self.texts = _cut(flat.tobytes(), 4 * at), self.decoded(flat, at)

    def decoded(self, flat: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The binary pieces of runs of ids, concatenated run by run."""
        size = self.begin[flat + 1] - self.begin[flat]
        ends = _runs(size)
        place = np.arange(ends[-1]) + np.repeat(self.begin[flat] - ends[:-1], size)
        return _cut(self.raw[place].tobytes(), ends[at])

    @classmethod
    def of(cls, name: str, ranks: dict[bytes, int], ids: pa.Array) -> Vocabulary:
        if name not in cls.held:
            cls.held = {name: cls(ranks, ids)}
        return cls.held[name]


def _table_of(df: DataFrame, name: str, chunk: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``chunk``, so that rows of a chunk need no exchange to meet."""
    spark = df.sparkSession
    name = f"docloom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, chunk).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


OUTPUTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}


PLANES = ("b0", "b1", "b2", "b3")


def encode(docs: DataFrame, tokenizer: Tokenizer, keep: list[str], outputs: Iterable[str], sample: int = 12000, hot: int = 3 << 16) -> DataFrame:
    """Columns ``keep`` with ``outputs`` (of OUTPUTS) of each whole text."""
    outputs = list(outputs)
    if taken := {c.lower() for c in keep} & set(outputs):
        raise ValueError(f"columns already there: {sorted(taken)}")
    ranks, pattern, name = tokenizer.ranks, tokenizer.pattern, uuid.uuid4().hex
    release(tokenizer.spark)  # what fits and plans of earlier stages left
    shared = tokenizer.spark.sparkContext.broadcast((ranks, *tokenizer.known_units(docs.select("text"), sample, hot)))
    release(tokenizer.spark)
    names, spark = [f"__c{i}" for i in range(len(keep))], tokenizer.spark
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").alias("__text"))
    kept = given.drop("__text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known, _ = shared.value
        cutter = Cutter(ranks, pattern, (u.as_py() for u in known))
        number = TaskContext.get().partitionId() << 18
        size, columns = 0, [*names, "chunk", *PLANES, "n", "units"]
        types: list[pa.DataType] = []

        def units() -> pa.RecordBatch:
            empty = [pa.nulls(1, pa.binary())] * len(PLANES)
            own = cutter.units()
            out = [*[pa.nulls(1, t) for t in types], pa.array([number], pa.int64()), *empty, pa.array([len(own)], pa.int32()), pa.array([own], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(out, names=columns)

        for batch in batches:
            types = [batch.column(k).type for k in range(len(names))]
            texts, i = batch.column(len(names)), 0
            while i < batch.num_rows:
                planes, begin, most = [], i, min(CHUNK, size + HELD)
                while i < batch.num_rows and size < most:
                    codes = cutter.cut(texts[i].as_py())
                    planes.append(_planes(codes))
                    size += 5 * len(codes) + 1  # about the text's bytes
                    i += 1
                out = [*[batch.column(k).slice(begin, i - begin) for k in range(len(names))], pa.array([number] * (i - begin), pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *[pa.array(p, pa.binary()) for p in zip(*planes, strict=True)], pa.nulls(i - begin, pa.int32()), pa.nulls(i - begin, pa.list_(pa.binary()))], names=columns)
                if size >= CHUNK:
                    yield units()
                    cutter.start()
                    number, size = number + 1, 0
        if size:
            yield units()

    fields = ", ".join([f"`{n}` {t}" for n, t in kept.dtypes] + [""])
    chunks = _table_of(given.mapInArrow(tidy(cut), fields + "chunk bigint, " + "".join(f"{p} binary, " for p in PLANES) + "n int, units array<binary>"), "bpe", "chunk")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = chunks.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    dealt = chunks.where("units IS NOT NULL").select("chunk", "units")
    dealt = dealt.mapInArrow(tidy(deal(max(min(parts, BLOBS), entries // MEET), parts)), "part int, bucket bigint, chunk bigint, n int, entries binary")
    met = dealt.repartitionById(parts, F.col("part")).groupBy("part", "bucket").applyInArrow(meet, "chunks array<bigint>, counts array<int>, places binary, which binary, units array<binary>")
    found = tokenizer.unit_ids(met, "units").select("chunks", "counts", "places", "which", "ids").mapInArrow(tidy(send), "home bigint, n int, entries binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        ranks, _, known = shared.value
        vocabulary = Vocabulary.of(name, ranks, known)
        places, at, flat = unpacked(right["entries"].to_pylist(), right["n"].to_pylist(), True)
        order = np.argsort(places).tolist()
        out_ids, out_text = (known + [own[i] for i in order] for known, own in ((vocabulary.ids, _cut(flat.tobytes(), 4 * at)), (vocabulary.texts, vocabulary.decoded(flat, at))))
        got: dict[str, list] = {k: [] for k in outputs}
        for planes in zip(*(left[p] for p in PLANES), strict=True):
            codes = _numbers(p.as_buffer() for p in planes).tolist()
            ids = b"".join([out_ids[c] for c in codes])
            for k, column in got.items():
                if k == "n_tokens":
                    column.append(len(ids) // 4)
                elif k == "ids":
                    column.append(np.frombuffer(ids, "<i4"))
                elif k == "ids_sha256":
                    column.append(hashlib.sha256(ids).hexdigest())
                else:
                    column.append(hashlib.sha256(b"".join([out_text[c] for c in codes])).hexdigest())
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        more = [pa.array(got[k], kinds.get(k, pa.string())) for k in outputs]
        return pa.Table.from_arrays([*[left[n] for n in names], *more], names=[*names, *outputs])

    rows = chunks.where("units IS NULL").select(*names, "chunk", *PLANES)
    done = rows.groupBy("chunk").cogroup(found.groupBy("home")).applyInArrow(assemble, fields + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *outputs)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def production(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def query(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), production(spark), ["doc_id"], DIGESTS)


def stage(spark, docs, sf_dir):
    """The last stage: each document's token count and digests beside its own columns but text and any of the same names."""
    return encode(docs, production(spark), [c for c in docs.columns if c.lower() not in ("text", *DIGESTS)], DIGESTS)
