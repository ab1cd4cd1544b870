"""N-gram Jaccard join by T-occurrence search, returned as components of linked documents.

Two documents link when their sets of 5-word shingles have a Jaccard likeness of at least PERCENT. Equal sets are one
class; a class that can have a partner must see enough of the smallest shingles it has in other classes too, which one
pass over hashed shingles decides. Each of the first inverted lists of a class (rare ones first) names the list's most
central class, its leader; linked classes have such a list in common, so they meet in a block of one leader. Within a
block the short lists of a query are merged, the long ones are probed by binary search for what the short ones left
(DivideSkip), and what reaches the required overlap is a link. A block too large for a task is cut into bands of
lengths and these into pieces: a query asks the bands that can hold a partner. Nothing is capped; no pairs of a group
are listed.

Defined cases: null, empty and wordless texts have no shingles and are linked with nothing; fewer than five words are
one shingle; very long texts are sets like others, a block of their own if need be; equal texts, also repeated rows,
are of one component; ties between leaders go to the smaller key; ids that are null are never a component's smallest
if another is there; an empty table gives an empty result; only the id and text columns are read, whatever else the
table has. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, mix, parts, shingle_sets, whole_rows
from tessera.operators.graph import cut

PERCENT, WORDS = 75, 5
#: Shingles of a block that one task takes at once (8 bytes each), and central classes tried for a larger block.
BLOCK, CENTRES = 1_500_000, 3
#: Bytes of central sets that are broadcast; more of them are joined by a shuffle.
TOLD_BYTES = 32 << 20
#: Shingles of more classes than this come last in the order of lists; the most frequent of them are told to every task.
FREQUENT, TOLD = 32, 500_000


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(mix(np.array([int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()) + len(shingles) & 0xFFFFFFFFFFFFFFFF], np.uint64)).astype(np.int64)[0])


def needed(n: int) -> int:
    """The least overlap of a set of n with any partner: PERCENT of the union, which has n at least."""
    return -(-PERCENT * n // 100)


def half_prefix(shingles: np.ndarray) -> np.ndarray:
    """The smallest hashes, as many as must hold a quarter of the set's size in common shingles of any partner."""
    n = len(shingles)
    return shingles[: n - needed(n) + -(-n // 4)]


def enough(n: np.ndarray) -> np.ndarray:
    """Of the half prefix, how many shingles a linked class has in common at least: a quarter of the smaller size."""
    return -(-3 * n // 16)


def _deal(hashes: np.ndarray, owners: np.ndarray, values: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Packed rows (bucket, hashes of 5 bytes, owners, shingles of each owner with their value) by bucket of hash."""
    bucket = (hashes & np.uint64(0xFFFFFF)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
    for b in range(n):
        own = order[at[b] : at[b + 1]]
        if len(own):
            first = np.flatnonzero(np.concatenate([[True], owners[own][1:] != owners[own][:-1]]))
            count = np.diff(np.append(first, len(own)))
            yield b, _short(hashes[own]), owners[own][first].tobytes(), np.stack([count, values[own][first]]).astype("<u4").tobytes()


def _short(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray((hashes >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(short: bytes) -> np.ndarray:
    x = np.frombuffer(short, np.uint8).reshape(-1, 5)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :5] = x
    return out.view("<u8").ravel()


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner and value of every shingle of a bucket, each (hash, owner) once, by hash."""
    hashes, owners, values = [], [], []
    for i in range(table.num_rows):
        count, value = np.frombuffer(table["counts"][i].as_py(), "<u4").reshape(2, -1)
        hashes.append(_long(table["hashes"][i].as_py()))
        owners.append(np.repeat(np.frombuffer(table["owners"][i].as_py(), np.int64), count))
        values.append(np.repeat(value, count))
    h, o, v = np.concatenate(hashes), np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((o, h))
    h, o, v = h[order], o[order], v[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    return h[once], o[once], v[once]


PACKED = "bucket int, hashes binary, owners binary, counts binary"


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles and the key of each document's set (null without shingles)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            found = shingle_sets(data, offsets, WORDS)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([digest(s) if len(s) else None for s in found], pa.int64())], ["doc_id", "th", "n_shingles", "key"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, key long")


def repeated_shingles(docs: DataFrame) -> DataFrame:
    """For each bucket: of each class in it, how many half-prefix shingles it shares with another (packed by target), and frequent shingles."""
    n = parts(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches, "text", 1 << 22):
            sets = {digest(s): s for s in shingle_sets(data, offsets, WORDS) if len(s)}
            if not sets:
                continue
            some = [half_prefix(s) for s in sets.values()]
            sizes = [len(s) for s in some]
            rows = list(_deal(np.concatenate(some), np.repeat(np.fromiter(sets, np.int64), sizes), np.repeat([len(s) for s in sets.values()], sizes), n))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], pa.schema([("bucket", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())]).names).cast(
                pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])
            )

    def count(table: pa.Table) -> pa.Table:
        h, o, v = _gather(table)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        shared = np.repeat(times, times) > 1
        own, at, much = np.unique(o[shared], return_index=True, return_counts=True)
        size = v[shared][at]
        to = own.view(np.uint64) % np.uint64(n)
        rows = [(int(t), own[to == t].tobytes(), np.stack([much[to == t], size[to == t]]).astype("<u4").tobytes(), None, None) for t in np.unique(to)]
        often = times > FREQUENT
        rows.append((-1, None, None, h[first[often]].tobytes(), times[often].astype("<u4").tobytes()))
        names = ("target", "owners", "counts", "frequent", "times")
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 4))], names)

    packed = docs.select("text").mapInArrow(emit, PACKED)
    return packed.groupBy("bucket").applyInArrow(count, "target int, owners binary, counts binary, frequent binary, times binary")


def possible(shared: DataFrame) -> DataFrame:
    """key, weight: classes with enough shared shingles, and the share of them (central classes have the most)."""

    def add(table: pa.Table) -> pa.Table:
        own = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["owners"]])
        much, size = np.concatenate([np.frombuffer(x.as_py(), "<u4").reshape(2, -1) for x in table["counts"]], 1).astype(np.int64)
        key, first, at = np.unique(own, return_index=True, return_inverse=True)
        total = np.bincount(at, much).astype(np.int64)
        keep = total >= enough(size[first])
        return pa.Table.from_arrays([pa.array(key[keep]), pa.array(total[keep] / size[first][keep])], ["key", "weight"])

    return shared.where("target >= 0").groupBy("target").applyInArrow(add, "key long, weight double")


def told(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (TOLD of them at most, 5 MB) and how frequent they are, by powers of two. They only order the lists: more or fewer of them change the work, not the result."""
    spread = shared.where("target < 0").select("frequent", "times").mapInArrow(_spread, "h long, n int")
    rows = spread.orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
    h, n = rows["h"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(np.maximum(n[order], 2)).astype(np.uint8)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, n in zip(batch.column(0), batch.column(1), strict=True):
            if h.as_py():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), "<u4").astype(np.int32))], ["h", "n"])


def rare_first(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set in the order of lists: frequent ones last, by hash within a frequency."""
    h = (shingles >> np.uint64(24)).astype(np.uint64)
    if not len(frequent[0]):
        return shingles
    at = np.minimum(np.searchsorted(frequent[0], h), len(frequent[0]) - 1)
    level = np.where(frequent[0][at] == h, frequent[1][at], 0)
    return shingles[np.lexsort((shingles, level))]


def leaders(sets: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, leader: of every list among the first n - T + 1 of a class, the most central class. Linked classes share such a list."""
    n = parts(sets)
    spark = sets.sparkSession
    held = spark.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, owners, values = [], [], []
            for key, weight, packed in zip(batch.column("key"), batch.column("weight"), batch.column("shingles"), strict=True):
                s = rare_first(np.frombuffer(packed.as_py(), np.uint64), held.value)
                s = s[: len(s) - needed(len(s)) + 1]
                some.append(s)
                owners.append(np.full(len(s), key.as_py(), np.int64))
                values.append(np.full(len(s), int(weight.as_py() * 1e6)))
            if some:
                rows = list(_deal(np.concatenate(some), np.concatenate(owners), np.concatenate(values), n))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], ["bucket", "hashes", "owners", "counts"])

    def choose(table: pa.Table) -> pa.Table:
        h, o, v = _gather(table)
        order = np.lexsort((o, -v.astype(np.int64), h))
        h, o = h[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lead = np.repeat(o[first], np.diff(np.append(first, len(h))))
        pair = np.unique(np.stack([o, lead], 1)[o != lead], axis=0) if (o != lead).any() else np.zeros((0, 2), np.int64)
        return pa.Table.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["key", "leader"])

    lists = sets.select("key", "weight", "shingles").mapInArrow(emit, PACKED)
    return lists.groupBy("bucket").applyInArrow(choose, "key long, leader long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of an undirected graph with columns a and b: large-star and small-star
    rounds until the edges stay the same. Each node's neighbours are only counted and compared, never gathered."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.join(low, both.u == low.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        e = large.join(low, large.u == low.w).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


class Lists:
    """Inverted lists of some sets: postings sorted by (shingle, set)."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")  # owners stay in order within a list
        self.sizes, self.owner, sorted_ = sizes, owner[order], every[order]
        self.shingle, self.start = np.unique(sorted_, return_index=True)
        self.end = np.append(self.start[1:], len(sorted_))
        self.key = np.repeat(np.arange(len(self.shingle)), self.end - self.start) * max(1, len(sets)) + self.owner

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets that have at least T = needed(len(query)) shingles of the query, and how many.

        The long lists (fewer than T of them) are set aside; the short ones are merged, what occurs in T - L of them
        is kept and looked up in each long list by binary search.
        """
        t = needed(len(query))
        at = np.searchsorted(self.shingle, query)
        at = at[(at < len(self.shingle)) & (self.shingle[np.minimum(at, len(self.shingle) - 1)] == query)] if len(self.shingle) else at[:0]
        if len(at) < t:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = self.end[at] - self.start[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        # As many lists as may be are long, but those as short as the shortest merge no slower than they are probed.
        long_ = min(t - 1, int((length > 2 * max(1, length[0])).sum()))
        short, rest = at[: len(at) - long_], at[len(at) - long_ :]
        spans = length[: len(short)]
        take = np.repeat(self.start[short] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        found, count = np.unique(self.owner[take], return_counts=True)
        keep = count >= t - long_
        found, count = found[keep], count[keep]
        if long_ and len(found):
            probe = (rest[:, None] * len(self.sizes) + found[None, :]).ravel()
            where = np.searchsorted(self.key, probe)
            hit = self.key[np.minimum(where, len(self.key) - 1)] == probe
            count = count + hit.reshape(len(rest), -1).sum(0)
        keep = count >= t
        return found[keep], count[keep]


def linked(overlap: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (a + b - overlap)


class Groups:
    """Which of n things are of one group so far; a group's name is one of them."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def of(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, a: int, b: int) -> bool:
        """Whether they were of two groups, which are one now."""
        a, b = self.of(a), self.of(b)
        self.parent[a] = b
        return a != b


def block_links(keys: list[int], sets: list[np.ndarray], groups: Groups, queries: list[int]) -> set[tuple[int, int]]:
    """Links between classes of different groups that have a query among them; one is enough for two groups."""
    lists, out = Lists(sets), set()
    for q in queries:
        found, count = lists.search(sets[q])
        for i in found[linked(count, len(sets[q]), lists.sizes[found])].tolist():
            if groups.join(q, i):
                out.add((keys[q], keys[i]))
    return out


def task_links(keys: list[int], weights: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray) -> set[tuple[int, int]]:
    """Links enough to connect whatever is linked within a block, for a task's blocks; rows are places of classes in blocks.

    The most central class of each block is held against all others of that block. If these are of several groups then,
    all but the largest group of the block ask: a link between two groups has a class that asks at an end. What a class
    is linked to in one block says nothing about its links in another, so each block is judged by itself.
    """
    # A class stands in the block of each of its leaders: one place of it is indexed and asks.
    names, once, place = np.unique(np.array(keys, np.int64), return_index=True, return_inverse=True)
    groups, out, asks = Groups(len(names)), set(), set()
    order = np.argsort(blocks, kind="stable")
    others = []
    for own in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        centre = int(own[np.lexsort((place[own], -weights[own]))[0]])
        rest = np.unique(place[own[place[own] != place[centre]]])
        others.append(rest)
        mine, c = sets[centre], int(place[centre])
        for i in rest.tolist():
            other = sets[once[i]]
            if groups.of(i) != groups.of(c) and min(len(other), len(mine)) * 100 >= PERCENT * max(len(other), len(mine)):
                both = len(np.intersect1d(other, mine, assume_unique=True))
                if linked(both, len(other), len(mine)) and groups.join(i, c):
                    out.add((keys[centre], int(names[i])))
    group = np.array([groups.of(i) for i in range(len(names))], np.int64)
    for rest in others:
        own, at, size = np.unique(group[rest], return_inverse=True, return_counts=True)
        if len(own) > 1:
            asks.update(rest[at != np.argmax(size)].tolist())
    return out | block_links(names.tolist(), [sets[i] for i in once], groups, sorted(asks))


def _columns(table: pa.Table) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    return table["key"].to_pylist(), table["weight"].to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]


def _edges(pairs: set[tuple[int, int]]) -> pa.Table:
    a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def small_links(members: DataFrame, n: int) -> DataFrame:
    """Links within blocks that fit a task; a task takes many of them."""

    def run(table: pa.Table) -> pa.Table:
        return _edges(task_links(*_columns(table), table["block"].to_numpy()))

    return members.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(n))).groupBy("task").applyInArrow(run, "a long, b long")


def large_links(members: DataFrame) -> DataFrame:
    """Links within blocks beyond a task's size.

    Central classes, one of each block at a time, are held against all that are left, row by row. Then what the largest
    group of a block does not have is searched for among the classes of its own length and the next ones: in bands whose
    lengths differ by the least likeness, so that linked classes are at most one band apart. Rounds keep keys only.
    """
    state = members.select("block", "key", "weight", "n", F.lit(None).cast("long").alias("led"))
    links = None

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, mine, centre, other in zip(batch.column("key"), batch.column("shingles"), batch.column("centre"), batch.column("other"), strict=True):
                a, b = np.frombuffer(mine.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
                out.append(key.as_py() == centre.as_py() or bool(linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "key", "centre")), pa.array(out, pa.bool_())], ["block", "key", "centre", "met"])

    for _ in range(CENTRES):
        chosen = cut(state.where("led is null").groupBy(F.col("block").alias("_b")).agg(F.max_by(F.struct("key", "n"), F.struct("weight", "key")).alias("c")).select("_b", "c.key", "c.n"))
        small = 8 * (chosen.agg(F.sum("n")).first()[0] or 0) <= TOLD_BYTES
        told_ = F.broadcast if small else lambda df: df
        centres = cut(members.join(told_(chosen.select("_b", F.col("key").alias("centre"))), (F.col("block") == F.col("_b")) & (F.col("key") == F.col("centre"))).select("_b", "centre", F.col("shingles").alias("other")))
        met = members.join(told_(centres), F.col("block") == F.col("_b")).select("block", "key", "shingles", "centre", "other").mapInArrow(meet, "block long, key long, centre long, met boolean").where("met")
        met = cut(met.select(F.col("block").alias("_b"), F.col("key").alias("_k"), "centre"))
        state = cut(state.join(met, (F.col("block") == F.col("_b")) & (F.col("key") == F.col("_k")), "left").select("block", "key", "weight", "n", F.coalesce("led", "centre").alias("led")))
        more = met.where("_k <> centre").select(F.col("centre").alias("a"), F.col("_k").alias("b"))
        links = more if links is None else links.unionByName(more)
    most = state.where("led is not null").groupBy("block", "led").agg(F.count("*").alias("c")).groupBy(F.col("block").alias("_b")).agg(F.max_by("led", F.struct("c", "led")).alias("top"))
    band = F.floor(F.log("n") / float(np.log(100 / PERCENT))).cast("int")
    of = state.join(most, F.col("block") == F.col("_b"), "left").withColumn("band", band)
    of = cut(of.select(F.col("block").alias("_o"), F.col("key").alias("_k"), F.coalesce("led", "key").alias("led"), (~F.col("led").eqNullSafe(F.col("top"))).alias("asks"), "band", "n"))
    pieces = cut(of.groupBy(F.col("_o").alias("_p"), F.col("band").alias("at")).agg(F.ceil(F.sum("n") / BLOCK).alias("pieces")))
    index = of.join(pieces, (F.col("_o") == F.col("_p")) & (F.col("band") == F.col("at"))).select("_o", "_k", "led", "at", F.pmod(F.xxhash64("_k"), F.col("pieces")).alias("piece"), F.lit(False).alias("query"))
    asked = of.where("asks").withColumn("near", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)]))).join(pieces, (F.col("_o") == F.col("_p")) & (F.col("near") == F.col("at")))
    asked = asked.select("_o", "_k", "led", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("query"))
    dealt = members.join(index.unionByName(asked), (F.col("block") == F.col("_o")) & (F.col("key") == F.col("_k"))).select("block", "key", "weight", "shingles", "led", "at", "piece", "query")

    def run(table: pa.Table) -> pa.Table:
        keys, _, sets = _columns(table)
        led, query = table["led"].to_numpy(), table["query"].to_numpy(zero_copy_only=False)
        groups = np.unique(led, return_inverse=True)[1]
        here = np.flatnonzero(~query)
        lists, out, done = Lists([sets[i] for i in here]), set(), set()
        for q in np.flatnonzero(query).tolist():
            found, count = lists.search(sets[q])
            for i in here[found[linked(count, len(sets[q]), lists.sizes[found])]].tolist():
                pair = (int(groups[q]), int(groups[i]))
                if pair[0] != pair[1] and pair not in done:
                    done.add(pair)
                    out.add((keys[q], keys[i]))
        return _edges(out)

    return links.unionByName(dealt.groupBy("block", "at", "piece").applyInArrow(run, "a long, b long"))


def component_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, a row for each document."""
    return component_rows(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """component_table with th (the text's hash) and key (of the set)."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sets = cut(sets_of(docs))
    classes = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"))
    shared = cut(repeated_shingles(docs))
    frequent = told(shared)
    keys = possible(shared).join(classes, "key").select("key", "weight", "low")
    kept = cut(_sets_of_classes(docs, keys))
    star = leaders(kept, frequent).select(F.col("key").alias("node"), F.col("leader").alias("block"))
    blocks = cut(star.unionByName(star.select(F.col("block").alias("node"), "block")).distinct())
    sizes = cut(kept.select("key", "n").join(blocks, F.col("key") == F.col("node")).groupBy("block").agg(F.sum("n").alias("total")))
    few, most = sizes.agg(F.sum(F.when(F.col("total") <= BLOCK, F.col("total"))), F.max("total")).first()
    tasks = max(1, min(4096, 2 * -(-(few or 0) // BLOCK)), parts(docs))

    def members(of: DataFrame) -> DataFrame:
        nodes = blocks.join(of.select(F.col("block").alias("_o")), F.col("block") == F.col("_o"), "left_semi")
        return kept.join(nodes, F.col("key") == F.col("node")).select("block", "key", "weight", "n", "shingles")

    links = small_links(members(sizes.where(F.col("total") <= BLOCK)), tasks)
    if (most or 0) > BLOCK:
        links = links.unionByName(large_links(cut(members(sizes.where(F.col("total") > BLOCK)))))
    links = cut(links)
    roots = components(links)
    low = roots.join(classes, roots.node == classes.key).select("root", "low").union(classes.select(F.col("key"), "low"))
    low = low.groupBy("root").agg(F.min("low").alias("component_id"))
    # Each class's root is itself or what the links say; the smallest id of the root's classes names the component.
    named = classes.select("key", "low").join(roots, classes.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("_r")).join(low, F.col("_r") == low.root).select(F.col("key").alias("_k"), "component_id")
    return sets.join(named, sets.key == F.col("_k"), "left").select("doc_id", "th", "key", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def _sets_of_classes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, weight, n, shingles of the classes asked for, found by their smallest document."""
    ids = keys.select(F.col("low").alias("_low"), F.col("key").alias("_key"), "weight")
    rows = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_low"))).select("text", "_key", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, "text"):
            out = [(k.as_py(), w.as_py(), len(s), s.tobytes()) for s, k, w in zip(shingle_sets(data, offsets, WORDS), rows.column(1), rows.column(2), strict=True) if len(s) and digest(s) == k.as_py()]
            out = list({r[0]: r for r in out}.values())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.binary()))], ["key", "weight", "n", "shingles"])

    return rows.mapInArrow(run, "key long, weight double, n long, shingles binary")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The documents without those linked, over any number of links, to one of a smaller id; of rows with one id and set one stays.

    Null, empty and wordless texts are linked with nothing and stay; further columns stay as they are, whatever their
    names; which of several rows with one id and set stays depends on their content alone; an empty table stays empty.
    """
    found = cut(component_rows(docs)).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("doc_id", "key", "th").agg(F.count("*").alias("n")).groupBy("doc_id", "key").agg(F.min(F.struct("th", "n")).alias("x"))
    kept = cut(kept.select(F.col("doc_id").alias("_id"), F.col("x.th").alias("_th"), F.col("x.n").alias("_n")))
    keyed = whole_rows(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))

    def joined(of: DataFrame) -> DataFrame:
        return keyed.join(of, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")))

    out, several = joined(kept.where("_n = 1")).select("doc.*"), kept.where("_n > 1")
    if several.isEmpty():
        return out
    place = Window.partitionBy("_id", "_th").orderBy(F.xxhash64(F.to_json("doc")))
    return out.unionByName(joined(several).withColumn("_k", F.row_number().over(place)).where("_k = 1").select("doc.*"))
