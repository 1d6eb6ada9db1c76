"""Conversation prefix trie: a node table behind a minimal perfect hash in each shard, accumulated in depth order.

1. A turn is its MD5 and its number of words. Turns are numbered over range partitions, so that a conversation may hold any share
   of all rows; the first turns of a conversation are exchanged for those of another one, and what results is cut into bands
   of 64 depths (``bands``). A prefix is the exclusive-or of 128 bits of each turn mixed with its depth, so that
   the prefix before a band follows from one row a band.
2. Bands are sorted by the prefix before them, their turns and the conversation, over range partitions. Such a partition is a shard:
   the trie's nodes lie in it side by side, however many conversations share them (``_shard``). Its distinct prefixes
   are enumerated and get slots of a minimal perfect hash; every occurrence must find its own digest, depth, turn and parent
   there. Counts are scattered into flat arrays by slot and summed through the parents' slots, deepest first.
3. Only nodes on the first or last path of a shard, or on a path that goes on in a further band, can be in several shards (some 128 for
   each shard, and the nodes of long conversations). Their parts are added up by digest, and their subtrees are summed
   by doubling: after r rounds of joins every node holds what lies fewer than 2^r levels below it (``_shared``).
4. The ids that end at a node shared by several shards are hashed in order as a stream, thousands of ids a row.

Defined results: rows with a null conv_id take no part; null role or text is empty; turns of a conversation go by turn, null first,
and rows of one turn by the MD5 of ``length of role:role text``, so that repeated rows are turns after each other. A rebuilt conversation
without turns is a member of the root alone. An empty table has no nodes. Texts of any length are read
whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.mixing import n_words
from quire.llm.shared import written

#: Depths in a band; turns that a shard holds about; ids in a row of those that end at a shared node.
BAND, SHARD, IDS = 64, 250_000, 4096
DIGEST, COUNT = 16, 8
_EMPTY = hashlib.sha256(b"").hexdigest()


def _bytes_of(column: pa.Array) -> bytes:
    """All values of a binary column after each other."""
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return b""
    at = np.frombuffer(offsets, np.int32)
    return bytes(memoryview(data)[int(at[column.offset]):int(at[column.offset + len(column)])])


def _starts(new: np.ndarray) -> np.ndarray:
    """For each row the place of the last row where ``new`` holds."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition as rows of 64 at most, with the number of the conversation's turns before them here."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        c, part = batch.column("c").to_numpy(), batch.column("part")[0].as_py()
        digests, words = _bytes_of(batch.column("digest")), batch.column("words").to_numpy().astype(np.int64)
        first = np.r_[True, c[1:] != c[:-1]]
        place = np.arange(len(c)) - _starts(first)
        cuts = np.flatnonzero(place % BAND == 0)
        ends = np.r_[cuts[1:], len(c)]
        before = place[cuts] + np.where(c[cuts] == last, seen, 0) if last is not None else place[cuts]
        seen = int(place[-1]) + 1 + (seen if c[-1] == last else 0)
        last = c[-1]
        yield pa.RecordBatch.from_pydict({
            "c": c[cuts], "part": pa.array([part] * len(cuts), pa.int32()), "before": before, "n": ends - cuts,
            "digests": [digests[DIGEST * a:DIGEST * b] for a, b in zip(cuts, ends, strict=True)], "words": [words[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})


def _cut(what: str, size: int, start: Column, n: Column) -> Column:
    return F.substring(what, start * size + 1, n * size)


def numbered(conversations: DataFrame) -> DataFrame:
    """Packs of turns: c, before (the conversation's turns before the pack), n, digests, words."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), n_words(text).alias("words"))
    turns = written(turns, "digests")  # the sort reads its input twice, for its borders and for its rows: not the texts
    order = ["c", F.asc_nulls_first("turn"), "digest"]
    sort = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "digest", "words", F.spark_partition_id().alias("part"))
    packs = written(sort.mapInArrow(_pack, "c long, part int, before long, n long, digests binary, words binary"), "turns")
    # a conversation that begins in an earlier partition: one row a partition says how many of its turns are there
    parts = packs.groupBy("part").agg(F.min("c").alias("first_c"), F.max("c").alias("last_c"), F.max_by(F.col("before") + F.col("n"), F.struct("c", "before")).alias("last_n"))
    run = F.sum("last_n").over(Window.partitionBy("last_c").orderBy("part"))
    one = Window.orderBy("part")
    parts = parts.withColumn("run", run).select("part", F.col("first_c").alias("c"), F.when(F.lag("last_c").over(one) == F.col("first_c"), F.lag("run").over(one)).alias("earlier"))
    return packs.join(F.broadcast(parts), ["part", "c"], "left").withColumn("before", F.col("before") + F.coalesce("earlier", F.lit(0))).drop("part", "earlier")


def bands(packs: DataFrame, every: int, most: int) -> DataFrame:
    """Rebuilt conversations: c, band, n, digests, words; every conversation has a band 0, if an empty one.

    The first h turns of conversation ``c - c % every`` stand in place of c's own first h, h = crc32(c) % (most + 1).
    """
    near = packs.filter((F.col("c") % every == 0) & (F.col("before") < most))
    near = near.filter("n > 0").select("c", "before", "digests", "words", F.explode(F.sequence(F.lit(0), F.least("n", most - F.col("before")) - 1)).alias("i"))
    one = F.struct((F.col("before") + F.col("i")).alias("p"), _cut("digests", DIGEST, F.col("i"), F.lit(1)).alias("d"), _cut("words", COUNT, F.col("i"), F.lit(1)).alias("w"))
    heads = near.groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(one)).alias("head"))  # at most ``most`` turns
    all_of = packs.withColumn("base", F.col("c") - F.col("c") % every).join(heads, "base", "left")
    all_of = all_of.withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)).cast("int"))
    all_of = all_of.withColumn("head", F.slice(F.coalesce("head", F.array()), 1, F.col("h"))).withColumn("m", F.size("head"))
    skip = F.greatest(F.col("h") - F.col("before"), F.lit(0))
    own = F.struct((F.col("before") + skip - F.col("h") + F.col("m")).alias("d0"), F.greatest(F.col("n") - skip, F.lit(0)).alias("n"),
                   F.substring("digests", skip.cast("int") * DIGEST + 1, F.lit(BAND * DIGEST)).alias("digests"), F.substring("words", skip.cast("int") * COUNT + 1, F.lit(BAND * COUNT)).alias("words"))
    joined = lambda field: F.aggregate("head", F.lit(b""), lambda a, x: F.concat(a, x[field]))
    head = F.struct(F.lit(0).cast("long").alias("d0"), F.col("m").cast("long").alias("n"), joined("d").alias("digests"), joined("w").alias("words"))
    pieces = F.concat(F.filter(F.array(own), lambda x: x["n"] > 0), F.when(F.col("before") == 0, F.array(head)).otherwise(F.array()))
    pieces = all_of.select("c", F.explode(pieces).alias("p")).select("c", "p.*")
    ends = F.greatest(F.col("d0") + F.col("n") - 1, F.col("d0"))
    pieces = pieces.withColumn("band", F.explode(F.sequence(F.floor(F.col("d0") / BAND), F.floor(ends / BAND))))
    low, high = F.greatest("d0", F.col("band") * BAND), F.least(F.col("d0") + F.col("n"), (F.col("band") + 1) * BAND)
    at, n = (low - F.col("d0")).cast("int"), (high - low).cast("int")
    cut = F.struct(low.alias("low"), n.alias("n"), _cut("digests", DIGEST, at, n).alias("digests"), _cut("words", COUNT, at, n).alias("words"))
    found = pieces.select("c", "band", cut.alias("x")).groupBy("c", "band").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # at most 64 turns
    whole = lambda field: F.aggregate("xs", F.lit(b""), lambda a, x: F.concat(a, x[field]))
    return found.select("c", "band", F.aggregate("xs", F.lit(0), lambda a, x: a + x["n"]).alias("n"), whole("digests").alias("digests"), whole("words").alias("words"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salted(turns: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _mix(depth.astype(np.uint64))
    return _mix(turns[:, 0] ^ at), _mix(turns[:, 1] ^ _mix(at))


def _turns(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(_bytes_of(batch.column("digests")), np.uint64).reshape(-1, 2)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exclusive-or of a band's turns."""
    for batch in batches:
        n, band = batch.column("n").to_numpy().astype(np.int64), batch.column("band").to_numpy()
        if len(n):
            start = np.cumsum(n) - n
            x, y = _salted(_turns(batch), np.arange(n.sum()) - np.repeat(start, n) + 1 + np.repeat(band * BAND, n))
            yield pa.RecordBatch.from_pydict({"c": batch.column("c"), "band": batch.column("band"), "x": np.bitwise_xor.reduceat(x, start).view(np.int64), "y": np.bitwise_xor.reduceat(y, start).view(np.int64)})


class Slots:
    """A minimal perfect hash of distinct 128-bit keys: every key has a slot of its own below their number.

    Keys are hashed into half as many places again as there are keys; those alone in their place get the next slots in
    the order of the places, and the others go on to the next level.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, given = np.arange(len(x)), 0
        while len(left):
            at = self._place(x[left], y[left], len(self.levels), len(left) * 3 // 2 + 1)
            alone = np.bincount(at, minlength=len(left) * 3 // 2 + 1) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + given))
            given += int(alone.sum())
            left = left[~alone[at]]
        self.x, self.y = np.zeros_like(x), np.zeros_like(y)
        slot = self._find(x, y)
        self.x[slot], self.y[slot] = x, y

    @staticmethod
    def _place(x: np.ndarray, y: np.ndarray, level: int, places: int) -> np.ndarray:
        return (_mix(x ^ _mix(y + np.uint64(level))) % np.uint64(places)).astype(np.int64)

    def _find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slot, left = np.full(len(x), -1), np.arange(len(x))
        for level, (alone, nth) in enumerate(self.levels):
            at = self._place(x[left], y[left], level, len(alone))
            here = alone[at]
            slot[left[here]] = nth[at[here]]
            left = left[~here]
        return slot

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        slot = self._find(x, y)
        if (slot < 0).any() or (self.x[slot] != x).any() or (self.y[slot] != y).any():
            raise ValueError("a key that was not enumerated")
        return slot


_SHARD = ("kind string, x long, y long, px long, py long, depth long, n_convs long, conv_id long, parent_conv_id long, n_children long, "
          "n_leaves long, saved_tokens long, words long, t0 long, t1 long, ids string")


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's nodes: ``whole`` ones with their results, parts of ``shared`` ones, and the ``ids`` that end at the latter."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    held = {k: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in ("c", "band", "n", "rx", "ry", "more")}
    turns = np.concatenate([_turns(b) for b in batches])
    words = np.concatenate([np.frombuffer(_bytes_of(b.column("words")), np.int64) for b in batches])
    c, n, base, more = held["c"], held["n"].astype(np.int64), held["band"] * BAND, held["more"].astype(bool)
    rx, ry = held["rx"].view(np.uint64), held["ry"].view(np.uint64)
    row, end = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    start = end - n
    depth = np.arange(len(row)) - start[row] + 1 + base[row]
    # the prefix of each occurrence: running exclusive-or from the start of its row, and what lies before the band
    x, y = _salted(turns, depth)
    before = [np.r_[np.uint64(0), np.bitwise_xor.accumulate(v)] for v in (x, y)]
    x, y = (b[1:] ^ b[start[row]] ^ r[row] for b, r in zip(before, (rx, ry), strict=True))

    all_x, all_y = np.r_[rx, x], np.r_[ry, y]
    order = np.lexsort((all_y, all_x))
    new = np.r_[True, (np.diff(all_x[order]) != 0) | (np.diff(all_y[order]) != 0)]
    slots = Slots(all_x[order][new], all_y[order][new])
    found = slots(all_x, all_y)
    root, at = found[:len(n)], found[len(n):]
    up = np.where(depth - base[row] == 1, root[row], np.r_[-1, at[:-1]]) if len(at) else at
    size = len(slots.x)
    parent, deep, word, turn = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, 2), np.uint64)
    deep[root], deep[at], parent[at], word[at], turn[at] = base, depth, up, words, turns
    if not ((deep[at] == depth).all() and (parent[at] == up).all() and (turn[at] == turns).all() and (deep[root] == base).all()):
        raise ValueError("two prefixes share a digest")

    members = np.bincount(at, minlength=size) + np.bincount(root[base == 0], minlength=size)
    smallest = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, c[row])
    np.minimum.at(smallest, root[base == 0], c[base == 0])
    shared = np.zeros(size, bool)
    shared[root] = True
    shared[at[more[row] | (row == 0) | (row == len(n) - 1)]] = True
    whole = ~shared
    children = np.bincount(parent[whole], minlength=size)
    leaves = (whole & (children == 0)).astype(np.int64)
    saved = np.where(whole, (members - 1) * word, 0)
    by_depth = np.argsort(-deep, kind="stable")
    by_depth = by_depth[whole[by_depth]]
    cuts = np.flatnonzero(np.diff(deep[by_depth])) + 1
    for level in np.split(by_depth, cuts):  # 64 at most
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])

    # rows that end at one node stand together, their ids ascending
    stop = np.where(n > 0, at[np.minimum(end - 1, len(at) - 1)] if len(at) else root, root)
    ending = np.flatnonzero(~more)
    ends = {}
    pieces = []
    for group in np.split(ending, np.flatnonzero(np.diff(stop[ending])) + 1) if len(ending) else []:
        slot = stop[group[0]]
        if whole[slot]:
            ends[slot] = hashlib.sha256(",".join(map(str, c[group].tolist())).encode()).hexdigest()
        else:
            pieces += [(slot, c[group[i]], ",".join(map(str, c[group[i:i + IDS]].tolist()))) for i in range(0, len(group), IDS)]

    signed = lambda v: v.view(np.int64)
    columns = {f.name: f.type for f in pa.schema([(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in _SHARD.split(", ")])}
    batch = lambda n, given: pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in columns.items()], names=list(columns))
    w, s, f = np.flatnonzero(whole), np.flatnonzero(shared), parent
    above = f[w]
    yield batch(len(w), {
        "kind": ["whole"] * len(w), "px": signed(slots.x)[above], "py": signed(slots.y)[above], "depth": deep[w], "n_convs": members[w], "conv_id": smallest[w],
        "parent_conv_id": pa.array(smallest[above], mask=shared[above]), "n_children": children[w], "n_leaves": leaves[w], "saved_tokens": saved[w], "ids": [ends.get(k, _EMPTY) for k in w.tolist()]})
    above, none, inner = f[s], members[s] == 0, f[s] < 0
    yield batch(len(s), {
        "kind": ["shared"] * len(s), "x": signed(slots.x)[s], "y": signed(slots.y)[s], "px": pa.array(signed(slots.x)[above], mask=inner), "py": pa.array(signed(slots.y)[above], mask=inner),
        "depth": deep[s], "n_convs": members[s], "conv_id": pa.array(smallest[s], mask=none), "n_children": children[s], "n_leaves": leaves[s], "saved_tokens": saved[s],
        "words": pa.array(word[s], mask=inner), "t0": pa.array(signed(turn[s, 0].copy()), mask=inner), "t1": pa.array(signed(turn[s, 1].copy()), mask=inner)})
    if pieces:
        at = np.array([p[0] for p in pieces])
        yield batch(len(pieces), {"kind": ["ids"] * len(pieces), "x": signed(slots.x)[at], "y": signed(slots.y)[at], "conv_id": [int(p[1]) for p in pieces], "ids": [p[2] for p in pieces]})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each (x, y), whose rows come in order; only the hash's state is held."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_pydict({"x": [key[0]], "y": [key[1]], "sha": [state.hexdigest()]})
    for batch in batches:
        for x, y, ids in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "ids")), strict=True):
            if (x, y) != key:
                if key is not None:
                    yield row()
                key, state = (x, y), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield row()


def _shared(shards: DataFrame) -> DataFrame:
    """The nodes that several shards may hold, whole: x, y, px, py and their results but the parent's conv_id."""
    parts = shards.filter("kind = 'shared'").groupBy("x", "y").agg(
        *[F.max(k).alias(k) for k in ("px", "py", "depth", "words")], *[F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("conv_id").alias("conv_id"), F.max(F.struct("depth", "px", "py", "t0", "t1")).alias("a"), F.min(F.when(F.col("px").isNotNull(), F.struct("depth", "px", "py", "t0", "t1"))).alias("b"))
    parts = parts.filter(F.when(F.col("b").isNotNull() & (F.col("a") != F.col("b")), F.raise_error(F.lit("two prefixes share a digest"))).otherwise(F.lit(True)))
    parts = written(parts.drop("a", "b"), "shared-parts")
    below = parts.filter("px IS NOT NULL").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("more"))
    parts = parts.join(below, ["x", "y"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    nodes = written(parts.withColumn("n_leaves", F.col("n_leaves") + leaf).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))), "shared-nodes")
    sums = nodes.select("x", "y", F.col("px").alias("ax"), F.col("py").alias("ay"), "n_leaves", "saved_tokens")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(math.ceil(math.log2(deepest + 1))):
        lower = sums.filter("ax IS NOT NULL").groupBy(F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        upper = sums.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        both = sums.join(lower, ["x", "y"], "left").join(upper, ["ax", "ay"], "left")
        sums = written(both.select("x", "y", F.col("bx").alias("ax"), F.col("by").alias("ay"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                                   (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "doubled")
    ids = shards.filter("kind = 'ids'").select("x", "y", "conv_id", "ids")
    ends = ids.repartition("x", "y").sortWithinPartitions("x", "y", "conv_id").mapInArrow(_hashed, "x long, y long, sha string")
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums.drop("ax", "ay"), ["x", "y"]).join(ends, ["x", "y"], "left")
    return written(nodes.withColumn("ends_sha256", F.coalesce("sha", F.lit(_EMPTY))).drop("sha", "words"), "shared-whole")


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text)."""
    rows = written(bands(numbered(conversations), every, most), "bands")
    long_ones = rows.filter((F.col("band") > 0) | (F.col("n") == BAND)).select("c", "band", "n", "digests")
    totals = long_ones.mapInArrow(_totals, "c long, band long, x long, y long")
    along = Window.partitionBy("c").orderBy("band")  # one narrow row for 64 turns
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("c", "band", F.bit_xor("x").over(earlier).alias("rx"), F.bit_xor("y").over(earlier).alias("ry"), F.lead("band").over(along).isNotNull().alias("more"))
    rows = rows.join(totals, ["c", "band"], "left").select("c", "band", "n", "digests", "words", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("rx", "ry")], F.coalesce("more", F.lit(False)).alias("more"))
    count = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / SHARD))
    order = ["rx", "ry", "digests", "c"]
    done = written(rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(_shard, _SHARD), "shards")
    shared = _shared(done)
    names = shared.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("above"))
    top = shared.join(names, ["px", "py"], "left").withColumn("parent_conv_id", F.col("above"))
    inner = done.filter("kind = 'whole'").withColumnRenamed("ids", "ends_sha256")
    known = inner.filter("parent_conv_id IS NOT NULL")
    hanging = inner.filter("parent_conv_id IS NULL").join(names, ["px", "py"]).withColumn("parent_conv_id", F.col("above"))
    return top.select(*OUT).union(known.select(*OUT)).union(hanging.select(*OUT))


def op13(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, the first turns exchanged for those of every twentieth conversation."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: crc32 bit by bit: each bit of the text shifts the register and adds the polynomial where the lowest bits differ.
_CRC = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: list_transform(range(8), lambda i: ((ascii(s) >> i::INT) & 1)::BIGINT))),
  lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1))), 4294967295)"""

OP13_SQL = r"""
WITH t AS (SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, CRC % 4 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT c.c, 1 AS own, t.p, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.p > c.h
      UNION ALL SELECT c.c, 0, t.p, t.role, t.text FROM c JOIN t ON t.c = c.c - c.c % 20 AND t.p <= c.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth, role, text FROM b),
g AS (SELECT c, list(struct_pack(r := role, t := text) ORDER BY depth) AS path FROM d GROUP BY c),
g2 AS (SELECT c.c, coalesce(g.path, []) AS path FROM c LEFT JOIN g ON c.c = g.c),
o AS (SELECT c, path AS whole, unnest(generate_series(0, len(path))) AS depth FROM g2),
q AS (SELECT c, depth, list_slice(whole, 1, depth) AS prefix, len(whole) = depth AS ends FROM o),
n AS (SELECT prefix, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256,
             any_value(CASE WHEN depth > 0 THEN len(regexp_extract_all(prefix[depth].t, '[^\x20\x09-\x0D]+')) ELSE 0 END) AS words
      FROM q GROUP BY prefix),
k AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.prefix = k.prefix),
s AS (SELECT list_slice(prefix, 1, up) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
      FROM (SELECT *, unnest(generate_series(0, depth)) AS up FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.prefix = s.prefix LEFT JOIN m u ON m.depth > 0 AND u.prefix = list_slice(m.prefix, 1, m.depth - 1)
""".replace("CRC", _CRC)
