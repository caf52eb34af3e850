"""The trie of conversation prefixes, screened by a count-min sketch.

Turns are ordered in range partitions, so one conversation of any length spreads over many tasks, and every turn becomes a
16-byte digest and its length before anything is shuffled. A prefix's digest is the running sum of hashes of (depth, turn),
so long conversations are summed segment by segment. The digests of each conversation's first `screened` prefixes are
counted in a count-min sketch of bounded size. Where the estimate of a prefix is one, the prefix and all longer ones belong
to that conversation alone: its tail of nodes is emitted where it stands. Only the prefixes before meet by digest in a
shuffle, which counts them exactly, so a wrong "perhaps shared" costs a row and nothing else.

Sums over subtrees need no walk along the trie. A node is owned by its smallest member, and what a conversation owns is the
end of its path. So the leaves below a node are the members that own a leaf, and the tokens saved below it are what its
members' own nodes save, less what its owner saves above it.

Defined results: rows without a conv_id belong to no conversation; turns that tie are ordered by the MD5 of role and text;
repeated rows are turns of their own; a null role or text is empty; the leader of conversation c is c - c % 100 with the
remainder's sign that of c; other columns are ignored; an empty table gives no rows, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

c = F.col
#: Turns that a conversation takes from its leader at most, and turns in a segment of a path.
HEAD, SEGMENT = 5, 4096
#: Counters of a row of the sketch: eight for each prefix counted, within these bounds. Two bitmaps of 8 MB are the most.
LEAST_WIDTH, MOST_WIDTH, BLOCK = 1 << 16, 1 << 26, 1 << 16
_MASK = np.uint64((1 << 62) - 1)
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
NODE = ["depth", "a", "b"]


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, written, with `at`: their place from 0 in an order over the whole table."""
    spread = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part, here = F.shiftright("__at", 33), c("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in spread.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts = [0]
    for number in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(number, 0))
    before = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), part.cast("int"))
    return spread.withColumn("at", before + here).drop("__at")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, chars) of all turns, `at` their place in the order over the table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    order = [c("conv_id").asc(), c("turn").asc_nulls_first(), c("digest").asc()]
    # rows alike in all of these may change places, so a number of their own lets them spread over partitions
    return placed(rows.withColumn("tie", F.monotonically_increasing_id()), [*order, c("tie")]).select("conv_id", "at", "digest", "chars")


def _paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and the turns (conv_id, depth, digest, chars) of all as rebuilt."""
    own = materialize(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")), "own")
    head = F.pmod(F.crc32(c("conv_id").cast("string")), F.lit(HEAD + 1))
    leads = own.select(c("conv_id").alias("leader"), c("n").alias("lead"))
    info = own.withColumn("h", head).withColumn("leader", c("conv_id") - c("conv_id") % 100).join(leads, "leader", "left")
    info = info.withColumn("m", F.least("h", F.coalesce("lead", F.lit(0)))).withColumn("length", c("m") + F.greatest(c("n") - c("h"), F.lit(0)))
    info = materialize(info.select("conv_id", "leader", "first", "n", "h", "m", "length"), "conversations")
    # a conversation's turns meet its row by slices of their places, so that they stay dealt over tasks
    cut = F.floor(c("at") / SEGMENT)
    cuts = info.select("conv_id", "first", "h", "m", F.explode(F.sequence(F.floor(c("first") / SEGMENT), F.floor((c("first") + c("n") - 1) / SEGMENT))).alias("cut"))
    placed_turns = turns.withColumn("cut", cut).join(cuts, ["conv_id", "cut"]).withColumn("p", c("at") - c("first") + 1)
    placed_turns = materialize(placed_turns.select("conv_id", "p", "h", "m", "digest", "chars"), "turns")
    kept = placed_turns.where("p > h").select("conv_id", (c("p") - c("h") + c("m")).alias("depth"), "digest", "chars")
    heads = placed_turns.where(c("p") <= HEAD).select(c("conv_id").alias("leader"), c("p").alias("depth"), "digest", "chars")  # a leader has at most 100 followers
    taken = info.where("m > 0").select("conv_id", "leader", "m").join(heads, "leader").where("depth <= m").select("conv_id", "depth", "digest", "chars")
    return info.select("conv_id", "length"), kept.unionByName(taken)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _chains(paths: DataFrame) -> DataFrame:
    """Segments of paths: (conv_id, seg, first, a, b, chars, base_a, base_b), where a[i], b[i] are the digest of the prefix that
    ends at depth first + i and base_* that of the prefix before the segment."""

    def summed(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), dtype="<u8").reshape(-1, 2)
        depth = rows.column("depth").to_numpy()
        salt = _mixed(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        values = _mixed(_mixed(digests[:, 0] ^ salt) + digests[:, 1]), _mixed(_mixed(digests[:, 1] + salt) ^ digests[:, 0])
        sizes = np.diff(np.append(starts, len(depth)))
        offsets = pa.array(np.append(starts, len(depth)).astype(np.int32))
        sums = []
        for value in values:
            total = np.cumsum(value)
            sums.append((total - np.repeat(total[starts] - value[starts], sizes) & _MASK).view(np.int64))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (*sums, rows.column("chars").to_numpy())]
        return pa.RecordBatch.from_arrays([*[pa.array(rows.column(x).to_numpy()[starts]) for x in ("conv_id", "seg", "depth")], *lists], ["conv_id", "seg", "first", "a", "b", "chars"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            rows = pa.Table.from_batches([*held, batch])
            convs, segs = rows.column("conv_id").to_numpy(), rows.column("seg").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((convs[1:] != convs[:-1]) | (segs[1:] != segs[:-1])) + 1])
            if len(starts) > 1:  # the last segment may go on in the next batch
                yield summed(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield summed(pa.Table.from_batches(held), np.zeros(1, dtype=np.int64))

    seg = F.floor((c("depth") - 1) / SEGMENT)
    keyed = paths.withColumn("seg", seg)
    schema = "conv_id long, seg long, first long, a array<long>, b array<long>, chars array<long>"
    some = materialize(keyed.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "depth").mapInArrow(run, schema), "chains")
    # sums before a segment: of the segments before it, which only long paths have
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda x: F.pmod(F.sum(F.element_at(x, -1).cast("decimal(38,0)")).over(before), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")
    long_paths = some.where("seg > 0").select("conv_id").distinct()
    base = some.join(long_paths, "conv_id", "left_semi").select("conv_id", "seg", total("a").alias("base_a"), total("b").alias("base_b")).where("seg > 0")
    based = some.join(base, ["conv_id", "seg"], "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("base_a", "base_b")})

    def moved(x: str) -> Column:
        return F.transform(x, lambda y: (y + c(f"base_{x}")).bitwiseAND((1 << 62) - 1))

    return based.withColumns({x: moved(x) for x in ("a", "b")})


class Sketch:
    """A count-min sketch that only tells one from more: for each of its rows a bitmap of the counters that are above one."""

    def __init__(self, chains: DataFrame, prefixes: int, screened: int) -> None:
        self.screened = screened
        self.width = min(max(1 << int(8 * prefixes).bit_length(), LEAST_WIDTH), MOST_WIDTH)
        self.more = np.zeros((2, self.width // 8), dtype=np.uint8)
        merged = chains.where("seg = 0").select("a", "b").mapInArrow(self._counted(), "block int, some binary, more binary").repartition("block").sortWithinPartitions("block").mapInArrow(self._merged, "block int, more binary")
        for row in merged.toLocalIterator():
            line, at = divmod(row["block"], self.width // BLOCK)
            self.more[line, at * BLOCK // 8 : (at + 1) * BLOCK // 8] = np.frombuffer(row["more"], dtype=np.uint8)

    def _counted(self):
        """Two bitmaps for each block of counters that a task has touched: those above zero and those above one."""
        width, screened = self.width, self.screened

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((2, width), dtype=np.uint8)
            for batch in batches:
                for line, name in enumerate(("a", "b")):
                    slots = _slots(batch.column(name), width, screened)[0]
                    slots, n = np.unique(slots, return_counts=True)
                    counts[line, slots] = np.minimum(counts[line, slots] + n, 2)
            blocks = counts.reshape(-1, BLOCK)
            used = np.flatnonzero(blocks.any(axis=1))
            for at in range(0, len(used), 256):
                part = used[at : at + 256]
                bits = [pa.array([np.packbits(blocks[i] >= least).tobytes() for i in part], pa.binary()) for least in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *bits], ["block", "some", "more"])

        return run

    @staticmethod
    def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, some, more = None, None, None
        for batch in batches:
            for number, *bits in zip(*(batch.column(x).to_pylist() for x in ("block", "some", "more")), strict=True):
                new_some, new_more = (np.frombuffer(x, dtype=np.uint8) for x in bits)
                if number != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([more.tobytes()], pa.binary())], ["block", "more"])
                    block, some, more = number, new_some, new_more
                else:
                    more, some = more | new_more | some & new_some, some | new_some
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([more.tobytes()], pa.binary())], ["block", "more"])

    def proven(self, chains: DataFrame) -> DataFrame:
        """(conv_id, alone): the least depth from which a conversation's prefixes are proven its own, null where none is."""
        width, screened, shared = self.width, self.screened, chains.sparkSession.sparkContext.broadcast(self.more)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            more = shared.value
            for batch in batches:
                one = np.zeros(0, dtype=bool)
                for line, name in enumerate(("a", "b")):
                    slots, starts, counts = _slots(batch.column(name), width, screened)
                    single = more[line, slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1 == 0
                    one = single if line == 0 else one | single
                where = np.flatnonzero(one)
                first = np.searchsorted(where, starts)
                found = np.append(where, len(one))[first]
                alone = found - starts + 1
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(alone, mask=found >= starts + counts)], ["conv_id", "alone"])

        return chains.where("seg = 0").select("conv_id", "a", "b").mapInArrow(run, "conv_id long, alone long")


def _slots(lists: pa.Array, width: int, screened: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counters of the first prefixes of each list, end to end; where each list's begin; how many it has."""
    sizes = np.diff(lists.offsets.to_numpy())
    counts = np.minimum(sizes, screened)
    starts = np.cumsum(counts) - counts
    values = lists.flatten().to_numpy()
    at = np.arange(counts.sum()) - np.repeat(starts - (np.cumsum(sizes) - sizes), counts)
    return values[at] & width - 1, starts, counts


def _before(rows: DataFrame, within: str, order: str, value: str) -> DataFrame:
    """Adds `above`, the sum of `value` over the rows before this one within equal `within`, and `rank`, how many there are.

    Rows are summed by segments of the order first, so that no group needs a window over all of its rows.
    """
    seg = F.floor(c(order) / SEGMENT)
    cut = rows.withColumn("seg", seg)
    each = cut.groupBy(within, "seg").agg(F.sum(value).alias("v"), F.count("*").alias("k"))
    before = Window.partitionBy(within).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(within, "seg", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("v"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"))
    inside = Window.partitionBy(within, "seg").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumn("__v", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn("__k", F.count("*").over(inside))
    return here.join(each, [within, "seg"]).withColumn("above", c("__v") + c("v")).withColumn("rank", c("__k") + c("k")).drop("seg", "v", "k", "__v", "__k")


def _digests(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """(depth, a, b, ends_sha256) of the rows (depth, a, b, conv_id): SHA-256 over the conv_ids in order, comma-joined.

    Ids are sorted in range partitions and joined there to chunks; what one task reads of a node is a row for each chunk,
    hashed as it comes.
    """
    import hashlib

    def key(rows: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(rows.column(x).to_pylist() for x in NODE), strict=True))

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for which, conv in zip(key(batch), batch.column("conv_id").to_pylist(), strict=True):
                if which != node or len(ids) == chunk:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = which, []
                ids.append(conv)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "conv_id", "ids"), x, strict=True)) for x in out])
                out = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "conv_id", "ids"), x, strict=True)) for x in out])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for which, ids in zip(key(batch), batch.column("ids").to_pylist(), strict=True):
                if which == node:
                    state.update(b",")
                else:
                    if node:
                        out.append(dict(zip((*NODE, "ends_sha256"), (*node, state.hexdigest()), strict=True)))
                    node, state = which, hashlib.sha256()
                state.update(ids.encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if node:
            out.append(dict(zip((*NODE, "ends_sha256"), (*node, state.hexdigest()), strict=True)))
            yield pa.RecordBatch.from_pylist(out)

    order = [*NODE, "conv_id"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "depth long, a long, b long, conv_id long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def _owners(tops: DataFrame, nodes: DataFrame, cuts: int = 64) -> DataFrame:
    """(conv_id, up): for each row (conv_id, depth, a, b) the owner of that node. Joined by (node, slice of the rows)."""
    rows = tops.withColumn("cut", F.pmod(F.xxhash64("conv_id"), F.lit(cuts)).cast("int"))
    wanted = rows.select(*NODE, "cut").distinct().join(nodes.select(*NODE, c("conv_id").alias("up")), NODE)
    return rows.join(wanted, [*NODE, "cut"]).select("conv_id", "up")


def prefix_trie(conversations: DataFrame, screened: int = 8) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. screened: the prefixes of a conversation that the sketch counts; longer ones follow from them."""
    convs, paths = _paths(_turns(conversations))
    bare = _chains(paths)
    plain = materialize(bare, "paths")
    sketch = Sketch(plain, convs.agg(F.sum(F.least("length", F.lit(screened)))).first()[0] or 0, screened)
    told = materialize(convs.join(sketch.proven(plain), "conv_id", "left"), "alone")
    chains = materialize(plain.join(told, "conv_id"), "screened")
    discard(plain)

    # prefixes that may be shared, each with the one before it; every conversation is a member of the root
    last = F.least(c("first") + F.size("a") - 1, F.coalesce(c("alone") - 1, c("length")))
    near = chains.where(c("alone").isNull() | (c("alone") > c("first"))).select(
        "conv_id", "first", "a", "b", "chars", "base_a", "base_b", F.explode(F.sequence(c("first"), last)).alias("depth")
    )
    i = (c("depth") - c("first")).cast("int")
    parent = {f"p{x}": F.when(i == 0, c(f"base_{x}")).otherwise(F.get(x, i - 1)) for x in ("a", "b")}
    shared = near.select("conv_id", "depth", F.get("a", i).alias("a"), F.get("b", i).alias("b"), F.get("chars", i).alias("chars"), *[e.alias(k) for k, e in parent.items()])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    members = shared.unionByName(convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars"), none.alias("pa"), none.alias("pb")))
    nodes = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    nodes = materialize(nodes, "nodes")

    # the top of a tail stands below the last prefix that may be shared
    in_top = chains.where((c("alone") >= c("first")) & (c("alone") < c("first") + F.size("a")))
    at = (c("alone") - c("first")).cast("int")
    tails = in_top.select("conv_id", (c("alone") - 1).alias("depth"), *[F.when(at == 0, c(f"base_{x}")).otherwise(F.get(x, at - 1)).alias(x) for x in ("a", "b")])
    children = nodes.where("depth > 0").select((c("depth") - 1).alias("depth"), c("pa").alias("a"), c("pb").alias("b")).unionByName(tails.select(*NODE))
    grown = nodes.join(children.groupBy(*NODE).agg(F.count("*").alias("n_children")), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    grown = materialize(_before(grown.withColumn("saves", (c("n_convs") - 1) * c("chars")), "conv_id", "depth", "saves"), "grown")

    # what each conversation owns: tokens saved, whether it ends in a leaf of its own, and the parent of its first own node
    owned = grown.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.max((c("n_children") == 0).cast("long")).alias("leaf"))
    own = told.join(owned, "conv_id", "left").select("conv_id", "alone", c("saves").isNotNull().alias("owner"), F.coalesce("saves", zero).alias("saves"), F.when(c("alone").isNotNull(), 1).otherwise(F.coalesce("leaf", zero)).cast("long").alias("leaf"))
    own = materialize(own, "owned")
    tops = grown.where("rank = 0 and depth > 0").select("conv_id", (c("depth") - 1).alias("depth"), c("pa").alias("a"), c("pb").alias("b"))
    tops = tops.unionByName(tails.join(own.where(~c("owner")), "conv_id", "left_semi"))
    up = materialize(_owners(tops, nodes), "up")

    gives = own.where("saves > 0 or leaf > 0").select("conv_id", "saves", "leaf")
    to_root = gives.select("conv_id", "saves", "leaf", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    sums = shared.select("conv_id", *NODE).join(gives, "conv_id").unionByName(to_root).groupBy(*NODE).agg(F.sum("saves").alias("below"), F.sum("leaf").alias("n_leaves"))
    final = (c("length") >= c("first")) & (c("length") < c("first") + F.size("a")) & c("alone").isNull()
    end = (c("length") - c("first")).cast("int")
    ends = chains.where(final).select("conv_id", c("length").alias("depth"), F.get("a", end).alias("a"), F.get("b", end).alias("b"))
    ends = ends.unionByName(convs.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b")))

    first_own = grown.where("rank = 0").join(up, "conv_id", "left").withColumn("parent_conv_id", c("up")).drop("up")
    others = grown.where("rank > 0").withColumn("parent_conv_id", c("conv_id"))
    exact = first_own.unionByName(others).join(sums, NODE, "left").join(_digests(ends), NODE, "left")
    exact = exact.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.coalesce("below", zero) - c("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    alone = chains.where("alone is not null").select("conv_id", "alone", "length", "first", F.size("a").alias("n")).where("first + n > alone")
    alone = alone.join(own.where(~c("owner")).join(up, "conv_id").select("conv_id", "up"), "conv_id", "left").withColumn("depth", F.explode(F.sequence(F.greatest("first", "alone"), c("first") + c("n") - 1)))
    ended = c("depth") == c("length")
    local = alone.select(
        "conv_id", "depth", F.when(c("depth") == c("alone"), F.coalesce("up", "conv_id")).otherwise(c("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(ended, F.sha2(c("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return exact.unionByName(local)
