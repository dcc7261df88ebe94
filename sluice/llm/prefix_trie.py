"""The trie of conversations that begin alike, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Turns are numbered by range partitions and the offsets of these, so that a
conversation's length doesn't bound a task. A prefix is known by its depth and four sums of 32-bit parts of a SHA-256 of each
turn and its place: sums over a conversation's parts add up, so prefixes need no fold over whole conversations.

Subtree totals: each round rakes the leaves (their sums go to their parents, with partial aggregation, so that no task
holds a hub's children) and compresses unary chains (nodes that come before both neighbours in an order are spliced
out; the order is by turns that of the trailing zeros of the depth, which takes every second node of a chain, and a hash). A round is an aggregation and two joins on unique ids. The
tree shrinks by a constant share each round. Then rounds are undone in reverse, and each spliced node gets its total from
its former child's.

Defined cases: turns are ordered by turn (null first), then role and text; a null role or text is empty; rows without a
conversation id belong to no conversation; repeated rows are turns of their own; an empty table gives no rows, not even a
root; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, cut, slices, written

#: Of a turn's digest: four parts of 32 bits. Sums of up to 2^31 turns stay exact in a long.
PARTS = ("s0", "s1", "s2", "s3")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, piece (rising along a conversation), place (from 1), said (a digest of role and text), chars (of text) of every turn."""
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(f"`{role}`", F.lit("")).alias("role"), F.coalesce(f"`{text}`", F.lit("")).alias("text"))
    ranged = rows.where("conv is not null").repartitionByRange(_partitions(rows), "conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    local = cut(ranged.select("conv", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at"), said.alias("said"), F.length("text").cast("long").alias("chars")))
    pieces = local.groupBy("conv", "piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    pieces = pieces.select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return local.join(pieces, (F.col("conv") == F.col("_conv")) & (F.col("piece") == F.col("_piece"))).select("conv", "piece", (F.col("at") + F.col("shift")).alias("place"), "said", "chars")


def rebuilt(turns: DataFrame, base: Callable[[Column], Column], heads: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its first heads(c) turns (at most `most`) replaced by those of conversation base(c).

    Gives the turns, and every conversation with the number of its turns (maybe 0).
    """
    turns = cut(turns)
    own = turns.groupBy(F.col("conv").alias("id")).agg(F.count("*").alias("own"))
    lengths = own.select(F.col("id").alias("b"), F.col("own").alias("base_own"))
    convs = own.withColumns({"base": base(F.col("id")), "heads": heads(F.col("id"))}).join(lengths, F.col("base") == F.col("b"), "left")
    convs = cut(convs.select("id", "base", "heads", F.least("heads", F.coalesce("base_own", F.lit(0))).alias("taken"), F.greatest(F.col("own") - F.col("heads"), F.lit(0)).alias("rest")))
    first = turns.where(F.col("place") <= most).select(F.col("conv").alias("b"), "place", "said", "chars")
    head = convs.join(first, (F.col("base") == F.col("b")) & (F.col("place") <= F.col("taken"))).select(F.col("id").alias("conv"), F.lit(-1).alias("piece"), "place", "said", "chars")
    tail = turns.join(convs, F.col("conv") == F.col("id")).where("place > heads").select("conv", "piece", (F.col("place") - F.col("heads") + F.col("taken")).alias("place"), "said", "chars")
    return head.unionByName(tail), convs.select(F.col("id").alias("conv"), (F.col("taken") + F.col("rest")).alias("turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, place, chars, key and parent_key of every turn's prefix; the key of no turns is null."""
    of = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), "said"), 256)
    parts = {p: F.conv(F.substring(of, 8 * k + 1, 8), 16, 10).cast("long") for k, p in enumerate(PARTS)}
    rows = cut(turns.withColumns(parts).drop("said"))
    pieces = rows.groupBy("conv", "piece").agg(*[F.sum(p).alias(p) for p in PARTS])
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv").alias("_conv"), F.col("piece").alias("_piece"), *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"_{p}") for p in PARTS])
    within = Window.partitionBy("conv", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(pieces, (F.col("conv") == F.col("_conv")) & (F.col("piece") == F.col("_piece"))).withColumns({f"+{p}": F.col(f"_{p}") + F.sum(p).over(within) for p in PARTS})
    key = F.struct("place", *[F.col(f"+{p}").alias(p) for p in PARTS])
    before = F.struct((F.col("place") - 1).alias("place"), *[(F.col(f"+{p}") - F.col(p)).alias(p) for p in PARTS])
    return sums.select("conv", "place", "chars", key.alias("key"), F.when(F.col("place") > 1, before).alias("parent_key"))


def _node(conv: str | Column, depth: str | Column) -> Column:
    """A node's name: its smallest member and its depth."""
    return F.struct((F.col(conv) if isinstance(conv, str) else conv).alias("c"), (F.col(depth) if isinstance(depth, str) else depth).cast("long").alias("d"))


def nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie (node, parent, n_convs, chars), and the node at which each conversation ends (conv, node)."""
    paths = cut(prefixes(turns))
    named = cut(paths.groupBy("key").agg(F.min("conv").alias("least"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("parent_key").alias("parent_key")))
    root = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = cut(root.select(_node("least", F.lit(0)).alias("node"), "n_convs"))
    above = named.select(F.col("key").alias("_key"), F.col("least").alias("up"))
    rows = named.join(above, F.col("parent_key") == F.col("_key"), "left").select(_node("least", "key.place").alias("node"), "up", "n_convs", "chars")
    found = top.first()
    first = F.lit(found["node"]["c"] if found else None).cast("long")
    rows = rows.select("node", _node(F.coalesce("up", first), F.col("node.d") - 1).alias("parent"), "n_convs", "chars")
    tree = rows.unionByName(top.select("node", F.lit(None).cast("struct<c:bigint,d:bigint>").alias("parent"), "n_convs", F.lit(0).cast("long").alias("chars")))
    last = paths.select(F.col("conv").alias("_conv"), "place", "key").join(convs.where("turns > 0"), (F.col("_conv") == F.col("conv")) & (F.col("place") == F.col("turns")))
    ends = last.join(named.select("key", "least"), "key").select("conv", _node("least", "place").alias("node"))
    none = convs.where("turns = 0").select("conv", _node(first, F.lit(0)).alias("node"))
    return cut(tree), ends.unionByName(none)


def _before(a: str, b: str, turn: int) -> Column:
    """Whether node a comes before node b in the order of a round: by turns fewer trailing zeros of the depth, and a hash."""
    zeros = lambda n: F.col(f"{n}.d").bitwiseAND(-F.col(f"{n}.d")) if turn % 2 == 0 else F.lit(0)
    rank = lambda n: F.struct(zeros(n), F.xxhash64(f"{n}.c", f"{n}.d", F.lit(turn)), F.col(n))
    return rank(a) < rank(b)


def subtree_sums(tree: DataFrame, values: list[str], max_rounds: int = 200) -> DataFrame:
    """node and each of `values` (long) summed over the node's subtree. tree: node, parent (null: root; struct c, d), values."""
    count = lambda df: df.groupBy(F.col("parent").alias("_up")).agg(F.count("*").alias("kids"))
    edges = tree.where("parent is not null")
    carried = [f"^{v}" for v in values]  # of the nodes that were spliced out just above a node
    start = tree.select("node", "parent", *values).join(count(edges), F.col("node") == F.col("_up"), "left")
    alive = written(start.select("node", "parent", *values, *[F.lit(0).cast("long").alias(c) for c in carried], F.coalesce("kids", F.lit(0)).alias("kids")))
    done: list[DataFrame] = []
    spliced: list[DataFrame] = []
    for turn in range(max_rounds):
        leaf = F.col("kids") == 0
        done.append(alive.where(leaf).select("node", *values))
        rest = alive.where(~leaf)
        if rest.isEmpty():
            break
        sums = [F.sum(F.when(leaf, F.col(v) + F.col(f"^{v}"))).alias(f"+{v}") for v in values]
        between = [F.sum(F.when(~leaf, F.col(f"^{v}"))).alias(f"-{v}") for v in values]  # above an only child, where there is one
        below = alive.where("parent is not null").groupBy(F.col("parent").alias("_up")).agg(*sums, *between, F.count_if(leaf).alias("gone"), F.min(F.when(~leaf, F.col("node"))).alias("only"))
        raked = rest.join(below, F.col("node") == F.col("_up"))
        raked = raked.select("node", "parent", *[(F.col(v) + F.coalesce(f"+{v}", F.lit(0))).alias(v) for v in values], *carried, (F.col("kids") - F.col("gone")).alias("kids"), "only", *[f"-{v}" for v in values])
        out = (F.col("kids") == 1) & F.col("parent").isNotNull() & _before("node", "parent", turn) & _before("node", "only", turn)
        raked = written(raked.withColumn("out", F.coalesce(out, F.lit(False))))
        gone = raked.where("out")
        spliced.append(gone.select("node", "only", *[(F.col(v) + F.col(f"-{v}")).alias(v) for v in values]))
        lifted = gone.select(F.col("only").alias("_child"), F.col("parent").alias("higher"), *[(F.col(v) + F.col(f"^{v}")).alias(f"+{v}") for v in values])
        alive = written(raked.where("not out").join(lifted, F.col("node") == F.col("_child"), "left").select("node", F.coalesce("higher", "parent").alias("parent"), *values, *[(F.col(f"^{v}") + F.coalesce(f"+{v}", F.lit(0))).alias(f"^{v}") for v in values], "kids"))
    else:
        raise RuntimeError("the tree did not contract")
    return _expanded(done, spliced, values)


def _expanded(raked: list[DataFrame], spliced: list[DataFrame], values: list[str]) -> DataFrame:
    """The totals of raked nodes, and of spliced ones from the last round to the first: their own sum and their child's total."""
    known = raked[-1]
    for own, leaves in zip(reversed(spliced), reversed(raked[:-1]), strict=True):
        below = known.select(F.col("node").alias("_only"), *[F.col(v).alias(f"+{v}") for v in values])
        new = own.join(below, F.col("only") == F.col("_only")).select("node", *[(F.col(v) + F.col(f"+{v}")).alias(v) for v in values])
        known = written(known.unionByName(new).unionByName(leaves).coalesce(_partitions(known)))
    return known


def joined_digest(rows: DataFrame, group: str, value: str, size: int = 1 << 16) -> DataFrame:
    """group and the SHA-256 (lowercase hex) of its values (long) as decimals, ascending, comma-joined.

    Values are sorted by range partitions and joined there to strings of about `size` bytes. Only these meet by group, and are
    hashed one after the other, so that a task's memory doesn't grow with a group.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[str] = []
        now, first, n = None, 0, 0
        one = lambda: batch(["g", "first", "text"], pa.array([now], kind), pa.array([first], pa.int64()), pa.array([",".join(text)], pa.string()))
        kind = pa.string()
        for b in slices(batches, 1 << 16):
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and (g != now or n >= size):
                    yield one()
                    text, n = [], 0
                if not text:
                    now, first = g, v
                text.append(str(v))
                n += len(text[-1]) + 1
        if text:
            yield one()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in slices(batches):
            names, sums = [], []
            for g, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if h is not None and g == now:
                    h.update(b"," + t.encode())
                    continue
                if h is not None:
                    names.append(now)
                    sums.append(h.hexdigest())
                now, h = g, hashlib.sha256(t.encode())
            yield batch(["g", "digest"], pa.array(names, pa.string()), pa.array(sums, pa.string()))
        if h is not None:
            yield batch(["g", "digest"], pa.array([now], pa.string()), pa.array([h.hexdigest()], pa.string()))

    n = _partitions(rows)
    ranged = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).repartitionByRange(n, "g", "v").sortWithinPartitions("g", "v")
    joined = ranged.mapInArrow(join, "g string, first bigint, text string")
    return joined.repartition(n, "g").sortWithinPartitions("g", "first").mapInArrow(digest, "g string, digest string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens: over the subtree, what a shared prefix saves: members but one times the code points of the node's last text.
    """
    tree, ends = nodes(turns, convs)
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("_up")).agg(F.count("*").alias("n_children"))
    tree = written(tree.join(kids, F.col("node") == F.col("_up"), "left").select("node", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "chars"))
    weights = tree.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(weights, ["n_leaves", "saved_tokens"])
    name = F.concat_ws(":", F.col("node.c").cast("string"), F.col("node.d").cast("string"))
    digests = joined_digest(ends.select(name.alias("name"), "conv"), "name", "conv")
    digests = digests.select(F.struct(F.split("g", ":")[0].cast("long").alias("c"), F.split("g", ":")[1].cast("long").alias("d")).alias("node"), "digest")
    out = tree.join(sums, "node").join(digests, "node", "left")
    return out.select(F.col("node.c").alias("conv_id"), F.col("node.d").alias("depth"), F.col("parent.c").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
