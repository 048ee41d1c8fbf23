"""Operator 6: near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct shingles of ``words`` words.  Documents
whose sets have a Jaccard similarity of at least ``percent`` / 100 are linked.

1. One pass over the texts gives each row the size of its set, a 128-bit
   fingerprint of the set and ``COORDS`` minwise tokens.  Rows with equal
   fingerprints form one class, so that exact copies are dealt with at once.
2. ``TREES`` independent trees branch all classes: a node chooses one or two
   coordinates by its own hash (1.25 on average, the inverse of the similarity)
   and sends each member to the child of its minwise token there.  Deeper nodes
   add two and three tokens at once (``STEPS``), so that sets that have little in
   common part quickly, and take more paths, so that pairs still meet.
3. Nodes of at most ``LEAF`` members are leaves.  All members of a leaf are
   compared, first by their minwise tokens and, where ``AGREE`` of these agree,
   on their full sets.  Leaves with the same members, from whatever tree, count
   once.
   Nodes with more members are leaves too if they have few open pairs: members
   of one label are linked already, so only pairs with a member outside the
   largest label are open.
4. In larger nodes each member is first compared with a few leaders, the members
   with most of the node's most frequent tokens.  The
   components of all links so far are the labels.  Nodes that are still no leaf
   then branch again, with labels that know the leaves' links too.  Nodes of one
   label are finished.  What is no leaf after all levels is compared in blocks,
   each member outside the largest label with all members.
5. Leaves return a star for each group of linked members, not all pairs.
   Connected components of the stars are those of the links.

Every link is confirmed on full sets.  All trees draw from the same tokens, so
they are not independent: of the pairs just at 0.8 whose tokens agree often
enough, ten trees miss 6 in 10^7 at depth one, 3 in 10^6 at depth two and 9 in
10^6 at depth three if every node of the levels before is large
(``miss_rate``).  The tokens refuse three more in 10^6.

Cases: a null or empty text, or one of white space, has an empty set and links
with nothing; fewer words than a shingle make one shingle of them all; rows
with an equal id are one node; a null id links with nothing and has a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import arrow_batches, slices, stage, table, unstage
from .components import components
from .forest import Forest
from .groups import complete_groups

#: Bytes of text that a task hashes at once; its arrays take some sixty times as many.
SLICE = 1 << 20
COORDS = 32
TREES = 10
LEAF = 1000
#: Open pairs (a few seconds of comparing minwise tokens), and members, of a node that is compared completely once its members know their leaders' links.
LEAF_PAIRS = 64_000_000
LEAF_ROWS = 100_000
#: Members whose tokens say what is typical of a node, and members that are compared with all others of it first.
SAMPLE, LEADERS = 64, 4
#: Coordinates that a node's children add to the path, and how many paths a node takes at most; by level.
STEPS = ((1, 2), (2, 5), (3, 8))
#: Percent of the nodes that take the last of these paths.
LAST_PATH = (25, 100, 100)
BLOCK = 4000
#: Ids (of 8 bytes) that are broadcast at most to pick texts by id; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SALTS = 16
#: Minwise tokens that must agree before full sets are fetched: a pair at 0.8 has fewer with probability 3 * 10^-6.
AGREE = 14
_MULTIPLIERS = textnum.mix(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def miss_rate(similarity: float, depth: int) -> float:
    """Probability that a pair with ``AGREE`` tokens in common meets in no node of level ``depth``, all nodes before being large.

    A path draws its coordinates with replacement; trees are independent given
    how many tokens agree.
    """
    out = 0.0
    for agree in range(AGREE, COORDS + 1):
        miss = 0.0
        for (step, paths), last in reversed(list(zip(STEPS[:depth], LAST_PATH, strict=False))):
            path = 1 - (agree / COORDS) ** step * (1 - miss)
            miss = path ** (paths - 1) * (1 - last / 100 * (1 - path))
        out += math.comb(COORDS, agree) * similarity ** agree * (1 - similarity) ** (COORDS - agree) * miss ** TREES
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches with the first place of each non-empty set, set sizes, and all hashes."""
    for b in slices(batches, "text", SLICE):
        data, off = textnum.utf8(b.column(b.schema.get_field_index("text")))
        doc, h = textnum.shingles(data, off, words)
        yield b, np.bincount(doc, minlength=b.num_rows), np.flatnonzero(np.diff(doc, prepend=-1)), h


def _fingerprints(size: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(first):
        a[size > 0] = np.add.reduceat(h, first)
        b[size > 0] = np.bitwise_xor.reduceat(textnum.mix(h + np.uint64(0x632BE59BD9B4E019)), first)
    return a.view(np.int64), b.view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, size, first, h in _sets(batches, words):
            k1, k2 = _fingerprints(size, first, h)
            sig = np.zeros((b.num_rows, COORDS), np.uint32)
            if len(first):
                for i, m in enumerate(_MULTIPLIERS):
                    sig[size > 0, i] = np.minimum.reduceat((h * m) >> np.uint64(32), first)
            tokens = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * COORDS), pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(k1), pa.array(k2), tokens], names=["doc_id", "n", "k1", "k2", "sig"])
    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, size, first, h in _sets(batches, words):
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["cid", "tokens"])
    return run


def link_sets(label: np.ndarray, size: np.ndarray, flat: np.ndarray, percent: int) -> np.ndarray:
    """Position of the first member linked, maybe over others, with each member of one group.

    ``flat`` holds the members' sets one after the other.  Members of one label
    are linked already, so pairs of one component are never compared.
    """
    count = len(size)
    forest = Forest(count)
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    forest.union(np.arange(count), first[inverse])
    owner = np.repeat(np.arange(count), size)
    order = np.argsort(flat, kind="stable")
    same = np.diff(flat[order]) == 0
    number = np.concatenate([[0], np.cumsum(~same)])
    shared = np.zeros(len(flat), bool)
    shared[1:] |= same
    shared[:-1] |= same
    token = np.empty(len(flat), np.int64)
    token[order] = number
    common = np.empty(len(flat), bool)
    common[order] = shared
    token, owner = token[common], owner[common]
    held = np.bincount(owner, minlength=count)
    able = held * 100 >= percent * size
    keep = able[owner]
    token, owner = token[keep], owner[keep]
    ends = np.searchsorted(owner, np.arange(count + 1))
    mark = np.zeros(int(number[-1]) + 1 if len(number) else 1, bool)
    able = np.flatnonzero(able)
    roots = forest.roots()
    for x in able[roots[able] != _most(roots)]:
        if (roots[able] == roots[x]).all():
            continue
        mine = token[ends[x]:ends[x + 1]]
        mark[mine] = True
        both = np.bincount(owner[mark[token]], minlength=count)
        mark[mine] = False
        y = np.flatnonzero(100 * both >= percent * (size[x] + size - both))
        y = y[roots[y] != roots[x]]
        if len(y):
            forest.union(np.full(len(y), x), y)
            roots = forest.roots()
    return roots


def _borders(node: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])


def _most(label: np.ndarray) -> int:
    """The most frequent label.  Its members are linked with each other, so all open pairs have a member of another one."""
    values, count = np.unique(label, return_counts=True)
    return values[count.argmax()]


def close_members(label: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """For each member of one group the first one that it may be linked with, maybe over others, judged by minwise tokens."""
    forest = Forest(len(label))
    tokens = np.ascontiguousarray(sig.T)
    for x in np.flatnonzero(label != _most(label)):
        agree = np.zeros(len(label), np.uint8)
        for t in tokens:
            agree += t == t[x]
        y = np.flatnonzero((agree >= AGREE) & (label != label[x]))
        if len(y):
            forest.union(np.full(len(y), x), y)
    root = forest.roots()
    # A part of one label has nothing left to find.
    low, high = np.full(len(label), np.iinfo(np.int64).max), np.full(len(label), np.iinfo(np.int64).min)
    np.minimum.at(low, root, label)
    np.maximum.at(high, root, label)
    return np.where(low[root] < high[root], root, -1)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each node that may have a link there; ``node`` becomes a name of the members, equal for equal ones."""
    for t in complete_groups(batches, "node"):
        node, cid, label = (t.column(c).to_numpy() for c in ("node", "cid", "label"))
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
        name, keep = np.zeros(len(node), np.uint64), np.zeros(len(node), bool)
        edge = _borders(node)
        scrambled = textnum.mix(cid.view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                root = close_members(label[a:b], sig[a:b])
                sums = np.zeros(b - a, np.uint64)
                np.add.at(sums, root, scrambled[a:b])
                keep[a:b] = root >= 0
                name[a:b] = sums[root]
        yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)[keep]), pa.array(cid[keep]), pa.array(label[keep])], names=["node", "cid", "label"])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, "node"):
            node, cid, label = (t.column(c).to_numpy() for c in ("node", "cid", "label"))
            tokens = t.column("tokens").combine_chunks()
            flat, size = tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy()).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            edge = _borders(node)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if b - a > 1:
                    to = a + link_sets(label[a:b], size[a:b], flat[ends[a]:ends[b]], percent)
                    moved = np.flatnonzero(cid[to] != cid[a:b])
                    if len(moved):
                        yield pa.RecordBatch.from_arrays([pa.array(cid[a:b][moved]), pa.array(cid[to][moved])], names=["a", "b"])
    return run


def _branch(rows: DataFrame, depth: int) -> DataFrame:
    """Children (node, cid, label) of rows (node, cid, label, sig)."""
    coord = lambda *salt: F.pmod(F.xxhash64("node", *map(F.lit, salt)), F.lit(COORDS)).cast("int")
    step, paths = STEPS[depth - 1]
    child = [F.xxhash64("node", F.lit(p), *(x for i in range(step) for x in (coord(p, i), F.get("sig", coord(p, i))))) for p in range(paths)]
    # The last path is taken by a part of the nodes.
    part = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(100)) < LAST_PATH[depth - 1]
    return rows.select(F.explode(F.filter(F.array(*child[:-1], F.when(part, child[-1])), lambda c: c.isNotNull())).alias("node"), "cid", "label")


def _measured(rows: DataFrame) -> DataFrame:
    """(node, n, outside, top, print) of nodes with more than one label: members, those outside the most frequent label, that label, a name of the members."""
    per = rows.groupBy("node", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("print"))
    return per.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("print").alias("print")).where(
        "labels > 1").select("node", "n", (F.col("n") - F.col("top.n")).alias("outside"), F.col("top.label").alias("top"), "print")


def _is_leaf(pairs: int) -> Column:
    """Every open pair has a member outside the largest label, so a node costs their number times its members."""
    return (F.col("n") <= LEAF) | ((F.col("outside") * F.col("n") <= pairs) & (F.col("n") <= LEAF_ROWS))


def _once(nodes: DataFrame) -> DataFrame:
    """One node of those with the same members."""
    return nodes.groupBy("n", "print").agg(F.min_by(F.struct(*nodes.columns), "node").alias("x")).select("x.*")


def _outside_blocks(inside: DataFrame) -> DataFrame:
    """Groups (node, cid, label) in which each member outside its node's largest label meets every member of the node."""
    rows, columns = F.ceil(F.col("outside") / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    name = lambda i, j: F.xxhash64("node", i, j)
    mine = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: name(i, F.pmod(F.xxhash64("cid", F.lit(7)), columns).cast("int")))
    across = F.transform(F.sequence(F.lit(0), columns - 1), lambda j: name(F.pmod(F.xxhash64("cid", F.lit(8)), rows).cast("int"), j))
    groups = F.when(F.col("label") != F.col("top"), F.array_union(mine, across)).otherwise(mine)
    return inside.select(F.explode(groups).alias("node"), "cid", "label")


def _best(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("node").orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= most).drop("__place")


def _leaders(inside: DataFrame) -> DataFrame:
    """(node, leader, theirs): the ``LEADERS`` most typical members of each node, with their minwise tokens.

    Typical are members with the tokens that are most frequent in a sample of the node, so that copies of
    one text meet their original."""
    some = _best(inside.select("node", "cid", "sig"), SAMPLE, F.xxhash64("cid", "node"))
    counts = some.select("node", F.posexplode("sig").alias("i", "t")).groupBy("node", "i", "t").agg(F.count("*").alias("n"))
    common = counts.groupBy("node", "i").agg(F.max(F.struct("n", "t")).alias("x"))
    common = common.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("x.t").alias("t")))), lambda x: x["t"]).alias("theirs"))
    judged = _salted(inside.select("node", "cid", "sig"), common).select("node", "cid", "sig", _agreement().alias("agree"))
    return _best(judged, LEADERS, F.desc("agree"), F.xxhash64("cid", "node")).select("node", F.col("cid").alias("leader"), F.col("sig").alias("theirs"))


def _agreement() -> Column:
    return F.size(F.filter(F.zip_with("sig", "theirs", lambda a, b: a == b), lambda same: same))


def _leader_pairs(inside: DataFrame) -> DataFrame:
    """(cid, node, leader) of members whose minwise tokens allow a link with a leader of their largest node."""
    chosen = inside.groupBy("cid").agg(F.max(F.struct("n", "node")).alias("x"), F.first("sig").alias("sig")).select("cid", F.col("x.node").alias("node"), "sig")
    pairs = _salted(chosen, _leaders(inside)).where((F.col("cid") != F.col("leader")) & (_agreement() >= AGREE))
    return stage(pairs.select("cid", "node", "leader"), "near-pairs")


def _salted(members: DataFrame, leader: DataFrame, *more: str) -> DataFrame:
    """Join on the node, whose members are dealt over SALTS and each leader copied to all; a node has over LEAF members."""
    return members.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS))).join(
        leader.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["node", "salt", *more])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links on their full sets."""
    leader = pairs.select("node", "leader").distinct().join(sets.select(F.col("cid").alias("leader"), F.col("tokens").alias("theirs")), "leader")
    both = F.size(F.array_intersect("tokens", "theirs"))
    return (_salted(pairs.select("cid", "node", "leader").join(sets, "cid"), leader, "leader")
            .where(100 * both >= percent * (F.size("tokens") + F.size("theirs") - both)).select("cid", "leader").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(texts.mapInArrow(_sign(words), "doc_id long, n long, k1 long, k2 long, sig array<int>"), "near-rows")
    classes = stage(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig")), "near-classes")
    named = classes.where("cid is not null")
    sigs = named.select("cid", "sig")
    open_rows = sigs.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(TREES)), lambda t: F.xxhash64(t))).alias("node"), "cid",
                            F.col("cid").alias("label"), "sig")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_node = lambda df: df.repartition(n_parts, "node").sortWithinPartitions("node")
    nothing = spark.createDataFrame([], "node long, component long")
    sets, met, group = spark.createDataFrame([], "cid long, tokens array<long>"), spark.createDataFrame([], "cid long"), nothing

    def fetch(cids: DataFrame) -> None:
        """Full sets of classes that were not fetched before."""
        nonlocal sets, met
        new = stage(cids.distinct().join(met, "cid", "left_anti"), "near-new")
        if not new.isEmpty():
            wanted = texts.join(F.broadcast(new) if new.count() <= BROADCAST_IDS else new, F.col("doc_id") == F.col("cid"), "left_semi")
            sets, met = sets.union(stage(wanted.mapInArrow(_full(words), "cid long, tokens array<long>"), "near-sets")), met.union(new)

    def close_links(links: DataFrame) -> None:
        """Components over all links so far; ``group`` stands for those before."""
        nonlocal group
        if links.isEmpty():
            return
        group = stage(components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "near-group")

    def relabelled(rows: DataFrame) -> DataFrame:
        known = group.select(F.col("node").alias("__cid"), "component")
        return rows.join(known, F.col("cid") == F.col("__cid"), "left").select("node", "cid", F.coalesce("component", "cid").alias("label"))

    for depth in range(1, len(STEPS) + 1):
        last = depth == len(STEPS)
        kids = stage(_branch(open_rows, depth), "near-nodes")
        found = stage(_measured(kids), "near-found")
        large = found.where(~_is_leaf(LEAF * LEAF))
        if not large.isEmpty():
            inside = stage(kids.join(large.select("node", "n"), "node").join(sigs, "cid"), "near-inside")
            pairs = _leader_pairs(inside)
            fetch(pairs.select("cid").union(pairs.select("leader")))
            linked = stage(_confirmed(pairs, sets, percent), "near-linked")
            if not linked.isEmpty():
                close_links(linked.select(F.col("cid").alias("a"), F.col("leader").alias("b")))
                before = kids, found
                kids = stage(relabelled(kids.join(found.select("node"), "node", "left_semi")), "near-nodes")
                found = stage(_measured(kids), "near-found")
                unstage(*before)
        large = found.where(~_is_leaf(LEAF_PAIRS))
        leaf = kids.join(_once(found.where(_is_leaf(LEAF_PAIRS))).select("node"), "node").select("node", "cid", "label")
        # Large nodes with the same members branch each in its own way, and count once only where they are compared completely.
        inside = stage(kids.join(_once(large) if last else large, "node"), "near-inside")
        more = not inside.isEmpty()
        if more and last:
            leaf = leaf.union(_outside_blocks(inside))
        close = stage(by_node(leaf.join(sigs, "cid").select("node", "cid", "label", "sig"))
                      .mapInArrow(_close, "node long, cid long, label long").distinct(), "near-close")
        fetch(close.select("cid"))
        links = stage(by_node(close.join(sets, "cid").select("node", "cid", "label", "tokens")).mapInArrow(_compare(percent), "a long, b long"), "near-links")
        close_links(links)
        unstage(kids, found, close, links)
        if not more or last:
            break
        still = relabelled(inside)
        several = still.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node")
        open_rows = still.join(several, "node").join(sigs, "cid")
    by_class = classes.join(group, F.col("cid") == F.col("node"), "left").select("k1", "k2", "n", F.coalesce("component", "cid").alias("component"))
    # Rows of an empty set have no class and stay on their own.
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n", "k1", "k2").join(by_class, ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns; rows with a null id stay."""
    first = near_duplicates(docs, words, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("__d")).distinct()
    rows = docs.join(first, docs[id_col] == F.col("__d"), "left_semi")
    # Of rows that share an id the one with the smallest text hash stays, so that a task run again keeps the same one.
    once = rows.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(id_col).alias("__d"))
    whole = F.struct(*[docs[c] for c in docs.columns])
    order = F.struct(F.xxhash64(docs[text_col]), docs[text_col], F.to_json(whole))
    many = rows.join(once, docs[id_col] == F.col("__d"), "left_semi").groupBy(id_col).agg(F.min_by(whole, order).alias("__row")).select("__row.*")
    return rows.join(once, docs[id_col] == F.col("__d"), "left_anti").unionByName(many).unionByName(docs.where(F.col(id_col).isNull()))


def op6_chosen_path(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all ``documents`` on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)
