"""N-gram Jaccard join by signature trees: exact links and their components.

A document is the set of its word n-grams, hashed to 64 bits; equal sets are one node, named by a hash of the set. Nodes
that may be linked are brought together by keys that no linked pair fails to share, in two steps. Of a set of n, the n -
ceil(t n) + m smallest hashes are its prefix: two sets with an index of t or more share at least m of these. Of the
prefix, hashes that no other node's prefix has are of no use; a node left with fewer than it has to share is out, as are
most nodes. Of the c that are left, in order of how many nodes have them, the rarest c - m + 1 are the node's keys. What
keys tie together, directly or not, is a family, and no link leads out of it. Keys find no links; they only say which
nodes go into trees together.

Links are found by signature trees: a node of a tree has the OR of the token bitmaps below it and the range of their
sizes; a tree is traversed with itself, or with another, and a pair of nodes is given up when the greatest overlap that
bitmaps and sizes allow is too small, or when all below is one component already. Pairs of leaves that are left are
compared exactly. Families, large ones in chunks, are cut into blocks of bounded bytes as they stream by, with a tree
each; a family of one block, as most are, is done with that. The chunks of a large family have its most typical nodes in
common, which settles large groups of copies; and nodes that still share a key with another component go into blocks by
size, of which those with fitting sizes and different components are traversed in pairs.

Defined results: without words there is no n-gram, no link, and the component is the document's own id; fewer words than
n make a single n-gram; rows with the same id are separate documents with the same id; null ids count as greater than
all others, and a component of only such has a null id; ties need no breaking, as results are sets; an empty table gives
an empty result; other columns are ignored. Hashes of 64 bits stand for n-grams and sets: for two of 10^9 different sets
to be taken for one has odds of about 1 in 40.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_batches, matched, remove, scratch, ship, unused, written

U = np.uint64
PHI, A, C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BITS, FAN = 2048, 8
#: So many hashes at least are shared by prefixes, or all that sets have to share.
WHOLE = 64
#: From so many nodes on, a hash is as common as can be; one that so many nodes of a single batch have doesn't go to one task.
COMMON = 32
#: A task hands on about so many rows at once.
ROWS_AT_ONCE = 1 << 20
#: Rows of such hashes, and edges of large stars, are spread over so many groups.
SALTS = 256
#: Stars of so many edges aren't left to one task.
COMMON_STAR = 1_000
#: A block has at most so many nodes and hashes (or a single longer set); chunks of larger families have about CHUNK nodes, and PIVOTS more that all have.
BLOCK, CHUNK, PIVOTS, BLOCK_HASHES = 1_000, 200, 16, 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 well-mixed bits, one to one (Steele, Lea and Flood 2014)."""
    x = x + PHI
    x = (x ^ (x >> U(30))) * A
    x = (x ^ (x >> U(27))) * C
    return x ^ (x >> U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams of words, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total ^ h[k : len(h) - width + 1 + k])
    return np.unique(total)


def set_name(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])


def shared(n: int, num: int) -> int:
    """m(n): how many hashes of prefixes two linked sets of at least n share; small sets are their own prefix."""
    return max(min((num * n + 99) // 100, WHOLE), 1 + (100 - num) * n // 100)


def prefix(s: np.ndarray, num: int) -> np.ndarray:
    """The smallest hashes of a set, shared(n) of which are in the prefix of each linked set that is no smaller."""
    n = len(s)
    return s[: n - (num * n + 99) // 100 + shared(n, num)]


def least_shared(n: Column, num: int) -> Column:
    """shared() of the smallest set that one of n can be linked with."""
    low = F.floor((num * n + 99) / 100)
    return F.greatest(F.least(F.floor((num * low + 99) / 100), F.lit(WHOLE)), 1 + F.floor((100 - num) * low / 100))


def linked(a: np.ndarray, b: np.ndarray, num: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= num * (len(a) + len(b) - both)


class Tree:
    """A signature tree over sets: level 0 are the leaves, like next to like by component, least hash and size; each further level ORs FAN of the one below."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray | None = None) -> None:
        sizes, first = np.array([len(s) for s in sets]), np.array([s[0] for s in sets])
        self.order = np.lexsort((sizes, first) if component is None else (sizes, first, component))
        self.sets = [sets[i] for i in self.order]
        self.component = np.arange(len(sets)) if component is None else component[self.order]
        bits = np.zeros((len(sets), BITS // 8), np.uint8)
        for i, s in enumerate(self.sets):
            on = np.zeros(BITS, np.uint8)
            on[(s & U(BITS - 1)).astype(np.int64)] = 1
            bits[i] = np.packbits(on)
        n = sizes[self.order]
        maps = bits.view(np.uint64)
        spare = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, spare)]
        while len(self.levels[-1][0]) > 1:
            maps, lo, hi, spare = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(spare, at)))
        self.label()

    def label(self) -> None:
        """The component below each node, -1 where there are several."""
        self.below = [self.component]
        for _ in self.levels[1:]:
            at = np.arange(0, len(self.below[-1]), FAN)
            least = np.minimum.reduceat(self.below[-1], at)
            self.below.append(np.where(least == np.maximum.reduceat(self.below[-1], at), least, -1))

    def children(self, level: int, i: np.ndarray) -> np.ndarray:
        """For each node its children on the level below, -1 where there are fewer than FAN."""
        out = i[:, None] * FAN + np.arange(FAN)
        return np.where(out < len(self.levels[level - 1][0]), out, -1)


def possible(a: Tree, b: Tree, la: int, lb: int, i: np.ndarray, j: np.ndarray, num: int) -> np.ndarray:
    """Which pairs of nodes may have linked leaves of different components below them."""
    comp_a, comp_b = a.below[la][i], b.below[lb][j]
    fits = (comp_a != comp_b) | (comp_a == -1)
    maps_a, lo_a, hi_a, spare_a = (x[i] for x in a.levels[la])
    maps_b, lo_b, hi_b, spare_b = (x[j] for x in b.levels[lb])
    fits &= (num * lo_a <= 100 * hi_b) & (num * lo_b <= 100 * hi_a)
    need = num * (lo_a + lo_b)  # of (100 + num) times the overlap
    most = np.bitwise_count(maps_a & maps_b).sum(axis=1).astype(np.int64) + np.minimum(spare_a, spare_b)
    fits &= (100 + num) * np.minimum(most, np.minimum(hi_a, hi_b)) >= need
    if la == lb == 0:  # of two sets, bits that differ are n-grams that differ
        differ = np.bitwise_count(maps_a ^ maps_b).sum(axis=1).astype(np.int64)
        fits &= (100 + num) * (lo_a + lo_b - differ) >= 2 * need
    return fits


def traverse(a: Tree, b: Tree, num: int, same: bool, at_once: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal from the roots: batches of pairs of leaves that may be linked. Labels may change between batches."""
    stack = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > at_once:
            stack += [(la, lb, i[at_once:], j[at_once:]), (la, lb, i[:at_once], j[:at_once])]
            continue
        if not (la == lb == 0 and same and len(a.sets) == 1):
            ok = possible(a, b, la, lb, i, j, num)
            i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == lb == 0:
            if not (same and len(a.sets) == 1):
                yield i, j
            continue
        down_a, down_b = la >= lb, lb >= la
        ci = a.children(la, i) if down_a else i[:, None]
        cj = b.children(lb, j) if down_b else j[:, None]
        ii, jj = np.repeat(ci, cj.shape[1], axis=1).ravel(), np.tile(cj, (1, ci.shape[1])).ravel()
        keep = (ii >= 0) & (jj >= 0)
        if same:
            keep &= (ii < jj) if la - down_a == 0 else (ii <= jj)
        stack.append((la - down_a, lb - down_b, ii[keep], jj[keep]))


def tree_links(a: Tree, b: Tree, num: int, same: bool) -> list[tuple[int, int]]:
    """Links that join different components, as places in the trees' orders; what links have joined up is one component from then on."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    found = []
    for i, j in traverse(a, b, num, same):
        before = len(found)
        for p, q in zip(i.tolist(), j.tolist()):
            x, y = find(int(a.component[p])), find(int(b.component[q]))
            if x != y and linked(a.sets[p], b.sets[q], num):
                root[x] = y
                found.append((p, q))
        if len(found) > before:
            for tree in {id(a): a, id(b): b}.values():
                names, at = np.unique(tree.component, return_inverse=True)
                tree.component = np.array([find(x) for x in names.tolist()], np.int64)[at]
                tree.label()
    return found


def components(edges: DataFrame, what: str) -> DataFrame:
    """node and root (the least node that it reaches) by large-star and small-star steps (Kiveris et al. 2014), each a table in the shared folder.

    Where a node has very many neighbours, its edges are dealt to many tasks.
    """
    spark = edges.sparkSession
    path = scratch(spark, what)
    edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().write.parquet(path)
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        degrees = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        n, most, unsettled = degrees.agg(F.sum("up"), F.max("down"), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0)))).first()
        if not unsettled:  # each node has one edge to a root, and roots have none
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, n, most).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _with_least(large, n, most)
        stepped = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch(spark, what)
        stepped.write.parquet(new)
        remove(spark, path)
        path = new


def _with_least(edges: DataFrame, n: int, most: int) -> DataFrame:
    """edges with m, the least v of their u. There are about n edges, and at most about `most` of one node."""
    if most < COMMON_STAR:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return matched(edges, least, "u", "n", 2 * n).select("u", "v", F.col("of.m").alias("m"))


def families(docs: DataFrame, n: int = 5, num: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id. Links: 100 * intersection >= num * union of the sets of word n-grams."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    rows = rows.withColumn("mark", F.xxhash64("text"))

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(len(s), set_name(s) if len(s) else None) for s in (shingles(t, n) for t in b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "mark": b["mark"], "n_shingles": [g[0] for g in got], "node": pd.array([g[1] for g in got], "Int64")})

    named = written(in_batches(rows, name, f"doc_id {kind}, mark long, n_shingles long, node long"), "jaccard-names")
    keyed = written(_keys(rows, n, num), "jaccard-keys")
    family = components(_ties(keyed), "jaccard-families")
    held = written(_held(rows, named, family, keyed, block), "jaccard-held")
    joined = _joined(held, keyed, n, num, block)
    discard(keyed, held)
    # from copies to nodes, to components and back: a node, or a component, may have very many of the rows
    nodes = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = written(nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("nodes")).where("nodes > 1")
    above = matched(rooted, least, "root", "nodes", rooted.count())
    of_node = written(above.where("n > 1 or of is not null").select("node", "n", F.when(F.col("of").isNull(), F.col("first")).otherwise(F.col("of.least")).alias("least")), "jaccard-least")
    out = matched(named, of_node, "node", "n", named.count())
    return out.select("doc_id", "n_shingles", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("of.least")).alias("component_id"))


def _keys(rows: DataFrame, n: int, num: int) -> DataFrame:
    """token, node and whether the token is common: the keys of all nodes that may have links."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            tokens, nodes, sizes, held = [], [], [], 0
            for text in b["text"]:
                s = shingles(text, n)
                if len(s) and (node := set_name(s)) not in seen:
                    seen.add(node)
                    tokens.append(prefix(s, num))
                    nodes.append(np.full(len(tokens[-1]), node, np.int64))
                    sizes.append(np.full(len(tokens[-1]), len(s), np.int32))
                    held += len(tokens[-1])
                if held > ROWS_AT_ONCE:
                    yield spread(np.concatenate(tokens).view(np.int64), np.concatenate(nodes), np.concatenate(sizes))
                    tokens, nodes, sizes, held = [], [], [], 0
            if tokens:
                yield spread(np.concatenate(tokens).view(np.int64), np.concatenate(nodes), np.concatenate(sizes))

    def spread(token: np.ndarray, node: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        """Rows of tokens that are common in this batch alone go to many tasks; a row of size 0 tells the token's own task."""
        names, at, count = np.unique(token, return_inverse=True, return_counts=True)
        common = count[at] >= COMMON
        salt = np.where(common, 1 + (node.view(np.uint64) % U(SALTS)).astype(np.int64), 0).astype(np.int16)
        told = names[count >= COMMON]
        none = np.zeros(len(told), np.int64)
        return pd.DataFrame({"token": np.concatenate([token, told]), "salt": np.concatenate([salt, none.astype(np.int16)]), "node": np.concatenate([node, none]), "size": np.concatenate([size, none.astype(np.int32)])})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """In the order of tokens: how many nodes have each, up to COMMON; tokens of one node are left out."""
        waiting, running, last = None, None, None  # fewer than COMMON rows of the last token; or that token, when it is known to be common
        for b in batches:
            token, salt, node, size = (b[c].to_numpy() for c in ("token", "salt", "node", "size"))
            if waiting is not None:
                token, salt, node, size = (np.concatenate(x) for x in zip(waiting, (token, salt, node, size)))
            if not len(token):
                continue
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            first = new | np.concatenate([[True], node[1:] != node[:-1]])  # copies of a row count once
            first[0] = (token[0], salt[0], node[0]) != last
            starts = np.flatnonzero(new)
            count = np.minimum(np.add.reduceat(np.where(size == 0, COMMON, first), starts), COMMON)
            count[(salt[starts] > 0) | ((token[starts] == token[0]) & (running == (token[0], salt[0])))] = COMMON
            many = np.repeat(count, np.diff(np.append(starts, len(token))))
            out = first & (size > 0) & (many > 1)
            waiting = running = last = None
            if count[-1] < COMMON:
                at = starts[-1] + np.flatnonzero(first[starts[-1] :])
                waiting = (token[at], salt[at], node[at], size[at])
                out[starts[-1] :] = False
            else:
                running, last = (token[-1], salt[-1]), (token[-1], salt[-1], node[-1])
            yield pd.DataFrame({"node": node[out], "size": size[out], "token": token[out], "many": many[out].astype(np.int16)})
        if waiting is not None and len(waiting[0]) > 1:
            yield pd.DataFrame({"node": waiting[2], "size": waiting[3], "token": waiting[0], "many": np.full(len(waiting[0]), len(waiting[0]), np.int16)})

    emitted = in_batches(rows.select("text"), emit, "token long, salt short, node long, size int")
    ordered = emitted.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    shared_tokens = in_batches(ordered, counted, "node long, size int, token long, many short")
    each = shared_tokens.groupBy("node").agg(F.max("size").alias("size"), F.array_sort(F.collect_set(F.struct("many", "token"))).alias("tokens"))
    spare = F.size("tokens") - least_shared(F.col("size"), num)
    keys = each.where(spare >= 0).select("node", F.explode(F.slice("tokens", F.lit(1), (spare + 1).cast("int"))).alias("key"))
    return keys.select("node", "key.token", (F.col("key.many") >= COMMON).alias("common"))


def _ties(keyed: DataFrame) -> DataFrame:
    """Each key's least node with its other nodes; the nodes of a common key by way of the least of some of them."""
    salted = keyed.withColumn("salt", F.when(F.col("common"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0))
    near = salted.select("node", F.min("node").over(Window.partitionBy("token", "salt")).alias("least"))
    some = salted.where("common").groupBy("token", "salt").agg(F.min("node").alias("node"))
    far = some.select("node", F.min("node").over(Window.partitionBy("token")).alias("least"))
    return near.unionByName(far).select(F.col("node").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _held(rows: DataFrame, named: DataFrame, family: DataFrame, keyed: DataFrame, block: int) -> DataFrame:
    """The nodes of families, each with a text that has its set, from the row with the least id and hash of the text: family, chunk, node, text. Of rows with the same id and text, one is taken."""
    member = written(family.select("node", F.col("root").alias("family")).unionByName(family.select(F.col("root").alias("node"), F.col("root").alias("family")).distinct()), "jaccard-members")
    key = F.struct("doc_id", "mark").alias("key")
    where = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(key).alias("key")).join(_chunked(member, keyed, min(block, CHUNK)), "node")
    holder = where.groupBy("key").agg(F.collect_list(F.struct("family", "chunk", "node")).alias("places"))  # of one node: a place in each chunk at most
    known = holder.join(named.groupBy(key).agg(F.count("*").alias("n")), "key")
    texts = matched(rows.select(key, "text"), known, "key", "n", named.count()).where(F.col("of").isNotNull())
    return texts.select(F.explode("of.places").alias("p"), "text").groupBy("p.family", "p.chunk", "p.node").agg(F.first("text").alias("text"))


def _chunked(member: DataFrame, keyed: DataFrame, each: int) -> DataFrame:
    """node, family and chunk. Families of more than `each` nodes are cut into so many chunks, by a hash of the node; their PIVOTS nodes with the most common hashes, such as what all are copies of, are in every chunk."""
    large = member.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > each).withColumn("chunks", F.ceil(F.col("size") / each))
    dealt = matched(member, large, "family", "size", member.count())
    typical = keyed.groupBy("node").agg(F.count_if("common").alias("typical"))
    first = Window.partitionBy("family").orderBy(F.desc("typical"), "node")
    pivots = dealt.where(F.col("of").isNotNull()).join(typical, "node").withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS)
    own = dealt.select("node", "family", F.coalesce(F.pmod(F.xxhash64("node"), F.col("of.chunks")), F.lit(0)).alias("chunk"))
    return own.unionByName(pivots.select("node", "family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of.chunks") - 1)).alias("chunk"))).distinct()


def _in_trees(held: DataFrame, n: int, num: int, block: int) -> DataFrame:
    """Links inside chunks of families, by a tree a block: family, node, component (the least node that links in the block reach) and block."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, nodes, sets, size = None, [], [], 0
        for b in batches:
            out = []
            for of, node, text in zip(zip(b["family"], b["chunk"]), b["node"], b["text"]):
                if nodes and (of != family or len(nodes) >= block or size >= BLOCK_HASHES):
                    out.append(block_of(family[0], nodes, sets))
                    nodes, sets, size = [], [], 0
                s = shingles(text, n)
                if len(s) and node not in nodes[-1:] and set_name(s) == node:
                    family, size = of, size + len(s)
                    nodes.append(node)
                    sets.append(s)
            if out:
                yield pd.concat(out)
        if nodes:
            yield block_of(family[0], nodes, sets)

    def block_of(family: int, nodes: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        name = np.array(nodes, np.int64)
        least = name.copy()
        if len(nodes) > 1:
            tree = Tree(sets)
            tree_links(tree, tree, num, True)
            of = np.empty(len(nodes), np.int64)
            of[tree.order] = tree.component
            _, at = np.unique(of, return_inverse=True)
            lowest = np.full(at.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(lowest, at, name)
            least = lowest[at]
        return pd.DataFrame({"family": family, "node": name, "component": least, "block": name[0]})

    ordered = held.repartition(_tasks(held), "family", "chunk").sortWithinPartitions("family", "chunk", "node")
    return in_batches(ordered, search, "family long, node long, component long, block long")


def _tasks(held: DataFrame, rows_each: int = 2_000) -> int:
    """Tasks for as many rows with text, whose work is in Python and not in bytes read."""
    return max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // rows_each))


def _joined(held: DataFrame, keyed: DataFrame, n: int, num: int, block: int) -> DataFrame:
    """node and root for the nodes of families."""
    first = written(_in_trees(held, n, num, block), "jaccard-blocks")
    several = first.groupBy("family").agg(F.min("block").alias("b"), F.max("block").alias("c")).where("b <> c").select("family")
    wide = written(first.join(several, "family"), "jaccard-wide")
    if wide.isEmpty():
        return first.select("node", F.col("component").alias("root"))
    # blocks of a family are joined up by the nodes that they have in common
    settled = components(wide.select(F.col("node").alias("u"), F.col("component").alias("v")), "jaccard-settled")
    placed = written(wide.select("family", "node").distinct().join(settled, "node", "left").select("family", "node", F.coalesce("root", "node").alias("component")), "jaccard-placed")
    # who shares a key with a node of another component
    keys = keyed.join(placed, "node")
    mixed_keys = keys.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    open_nodes = written(keys.join(mixed_keys, "token", "left_semi").select("family", "node", "component").distinct(), "jaccard-open")
    if not open_nodes.isEmpty():
        found = _between_blocks(open_nodes, held, n, num, block)
        of = placed.select(F.col("node").alias("v"), F.col("component").alias("b"))
        edges = found.join(placed.select(F.col("node").alias("u"), F.col("component").alias("a")), "u").join(of, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        up = components(edges, "jaccard-joined").select(F.col("node").alias("component"), "root")
        placed = placed.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    narrow = first.join(several, "family", "left_anti").select("node", F.col("component").alias("root"))
    return narrow.unionByName(placed.select("node", F.col("component").alias("root")))


def _between_blocks(nodes: DataFrame, held: DataFrame, n: int, num: int, block: int) -> DataFrame:
    """Links between different components of a family, by trees over blocks of nodes of like size, for each two blocks with fitting sizes.

    A component of more than `block` nodes of a size class has blocks of its own, which don't meet each other; the others share blocks.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(node, len(s), s.tobytes()) for node, s in zip(b["node"], (shingles(t, n) for t in b["text"])) if len(s) and set_name(s) == node]
            yield pd.DataFrame(found, columns=["node", "size", "tokens"])

    texts = held.join(nodes.select("node"), "node", "left_semi").select("node", "text")
    sets = written(in_batches(texts, read, "node long, size long, tokens binary").dropDuplicates(["node"]).join(nodes, "node"), "jaccard-sets")
    rank = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / num)) + 1e-9)  # linked sets differ by one at most
    placed = sets.select("node", "size", "family", "component", rank.alias("rank"))
    here = placed.groupBy("family", "rank", "component").agg(F.count("*").alias("here"), F.sum("size").alias("weight"))
    parts = F.greatest(F.ceil(F.col("here") / block), F.ceil(F.col("weight") / BLOCK_HASHES))
    own = here.withColumn("own", parts > 1).withColumn("parts", parts)
    rest = own.where("not own").groupBy("family", "rank").agg(F.greatest(F.ceil(F.sum("here") / block), F.ceil(F.sum("weight") / BLOCK_HASHES)).alias("rest"))
    plan = own.join(rest, ["family", "rank"], "left")
    number = F.when(F.col("own"), F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("node"), F.greatest(F.col("rest"), F.lit(1))))
    dealt = placed.join(plan, ["family", "rank", "component"]).select("node", "family", "rank", "component", "size", F.when(F.col("own"), F.col("component")).alias("of"), number.alias("number"))
    dealt = written(dealt.withColumn("block", F.xxhash64("family", "rank", "of", "number")), "jaccard-dealt")
    blocks = dealt.groupBy("family", "rank", "of", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    a, b = (blocks.select("family", *(F.col(c).alias(f"{c}_{side}") for c in ("rank", "of", "lo", "hi", "block"))) for side in "ab")
    fits = (F.col("lo_a") * num <= F.col("hi_b") * 100) & (F.col("lo_b") * num <= F.col("hi_a") * 100)
    meet = a.join(b, "family").where((F.abs(F.col("rank_a") - F.col("rank_b")) <= 1) & (F.col("block_a") <= F.col("block_b")) & ~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)) & fits)
    meet = meet.select("block_a", "block_b", F.xxhash64("block_a", "block_b").alias("pair"))
    full = dealt.select("node", "block").join(sets.select("node", "component", "tokens"), "node")
    left = full.join(meet, F.col("block") == F.col("block_a")).select("pair", "node", "component", "tokens", (F.col("block_a") == F.col("block_b")).alias("same"))
    right = full.join(meet.where("block_a <> block_b").select("pair", "block_b"), F.col("block") == F.col("block_b")).select(F.col("pair").alias("of_pair"), F.col("node").alias("node_b"), F.col("component").alias("component_b"), F.col("tokens").alias("tokens_b"))

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(x):
            y = y.rename(columns={"node_b": "node", "component_b": "component", "tokens_b": "tokens"})
            same = bool(x["same"].iloc[0])
            a, b = (Tree([np.frombuffer(s, np.uint64) for s in p["tokens"]], p["component"].to_numpy()) if len(p) else None for p in (x, x if same else y))
            if same:
                b = a
            if a and b:
                name_a, name_b = x["node"].to_numpy()[a.order], (x if same else y)["node"].to_numpy()[b.order]
                found = [(int(name_a[p]), int(name_b[q])) for p, q in tree_links(a, b, num, same)]
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    ship(sets.sparkSession)
    return written(left.groupBy("pair").cogroup(right.groupBy("of_pair")).applyInPandas(search, "u long, v long"), "jaccard-tree-links")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less all but the first document of each component."""
    (key,) = unused(docs, "_key")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
