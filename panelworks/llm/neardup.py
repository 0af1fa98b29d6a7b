"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts become sets of word shingles and signatures of K coordinates. Documents are posted
under each (coordinate, value); two documents are compared if they collide in at least T
coordinates, and are linked if their full sets are similar enough. Three things keep the
join small, and lose no pair with T collisions:

* screen: such a pair collides in at least one of the first K - T + 1 coordinates;
* prefix: with a document's postings ordered from rare to frequent, it collides in the
  first K - T + 1 of both; postings that occur once need no partner;
* skip: documents that share no prefix posting, directly or through others, are never
  compared, and within a block of comparisons only links that join two parts are returned.

Equal sets are one node from the start, so groups of copies cost one comparison.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelworks.llm.common import SMALL_SLICE, Words, materialise, multipliers, ship_package, slices, window_hashes

#: Coordinates of a signature, and collisions from which a pair is compared. A pair at
#: similarity 0.75 has 48 on average with standard deviation 3.5: fewer than 30 has one in
#: about two million such pairs, and ever fewer above 0.75.
K, T = 64, 30

#: A comparison block holds at most about so many nodes and so many bytes of sets.
BLOCK_NODES, BLOCK_BYTES = 1024, 24 << 20


def shingle_sets(text: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For every text the ordered 64-bit hashes of its distinct shingles.

    Words are runs of other characters than space and \\x09-\\x0D, A-Z lower-cased. A text of
    fewer words than ``width`` has its whole sequence as one shingle; without words: none.
    """
    words = Words(text, lower=True)
    h, counts = words.hashes(), words.counts
    w = window_hashes(h, width)
    odd = multipliers(width + 1)
    ends = np.cumsum(counts)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        start = end - n
        if n >= width:
            out.append(np.unique(w[start : end - width + 1]))
        elif n:
            out.append(window_hashes(h[start:end], n) ^ odd[n])
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], k: int = K) -> np.ndarray:
    """Minimum of k hash functions over each set (rows; zeros for an empty set)."""
    out = np.zeros((len(sets), k), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    sizes = np.array([len(sets[i]) for i in full])
    starts = np.cumsum(sizes) - sizes
    odd = multipliers(2 * k + 128)[128:]
    for j in range(k):
        v = (flat ^ odd[2 * j]) * odd[2 * j + 1]
        v ^= v >> np.uint64(32)
        v *= odd[2 * j]
        out[full, j] = np.minimum.reduceat(v, starts)
    return out


def _describe(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key_, n, node, sig) of every document; node is a 128-bit digest of its set, null if empty."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for piece, texts in slices(batches, "text_", SMALL_SLICE):
            sets = shingle_sets(texts, width)
            sig = signatures(sets).view(np.int64)
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * K, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), lists], ["key_", "n", "node", "sig"])

    rows = docs.selectExpr(f"`{key}` AS key_", f"CAST(`{text}` AS STRING) AS text_")
    return rows.mapInArrow(run, f"key_ {kind}, n long, node binary, sig array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): equal roots for connected nodes.

    Repeated edges and loops change nothing, edges with a null end are left out, and without
    edges the result is empty.

    Every node is renamed to the least of itself and its neighbours and the edges are
    renamed with it, until none is left; nodes are random digests, so each round leaves a
    fraction of them. The renamings are then applied one after another.
    """
    edges = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    renamed: DataFrame | None = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        least = materialise(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")), "least")
        if renamed is None:
            renamed = least
        else:
            step = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
            renamed = renamed.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        a, b = (least.select(F.col("node").alias(c), F.col("root").alias(f"{c}_to")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = materialise(moved.where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return materialise(renamed, "roots")


def screen(described: DataFrame) -> DataFrame:
    """(node, sig) of the nodes that collide with another one in the first K - T + 1 coordinates.

    Here a node goes by a 64-bit hash of its digest; if two share it, both stay. Copies need
    no separate pass: a value is shared if the least and the largest hash under it differ.
    """
    own = F.xxhash64("node").alias("h")
    first = described.select(own, F.posexplode(F.slice("sig", 1, K - T + 1)).alias("at", "value")).select("h", F.xxhash64("at", "value").alias("token"))
    shared = first.groupBy("token").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("token")
    found = first.join(shared, "token", "left_semi").select("h").distinct()
    # What has been found grows with the corpus: a shuffled join at every size, not a broadcast.
    kept = described.select("node", "sig", own).join(found.hint("merge"), "h", "left_semi")
    return materialise(kept.groupBy("node").agg(F.first("sig").alias("sig")), "screened")


def prefix_postings(screened: DataFrame) -> DataFrame:
    """(node, token) of the postings that a pair with T collisions must share one of."""
    every = screened.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    # At most K postings of a node meet in each window.
    own = W.partitionBy("node")
    ranked = every.join(often, "token").select("node", "token", F.count("*").over(own).alias("m"), F.row_number().over(own.orderBy("c", "token")).alias("r"))
    return ranked.where(f"r <= m - {T} + 1").select("node", "token")


def _intersections(a: list[np.ndarray], b: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a[i] and b[j]."""
    if len(pairs[0]) <= 20 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(*map(np.ndarray.tolist, pairs))], np.int64)
    # Many pairs: all at once. Shingles of few nodes are counted pair by pair, the others by products.
    flat = np.concatenate([*a, *b])
    _, code = np.unique(flat, return_inverse=True)
    side = sum(map(len, a))
    owner_a, owner_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    n = int(code.max()) + 1
    ca, cb = np.bincount(code[:side], minlength=n), np.bincount(code[side:], minlength=n)
    total = np.zeros((len(a), len(b)), np.float32)
    dense = np.flatnonzero(ca * cb >= 2048)
    slot = np.full(n, -1, np.int64)
    slot[dense] = np.arange(len(dense))
    for low in range(0, len(dense), 2048):
        size = min(2048, len(dense) - low)
        parts = []
        for codes, owner, m in ((code[:side], owner_a, len(a)), (code[side:], owner_b, len(b))):
            s = slot[codes] - low
            here = np.flatnonzero((s >= 0) & (s < size))
            one = np.zeros((m, size), np.float32)
            one[owner[here], s[here]] = 1
            parts.append(one)
        total += parts[0] @ parts[1].T
    rare = (ca > 0) & (cb > 0) & (slot < 0)
    if rare.any():
        order_b = np.argsort(code[side:], kind="stable")
        first_b = np.cumsum(cb) - cb
        at = np.flatnonzero(rare[code[:side]])
        c = code[:side][at]
        repeat = cb[c]
        ends = np.cumsum(repeat)
        index = np.repeat(first_b[c] - (ends - repeat), repeat) + np.arange(ends[-1])
        key = np.repeat(owner_a[at], repeat) * len(b) + owner_b[order_b[index]]
        total += np.bincount(key, minlength=len(a) * len(b)).reshape(total.shape)
    return total[pairs].astype(np.int64)


def compare_block(node_a, sig_a, set_a, node_b=None, sig_b=None, set_b=None, *, percent: int = 75) -> list[tuple]:
    """Links between two lists of nodes (or within one), as many as it takes to join what is connected.

    Collisions are counted coordinate by coordinate; pairs with T of them or more are
    confirmed on the full sets (100 * intersection >= percent * union).
    """
    alone = node_b is None
    if alone:
        node_b, sig_b, set_b = node_a, sig_a, set_a
    count = np.zeros((len(node_a), len(node_b)), np.int8)
    for j in range(sig_a.shape[1]):
        count += sig_a[:, j, None] == sig_b[None, :, j]
    near = count >= T
    if alone:
        near &= np.tri(len(node_a), k=-1, dtype=np.bool_)
    i, j = np.nonzero(near)
    if not len(i):
        return []
    size_a, size_b = np.array([len(x) for x in set_a]), np.array([len(x) for x in set_b])
    small = np.minimum(size_a[i], size_b[j]) * 100 >= percent * np.maximum(size_a[i], size_b[j])
    i, j = i[small], j[small]
    if not len(i):
        return []
    shared = _intersections(set_a, set_b, (i, j))
    linked = 100 * shared >= percent * (size_a[i] + size_b[j] - shared)
    i, j = i[linked], j[linked]
    table = np.zeros((len(node_a), len(node_b)), np.bool_)
    table[i, j] = True
    if alone:
        table |= table.T
    out, seen_a, seen_b = [], np.zeros(len(node_a), np.bool_), np.zeros(len(node_b), np.bool_)
    for start in np.unique(i).tolist():
        if seen_a[start]:
            continue
        seen_a[start] = True
        todo = [(0, start)]
        while todo:
            side, x = todo.pop()
            if alone:
                found = np.flatnonzero(table[x] & ~seen_a)
                seen_a[found] = True
                out += [(node_a[x], node_a[y]) for y in found]
                todo += [(0, y) for y in found.tolist()]
            elif side == 0:
                found = np.flatnonzero(table[x] & ~seen_b)
                seen_b[found] = True
                out += [(node_a[x], node_b[y]) for y in found]
                todo += [(1, y) for y in found.tolist()]
            else:
                found = np.flatnonzero(table[:, x] & ~seen_a)
                seen_a[found] = True
                out += [(node_a[y], node_b[x]) for y in found]
                todo += [(0, y) for y in found.tolist()]
    return out


def _links(docs: DataFrame, nodes: DataFrame, canopies: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that join all connected nodes of each canopy."""
    wanted = nodes.join(canopies, "node").select("rep", "node", "root", "n")
    sizes = wanted.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("s") * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    members = materialise(wanted.join(sizes.select("root", blocks.alias("blocks")), "root"), "members")

    def run(batches):
        for piece, texts in slices(batches, "text_", SMALL_SLICE):
            sets = shingle_sets(texts, width)
            node = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            sig = pa.array([s.tobytes() for s in signatures(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([node, sig, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "sig", "items"])

    rows = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("text_"))
    rows = rows.join(members.select("rep").distinct(), "rep", "left_semi").select("text_")
    sets = rows.mapInArrow(run, "node binary, sig binary, items binary")
    # Of rows that share a key and a set, one is taken; a key's other sets find no member.
    placed = members.select("node", "root", "blocks").hint("merge").join(sets, "node")
    mine = F.pmod(F.hash("node"), F.col("blocks"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("mine", mine).withColumn("other", others)
    placed = placed.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "sig", "items")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        seen, rows = set(), []
        for mine, node, sig, items in zip(*(table.column(c).to_pylist() for c in ("mine", "node", "sig", "items"))):
            if node not in seen:
                seen.add(node)
                rows.append((mine, node, np.frombuffer(sig, np.uint64), np.frombuffer(items, np.uint64)))
        rows.sort(key=lambda r: r[1])
        sides = [[r for r in rows if r[0] == s] for s in ((i,) if i == j else (i, j))]
        if any(not s for s in sides):
            found = []
        else:
            found = compare_block(*[x for s in sides for x in ([r[1] for r in s], np.stack([r[2] for r in s]), [r[3] for r in s])], percent=percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    return placed.groupBy("root", "i", "j").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document.

    ``component_id`` is the least key of all documents reachable by links, itself included;
    ``kept`` says that it is the document's own. Documents without words are linked with
    nothing. Rows with a null key join no component: component_id is null and they are kept.
    Rows that repeat a key are one document to ``kept``. Other columns are ignored; an empty
    table gives an empty result.
    """
    ship_package(docs.sparkSession)
    described = materialise(_describe(docs, key, text, width), "signatures")
    usable = described.where("node IS NOT NULL AND key_ IS NOT NULL")
    nodes = materialise(usable.groupBy("node").agg(F.min("key_").alias("rep"), F.first("n").alias("n")), "nodes")
    postings = materialise(prefix_postings(screen(usable)), "postings")
    hubs = postings.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1")
    canopies = components(postings.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = _links(docs, nodes, canopies, key, text, width, percent)
    # Rows that share a key belong together whatever their sets.
    same = usable.select("node", "key_").distinct().groupBy("key_").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    roots = components(links.union(_same_key(usable, same)))
    least = nodes.join(roots, "node").groupBy("root").agg(F.min("rep").alias("component"))
    joined = roots.join(least, "root").select("node", "component")
    by_node = materialise(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "rep").alias("component")), "classes")
    alone = described.where("node IS NULL OR key_ IS NULL").select("key_", "n", F.col("key_").alias("component"))
    rows = described.where("node IS NOT NULL AND key_ IS NOT NULL").select("key_", "n", "node").join(by_node, "node").select("key_", "n", "component").union(alone)
    component = F.col("component")
    return rows.select(F.col("key_").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key_") == component, F.lit(True)).alias("kept"))


def _same_key(usable: DataFrame, same: DataFrame) -> DataFrame:
    """Links from every set of a key to the key's least one."""
    return usable.join(same.select("key_", "a"), "key_").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that are linked, directly or not, with one of a lesser key.

    Null and empty texts and null keys are linked with nothing and stay; rows that repeat a key
    are one document and stay or go together; all columns stay, whatever their names; an empty
    table gives an empty result.
    """
    key = options.get("key", "doc_id")
    gone = near_duplicates(docs, **options).where("NOT kept").select(key)
    return docs.join(gone, key, "left_anti").select(docs.columns)
