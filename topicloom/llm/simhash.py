"""SimHash fingerprints, linked through BK-trees.

A fingerprint has a bit for each majority among the XXH64 hashes of a text's word
shingles.  Distinct fingerprints, each once, are dealt to shards: the 64 bits are cut into
``radius + 2`` blocks, and a fingerprint goes to a shard for every pair of blocks and
their values.  Two fingerprints that differ in at most ``radius`` bits agree in two blocks
at least, so each link lies in some shard.  In a shard the fingerprints form a BK-tree,
whose children are keyed by their Hamming distance to the parent; a search follows only
edges within the radius of its own distance.  Trees of a partition are built and searched
together in arrays.

A shard reports a star for each group that it links, not the pairs; stars are contracted
to components by rounds of joins, in tables in the shared folder.  Copies of a text share
one fingerprint and are never paired.  The trees are not broadcast, since together they
grow with the corpus: fingerprints travel to the trees instead, ten small rows each.

``without_near_duplicates`` finds groups in the same way: fingerprints, BK-trees, stars.
What the trees link is checked by the Jaccard similarity t of the sets of distinct shingles,
and so is what they cannot reach, since texts of that similarity may differ in more bits
than the radius: whatever is not in one component by then goes on, so that every similar
pair is found.  Texts of equal sets are copies.  In any one order of all shingles, two sets of similarity t share one of the first n - ceil(t n) + 1 of
their n members; those are the keys of a text.  The order puts frequent shingles last, by
counters of all documents (``CELLS``, whatever the size of the table): a line or passage that
many documents share is a key only where it is most of the text.  The counters shape the
order alone, so that collisions cost time and lose nothing.  Where a key stands in its
set bounds how much can follow it, which drops most of the remaining pairs unseen.  A pair is
a link only if its two sets, read and compared whole, have that similarity.  Buckets are
contracted through leaders first, those that have the key earliest; what stays open in them
is compared block by block.

Texts without words (null, empty) have fingerprint zero and are linked like any other.
Fewer words than a shingle make one shingle of all of them.  Every row gets a result;
null ids are never the smallest id, and a component without any id has a null one.  Extra
columns are ignored by ``near_duplicates`` and kept by ``without_near_duplicates``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import bounds, chunks, mixed, released, with_uid, written
from topicloom.llm.contract import components, hooked
from topicloom.session import ship_package

RADIUS = 3
SEED = 42
SIMILARITY = 0.8
#: Counters of shingles, by the top bits of their hashes; in chunks for the shuffle.
CELL_BITS, CHUNK_BITS = 20, 16
#: Bits of the map of nodes whose sets are wanted.
MAP_BITS = 24
#: Cells of the profile of a set, a byte each.
PROFILE = 256
CELLS = 2**CELL_BITS
#: A key may be a hot one if its counter has this part of all shingles, and so many at least.
HOT_SHARE, HOT_LEAST = 10_000, 1024
#: Rows of a bucket that meet at once, and open pairs a node that are compared without leaders.
BLOCK, PAIRS_EACH = 256, 8
#: Fingerprints that one search works on at once, and pairs of search and node.
BLOCK_ROWS, BLOCK_PAIRS = 100_000, 2_000_000
_BIT_ROWS = 2**17

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words, joined by spaces, A-Z in lower case."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hashed(joined, SEED)]
    ends = (bounds([len(w) + 1 for w in words])).tolist()
    return [hashed(joined[a : b - 1], SEED) for a, b in zip(ends, ends[size:])]


def _majorities(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes between two ``edges``."""
    ones = np.zeros((len(edges) - 1, 64), np.int64)
    for a in range(0, len(flat), _BIT_ROWS):
        block = flat[a : a + _BIT_ROWS].astype("<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.clip(edges - a, 0, len(block))
        docs = np.flatnonzero(np.diff(inside) > 0)
        ones[docs] += np.add.reduceat(bits, inside[docs], axis=0, dtype=np.int64)
    majority = (2 * ones > np.diff(edges)[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints_of(texts: list[bytes], size: int, words: int = 1) -> np.ndarray:
    """``words`` unsigned 64-bit fingerprints a text, of shape (texts, words).

    The first is that of the shingles' XXH64, the others those of hashes mixed from it.
    """
    hashes = [shingle_hashes(t, size) for t in texts]
    edges = bounds([len(h) for h in hashes])
    flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(edges[-1]))
    made = [_majorities(flat, edges)]
    for n in range(1, words):
        made.append(_majorities(mixed(mixed(flat + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))), edges))
    return np.stack(made, axis=1)


def _fingerprint(size: int):
    @released
    def fingerprint(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                found = fingerprints_of(texts, size)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "fp"])

    return fingerprint


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint(shingle), f"id {kind}, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


#: More than any distance, so that node * _FAR + distance is a key.
_FAR = 1024


class Forest:
    """BK-trees of several shards: ``shard`` is sorted, values (of shape (n, words)) within
    a shard are distinct."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        self.root = np.searchsorted(shard, shard)
        nodes, group = np.arange(len(values)), self.root.copy()
        parent, edge = np.full(len(values), -1), np.zeros(len(values), np.int64)
        while len(nodes):  # every group makes its first member a node, others go to its children
            head = np.concatenate([[True], group[1:] != group[:-1]])
            top = np.repeat(nodes[head], np.diff(np.append(np.flatnonzero(head), len(nodes))))
            nodes, top = nodes[~head], top[~head]
            distance = _distance(values[nodes], values[top])
            parent[nodes], edge[nodes] = top, distance
            group = top * _FAR + distance
            order = np.argsort(group, kind="stable")
            nodes, group = nodes[order], group[order]
        # A node's parent is the last one it was compared with.
        key = parent * _FAR + edge
        child = np.flatnonzero(parent >= 0)
        order = np.argsort(key[child], kind="stable")
        self.children, self.keys = child[order], key[child][order]

    def links(self, radius: int):
        """Pairs (searching, found) of positions within ``radius``, each once, in blocks."""
        for a in range(0, len(self.values), BLOCK_ROWS):
            search = np.arange(a, min(a + BLOCK_ROWS, len(self.values)))
            waiting = [(search, self.root[search])]
            while waiting:
                search, node = waiting.pop()
                if len(search) > BLOCK_PAIRS:
                    half = len(search) // 2
                    waiting += [(search[:half], node[:half]), (search[half:], node[half:])]
                    continue
                distance = _distance(self.values[search], self.values[node])
                near = (distance <= radius) & (node < search)
                if near.any():
                    yield search[near], node[near]
                low = np.searchsorted(self.keys, node * _FAR + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.keys, node * _FAR + distance + radius, "right")
                many = high - low
                if many.sum():
                    at = np.repeat(low - bounds(many)[:-1], many) + np.arange(many.sum())
                    waiting.append((np.repeat(search, many), self.children[at]))


def _smallest_linked(values: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """For each position the first position that links reach in its shard."""
    label = np.arange(len(values))
    for a, b in Forest(values, shard).links(radius):
        label = hooked(label, a, b)
    return label


def _search_shards(radius: int):
    """Stars (node, other) of the linked fingerprints in each shard; input (shard, node,
    fp) is sorted by shard; links are named by ``node``."""

    def solve(shard, nodes, values):
        label = _smallest_linked(values, shard, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[linked]), pa.array(nodes[label[linked]])], ["a", "b"]
        )

    def arrays(batch):
        shard, nodes, fp = (batch.column(i) for i in range(3))
        return shard.to_numpy(), nodes.to_numpy(), fp.to_numpy().view(np.uint64).reshape(-1, 1)

    @released
    def search(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(arrays(batch))
            size += batch.num_rows
            if size < BLOCK_ROWS:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last shard may go on
            if last:
                yield solve(*(c[:last] for c in columns))
            held, size = [[c[last:] for c in columns]], size - last
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return search


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges whose components are those of all links between the distinct ``fp``."""
    count = radius + 2
    edges = [round(64 * i / count) for i in range(count + 1)]
    blocks = [
        F.shiftrightunsigned("fp", a).bitwiseAND(2 ** (b - a) - 1) for a, b in zip(edges, edges[1:])
    ]
    # The number of the pair of blocks above the two values, of 13 bits each for radius 3.
    width = max(b - a for a, b in zip(edges, edges[1:]))
    keys = [
        F.lit(n << 2 * width).bitwiseOR(F.shiftleft(blocks[i], width)).bitwiseOR(blocks[j])
        for n, (i, j) in enumerate(combinations(range(count), 2))
    ]
    dealt = distinct.select(F.explode(F.array(*keys)).alias("shard"), F.col("fp").alias("node"), "fp")
    sharded = dealt.repartition("shard").sortWithinPartitions("shard", "fp")
    return sharded.mapInArrow(_search_shards(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
    radius: int = RADIUS,
) -> DataFrame:
    """Per document: id, fp (signed long) and component_id, the smallest id that links reach."""
    found = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return found.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _signed(size: int):
    """(uid, n, same): size and digest of the shingle set; and, without uid, the task's
    counters (chunk, counts), two bytes each: larger counts stop there, which leaves them last."""

    @released
    def sign(batches):
        counts, seen = np.zeros(CELLS, np.int64), False
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = [shingle_set(t, size) for t in texts]
                counts += np.bincount(_cells(np.concatenate(sets)), minlength=CELLS)
                seen = True
                none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *none,
                    ],
                    ["uid", "n", "same", "chunk", "counts"],
                )
        if seen:
            told = np.minimum(counts, 2**16 - 1).astype("<u2").reshape(-1, 2**CHUNK_BITS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(told), pa.int64()), pa.nulls(len(told), pa.int32()),
                    pa.nulls(len(told), pa.binary()), pa.array(np.arange(len(told), dtype=np.int32)),
                    pa.array([t.tobytes() for t in told], pa.binary()),
                ],
                ["uid", "n", "same", "chunk", "counts"],
            )

    return sign


@released
def _added(batches):
    """The sums of the counters of each chunk; a task holds the sums alone."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            total = totals.setdefault(chunk, np.zeros(2**CHUNK_BITS, np.int64))
            total += np.frombuffer(counts, "<u2")
    told = [np.minimum(t, 2**32 - 1).astype("<u4").tobytes() for t in totals.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(totals.keys(), pa.int32()), pa.array(told, pa.binary())], ["chunk", "counts"]
    )


def _counters(signed: DataFrame) -> np.ndarray:
    """All counters: four megabytes, whatever the input."""
    told = signed.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    counts = np.zeros((CELLS >> CHUNK_BITS, 2**CHUNK_BITS), np.uint32)
    for row in told.mapInArrow(_added, "chunk int, counts binary").toArrow().to_pylist():
        counts[row["chunk"]] = np.frombuffer(row["counts"], "<u4")
    return counts.ravel()


def prefix_keys(members: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first members of a set, rare ones first, one of which any similar set shares."""
    size = len(members) - int(np.ceil(similarity * len(members) - 1e-9)) + 1
    order = np.lexsort((members, counts[_cells(members)]))
    return members[order[:size]]


def profile(members: np.ndarray) -> bytes:
    """How many members fall into each of ``PROFILE`` cells, 255 standing for more: what two
    sets have in common is at most the sum of the smaller counts."""
    cells = (members % np.uint64(PROFILE)).astype(np.int64)
    return np.minimum(np.bincount(cells, minlength=PROFILE), 255).astype(np.uint8).tobytes()


def _alike(similarity: float):
    """The pairs (a, b) of sizes n_a, n_b that their profiles x and y allow to be similar."""

    @released
    def alike(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x, y = (
                    np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE)
                    for c in ("x", "y")
                )
                n_a, n_b = (part.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
                most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                full = ((x == 255) & (y == 255)).any(axis=1)  # these counts are not known
                near = full | (most >= similarity * (n_a + n_b - most) - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(near))

    return alike


def _keyed(size: int, similarity: float, counters, hot_from: int):
    """(node, fp, n, profile, keys): fingerprint and keys of each text with words, and whether
    the counters of its keys exceed ``hot_from``; one that no other has is left out, as a
    null, where its counter tells so."""

    @released
    def key(batches):
        counts = counters.value
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                hashes = [np.array(shingle_hashes(t, size), np.uint64) for t in texts]
                kept = np.array([len(h) > 0 for h in hashes], bool)
                fps = _majorities(np.concatenate(hashes), bounds([len(h) for h in hashes]))
                sets = [np.unique(h) for h in hashes]
                found = [prefix_keys(s, counts, similarity) for s in sets if len(s)]
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                common = counts[_cells(flat)]
                rows = pa.StructArray.from_arrays(
                    [pa.array(flat.view(np.int64), mask=common <= 1), pa.array(common > hot_from)], ["key", "hot"]
                )
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds([len(f) for f in found]).astype(np.int32)), rows
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).filter(pa.array(kept)), pa.array(fps[kept].view(np.int64)),
                        pa.array([len(s) for s in sets if len(s)], pa.int32()),
                        pa.array([profile(s) for s in sets if len(s)], pa.binary()), lists,
                    ],
                    ["node", "fp", "n", "profile", "keys"],
                )

    return key


def _shingled(size: int):
    """(node, shingles): the sorted set, eight bytes a member."""

    @released
    def shingle(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = [shingle_set(t, size).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["node", "shingles"]
                )

    return shingle


def _marked(batches):
    """The bits of nodes, as positions within chunks of the bitmap."""
    for batch in batches:
        bits = _bits(batch.column("node").to_numpy())
        chunk = bits >> CHUNK_BITS
        order = np.argsort(chunk, kind="stable")
        bits, chunk = bits[order], chunk[order]
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        rows = [(bits[a:b] & (2**CHUNK_BITS - 1)).astype("<u2").tobytes() for a, b in zip(cuts, [*cuts[1:], len(bits)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk[cuts].astype(np.int32)), pa.array(rows, pa.binary())], ["chunk", "bits"]
        )


def _mapped(batches):
    """The chunks of the bitmap; a task holds its chunks alone."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, bits in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
            held.setdefault(chunk, np.zeros(2**CHUNK_BITS, bool))[np.frombuffer(bits, "<u2")] = True
    packed = [np.packbits(bits).tobytes() for bits in held.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(held.keys(), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bits"]
    )


def _bits(nodes: np.ndarray) -> np.ndarray:
    return (mixed(nodes.astype(np.int64).view(np.uint64)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each hash of ``nodes`` (node): two megabytes, whatever their number."""
    told = nodes.mapInArrow(_marked, "chunk int, bits binary").repartition("chunk")
    bits = np.zeros((2**MAP_BITS >> CHUNK_BITS, 2**CHUNK_BITS // 8), np.uint8)
    for row in told.mapInArrow(_mapped, "chunk int, bits binary").toArrow().to_pylist():
        bits[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def sets_of(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the ``texts`` (uid, text) of ``nodes``, and of few others.

    The texts are read where they lie and never shuffled; the bitmap, of a fixed size, says
    which to work on.  Where it is crowded more sets travel, which changes no result.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(nodes))
    shingled = _shingled(size)

    def chosen(batches):
        for batch in batches:
            bits = _bits(batch.column("uid").to_numpy())
            wanted = (sent.value[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(wanted == 1))

    return texts.mapInArrow(lambda batches: shingled(chosen(batches)), "node long, shingles binary")


def _confirm(similarity: float):
    """The pairs (a, b) whose sets x and y have this Jaccard similarity at least."""

    @released
    def confirm(batches):
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = both / (len(x) + len(y) - both) >= similarity
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose ``sets`` (node, shingles) are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(
        _confirm(similarity), "a long, b long"
    )


def _may_be_similar(n_a, pos_a, n_b, pos_b, similarity: float):
    """Whether two sets of these sizes can be similar if the first key that they share stands
    at these positions: what may follow it bounds what they have in common."""
    needed = F.ceil((n_a + n_b) * (similarity / (1 + similarity)) - 1e-9)
    sizes = F.least(n_a, n_b) >= similarity * F.greatest(n_a, n_b) - 1e-9
    return sizes & (F.least(n_a - pos_a, n_b - pos_b) >= needed)


def _shared_keys(dealt: DataFrame, similarity: float) -> DataFrame:
    """Rows (key, node, n, pos) of keys that several nodes have, but for rows that can have no
    similar one in their bucket: for the size of a partner there is an upper bound.

    Most keys are a single node's.  They and those of few nodes take one shuffle; ``hot``
    keys, which may have any share of all nodes, are counted in parts and joined.
    """
    partner = (F.col("n") - F.col("pos")) * ((1 + similarity) / similarity) - F.col("n") + 1e-6

    def counted(rows):
        kept = rows.groupBy("key").agg(F.count("*").alias("count"), F.min("n").alias("least"))
        kept = kept.where("count > 1").select("key", "least")
        return rows.join(kept, "key").where(partner >= F.col("least")).select("key", "node", "n", "pos")

    own = Window.partitionBy("key")
    few = dealt.where("NOT hot").select(
        "key", "node", "n", "pos", F.count("*").over(own).alias("count"), F.min("n").over(own).alias("least")
    )
    few = few.where((F.col("count") > 1) & (partner >= F.col("least"))).select("key", "node", "n", "pos")
    met = written(few.unionByName(counted(dealt.where("hot"))), "met")
    return written(counted(met), "buckets")


def fingerprint_pairs(keyed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): stars of the nodes (node, fp) that have one fingerprint, and between the first
    nodes of fingerprints that the BK-trees link."""
    prints = keyed.select("node", "fp")
    heads = written(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = prints.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("fp"), radius).distinct()
    for end in ("a", "b"):
        named = heads.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}"))
        near = near.join(named, end).drop(end)
    return same.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))


def checked(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of similar nodes; profiles rule out most others unseen."""
    pairs = written(_profiled(pairs.select("a", "b").distinct(), profiles, similarity), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return written(confirmed(pairs, sets_of(texts, ends, shingle), similarity), "links")


def similar_groups(
    buckets: DataFrame, profiles: DataFrame, texts: DataFrame, shingle: int, similarity: float, found: DataFrame
) -> DataFrame:
    """(node, root): components of the links ``found`` (a, b) and of the confirmed pairs within
    ``buckets`` (key, node, n, pos).

    A round confirms one pair for each node, with a leader of one of its buckets, so that
    groups of near copies become components at linear cost.  What is then left open, pairs
    of different components in a bucket, is compared whole.
    """
    roots, before, turn = written(components(found), "roots"), None, 0
    most = PAIRS_EACH * buckets.select("node").distinct().count()
    while True:
        named = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = written(named.select("key", "node", "n", "pos", "root"), "named")
        members = named.groupBy("key", "root").agg(F.count("*").alias("m"))
        sizes = members.groupBy("key").agg(
            F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("within"),
            F.max("m").alias("largest"), F.max_by("root", F.struct("m", "root")).alias("main"),
        )
        sizes = written(sizes.where("largest < size"), "sizes")
        left = sizes.agg(F.sum((F.col("size") * F.col("size") - F.col("within")) / 2)).first()[0] or 0
        last = turn > 0 and (left <= most or left > 0.9 * before)
        pairs = _open_pairs(named, sizes, similarity) if last else _leader_pairs(named, sizes, turn, similarity)
        linked = checked(pairs, profiles, texts, shingle, similarity)
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(stars.unionByName(linked)), "roots")
        if last:
            return roots
        before, turn = left, turn + 1


def _profiled(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) that the ``profiles`` (node, n, profile) do not rule out."""
    x = profiles.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("profile").alias("x"))
    y = profiles.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("profile").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(
        _alike(similarity), "a long, b long"
    )


def _leader_pairs(named: DataFrame, sizes: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b): each node with one leader of another component, if it meets any.

    At first the leader of a bucket is the node that has the key earliest, which has the
    least of its own; later the smallest, in another order each turn.
    """
    mask = F.lit(int(np.random.default_rng(turn).integers(2**62)) if turn else 0)
    first = F.lit(0) if turn else F.col("pos")
    ranked = named.join(sizes.select("key"), "key").withColumn(
        "rank", F.struct(first.alias("first"), F.col("node").bitwiseXOR(mask).alias("mixed"), "node", "n", "pos", "root")
    )
    leaders = ranked.groupBy("key").agg(F.min("rank").alias("leader"))
    x = F.col("leader")
    met = ranked.join(leaders, "key").where(
        (F.col("root") != x["root"]) & _may_be_similar(F.col("n"), F.col("pos"), x["n"], x["pos"], similarity)
    )
    return met.groupBy(F.col("node").alias("a")).agg(F.min("leader").alias("leader")).select(
        "a", F.col("leader.node").alias("b")
    )


def _open_pairs(named: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different components that share a bucket and may be similar.

    One of a pair is outside the largest component of its bucket.  Those outside meet the
    whole bucket block by block, so that no task holds a large bucket.
    """
    def blocks(count):
        return F.ceil(F.col(count) / BLOCK).cast("int")

    def block_of(count):
        return F.pmod(F.xxhash64("node"), blocks(count)).cast("int")

    rows = named.join(sizes.withColumn("outside", F.col("size") - F.col("largest")), "key")
    a = rows.where("root <> main").select(
        "key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("root").alias("root_a"),
        block_of("outside").alias("i"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("j"),
    )
    b = rows.select(
        "key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("root").alias("root_b"), "main",
        block_of("size").alias("j"), F.explode(F.sequence(F.lit(0), blocks("outside") - 1)).alias("i"),
    )
    once = (F.col("root_b") == F.col("main")) | (F.col("a") < F.col("b"))
    alike = _may_be_similar(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), similarity)
    pairs = a.join(b, ["key", "i", "j"]).where((F.col("root_a") != F.col("root_b")) & once & alike)
    return pairs.select("a", "b")


def without_near_duplicates(
    docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY
) -> DataFrame:
    """The first row of each group of near duplicates, unchanged and with all its columns.

    ``docs`` must be read from files (or a checkpoint): it is read several times, and rows
    are told apart by their place.
    """
    ship_package(docs.sparkSession)
    rows = with_uid(docs, text=F.col(text_col).cast("string"))
    texts = rows.select("uid", "text")
    signed = written(
        texts.mapInArrow(_signed(shingle), "uid long, n int, same binary, chunk int, counts binary"), "signatures"
    )
    found = signed.where("uid IS NOT NULL").select("uid", "same")
    firsts = written(found.groupBy("same").agg(F.min("uid").alias("node")), "firsts")
    counts = _counters(signed)
    hot_from = max(HOT_LEAST, int(counts.sum(dtype=np.int64)) // HOT_SHARE)
    counters = docs.sparkSession.sparkContext.broadcast(counts)
    # Texts stay where they are: keys are few bytes beside them.
    keyed = texts.mapInArrow(
        _keyed(shingle, similarity, counters, hot_from),
        "node long, fp long, n int, profile binary, keys array<struct<key: long, hot: boolean>>",
    )
    keyed = written(keyed.join(firsts, "node", "left_semi"), "keyed")
    dealt = keyed.select(F.posexplode("keys").alias("pos", "of"), "node", "n").select(
        "of.key", "of.hot", "node", "n", "pos"
    ).where("key IS NOT NULL")
    buckets = _shared_keys(dealt, similarity)
    wanted = written(buckets.select("node").distinct(), "wanted")
    profiles = written(keyed.join(wanted, "node", "left_semi").select("node", "n", "profile"), "profiles")
    linked = checked(fingerprint_pairs(keyed), profiles, texts, shingle, similarity)
    roots = similar_groups(buckets, profiles, texts, shingle, similarity, linked)
    first = roots.groupBy("root").agg(F.min("node").alias("node"))
    later = roots.select("node").join(first.select("node"), "node", "left_anti")
    copies = found.select("uid").join(firsts.select(F.col("node").alias("uid")), "uid", "left_anti")
    dropped = later.select(F.col("node").alias("uid")).unionByName(copies)
    return rows.select("uid", "row").join(written(dropped, "dropped"), "uid", "left_anti").select("row.*")
