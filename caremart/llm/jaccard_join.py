"""Jaccard join of documents on word shingles by chosen paths.

Documents become sets of hashed 5-word shingles; equal sets are one class from the start.
Signatures of ``POSITIONS`` min-hashes stand for the sets' shared tokens.  Each run walks a tree
from the root: a node chooses one position, and with probability 1/similarity - 1 a second one, and
every set goes on to the child named by its token there.  Similar sets share a path with a
probability that falls slowly with depth, dissimilar ones part at almost every step.  Buckets
of at most ``BUCKET`` sets are compared by brute force; larger ones are split further, down to
``MAX_DEPTH``.  Runs are repeated until the chance to meet reaches ``RECALL`` for a pair at the
threshold, at the greatest depth (``runs_needed``).

What is still large at the greatest depth (groups of near copies) is compared in random blocks,
another division in every run; only buckets that then still hold several components are compared
whole, in tiles of two blocks.  Candidate pairs are kept as spanning edges, linear in the number
of sets.  Their components are compared exactly, all pairs of a component once, on the sets
made anew from whole texts, again in tiles; counted links and spanning edges of exact links come
out, never all pairs.  So nothing is capped, and no task holds more than two blocks.

Result: one row per document: doc_id, class_id (the smallest doc_id reachable by links), n_links
(other documents with a similarity of at least the threshold; equal sets count one by one),
n_same (documents of the same set, itself included).

Defined cases: null and wordless texts are in no link and are their own class; a text of one to four words
is one shingle; a row with a null doc_id takes no part and gets a null class; a doc_id given to several
texts is linked by each of them and reported once per row; repeated rows are copies; empty
tables are fine; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.llm.common import cut, near_join, slices
from caremart.llm.components import components
from caremart.llm.shingles import mix, shingle_set

SIZE, SIMILARITY, RECALL = 5, 0.8, 0.999
POSITIONS = 64
START_DEPTH, MAX_DEPTH = 2, 5
BUCKET = 256  # sets compared by brute force; also the block of larger buckets
SCREEN = 0.2  # pairs whose signatures agree in threshold - SCREEN are candidates (4 deviations)
TILE_BYTES, TILE_ROWS = 2 << 20, 1024  # text and rows of a block of the exact comparison
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _keys(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD)


def signature(tokens: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """Min-hashes of a set, 32 bits each."""
    keys = _keys(positions)
    salt, odd = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    low = np.full(positions, 0xFFFFFFFF, np.uint32)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1 << 14):  # pieces keep the product small
        np.minimum(low, ((short[None, i:i + (1 << 14)] ^ salt[:, None]) * odd[:, None]).min(axis=1), out=low)
    return low


def branch(path: np.ndarray, similarity: float, positions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A node's first position, its second, and whether it uses the second."""
    first = mix(path + np.uint64(1)) % np.uint64(positions)
    second = (first + np.uint64(1) + mix(path + np.uint64(2)) % np.uint64(positions - 1)) % np.uint64(positions)
    both = mix(path + np.uint64(3)) < np.uint64(int((1 / similarity - 1) * 2**64))
    return first.astype(np.int64), second.astype(np.int64), both


def descend(path: np.ndarray, which: np.ndarray, signs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of (path, set) rows; ``which`` is the set's row of ``signs``."""
    first, second, both = branch(path, similarity, signs.shape[1])
    out = []
    for at, on in ((first, np.ones(len(path), bool)), (second, both)):
        token = (at[on].astype(np.uint64) << np.uint64(32)) | signs[which[on], at[on]].astype(np.uint64)
        out.append((mix(mix(path[on]) ^ mix(token + _ODD)), which[on]))
    return np.concatenate([p for p, _ in out]), np.concatenate([w for _, w in out])


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs until a pair of this similarity shares a path of this depth with this chance."""
    chance = 1.0
    for _ in range(depth):
        p = similarity * chance
        extra = 1 / similarity - 1
        chance = p + extra * (p - p * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - chance))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, node (hash of the shingle set), sign (its signature), n_bytes of each document with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, nodes, signs, length = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tokens = shingle_set(t, size)
                if len(tokens):
                    ids.append(i)
                    nodes.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63))
                    signs.append(signature(tokens).tobytes())
                    length.append(len(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signs, pa.binary()),
                                              pa.array(length, pa.int64())], names=["doc_id", "node", "sign", "n_bytes"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    return known.mapInArrow(run, "doc_id long, node long, sign binary, n_bytes long")


def _matrix(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint32).reshape(len(signs), -1)


def _grow(rows: DataFrame, similarity: float, roots: list[int] | None, levels: int) -> DataFrame:
    """(path, node) rows ``levels`` further down; from the runs' roots, or from column ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, signs = b.column(0).to_numpy(), _matrix(b.column(1).to_pylist())
            every = np.arange(b.num_rows)
            starts = [np.full(b.num_rows, r, np.uint64) for r in roots] if roots else [b.column(2).to_numpy().view(np.uint64)]
            for path in starts:
                which = every
                for _ in range(levels):
                    path, which = descend(path, which, signs, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(path)), pa.array(nodes[which])], names=["path", "node"])

    return rows.select("node", "sign", *([] if roots else ["path"])).mapInArrow(run, "path long, node long")


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows that share their first ``n_keys`` columns."""
    held: list[pa.Table] = []
    key: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = np.stack([t.column(i).to_numpy() for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for x, y in itertools.pairwise(cuts):
            own = tuple(keys[:, x].tolist())
            if own != key and held:
                yield key, pa.concat_tables(held)
                held = []
            key = own
            held.append(t.slice(x, y - x))
    if held:
        yield key, pa.concat_tables(held)


def spanning(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Spanning star edges (smallest member, member) of the graph of ``pairs`` (i, its neighbours)."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, found in pairs:
        for j in found.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(r, i) for i in range(n) if (r := root(i)) != i]


def _near_signs(signs: np.ndarray, blocks: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of a tile whose signatures agree in ``least`` positions; across blocks if there are two."""
    two = len(np.unique(blocks)) > 1
    for i in range(len(signs) - 1):
        agree = (signs[i + 1:] == signs[i]).sum(axis=1) >= least
        if two:
            agree &= blocks[i + 1:] != blocks[i]
        yield i, np.flatnonzero(agree) + i + 1


def _candidates(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Spanning edges of candidate pairs of every group of ``keys``; columns block, node, sign follow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, t in grouped(batches, len(keys)):
            nodes = t.column("node").to_numpy()
            signs, blocks = _matrix(t.column("sign").to_pylist()), t.column("block").to_numpy()
            order = np.argsort(nodes, kind="stable")
            for x, y in spanning(len(nodes), _near_signs(signs[order], blocks[order], least)):
                a.append(int(nodes[order[x]]))
                b.append(int(nodes[order[y]]))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (rows.select(*keys, "block", "node", "sign").repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long"))


def _tiles(rows: DataFrame, group: str, member: str, n_blocks: str) -> DataFrame:
    """Rows repeated for every tile (pair of blocks x <= y) of their group, with their block."""
    block = F.pmod(F.xxhash64(F.col(member), F.lit("tile")), F.col(n_blocks)).cast("int")
    return (rows.withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1)))
            .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")))


def candidate_edges(classes: DataFrame, similarity: float, recall: float, start: int, deepest: int,
                    bucket: int, screen: float) -> DataFrame:
    """Spanning edges (a, b) of all candidate pairs of the classes (node, sign)."""
    least = max(1, math.ceil((similarity - screen) * POSITIONS))
    signs = classes.select("node", "sign")
    roots = [int(x) for x in _keys(1000 + runs_needed(similarity, recall, deepest))[1000:]]
    paths = cut(_grow(signs, similarity, roots, start), "paths")
    found: list[DataFrame] = []
    for depth in range(start, deepest + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        held = cut(paths.join(sizes, "path").join(signs, "node").select("path", "node", "n", "sign"), "buckets")
        small = held.filter(F.col("n") <= bucket).withColumn("block", F.lit(0))
        found.append(_candidates(small, ["path"], least))
        large = held.filter(F.col("n") > bucket)
        if large.isEmpty():
            return cut(_union(found), "edges")
        if depth < deepest:
            paths = cut(_grow(large, similarity, None, 1), "paths")
    # groups that no split parts: blocks first, another division for every path
    n_blocks = F.ceil(F.col("n") / bucket).cast("int")
    piece = F.pmod(F.xxhash64("path", "node"), n_blocks).cast("int")
    # the bucket's smallest set joins every block: blocks hang together by it, and the same edges
    # come out of every path
    lowest = (large.groupBy("path").agg(F.min(F.struct("node", "sign")).alias("low"), F.max(n_blocks).alias("k"))
              .select("path", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("piece"), "low.node", "low.sign"))
    pieces = large.select("path", piece.alias("piece"), "node", "sign").union(lowest)
    found.append(_candidates(pieces.withColumn("block", F.lit(0)), ["path", "piece"], least))
    edges = cut(_union(found), "edges")
    known = components(edges)
    named = large.select("path", "node", "n", "sign").join(known, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    mixed = (named.groupBy("path").agg(F.min("component").alias("l"), F.max("component").alias("h"))
             .filter("l < h").select("path"))
    open_ = named.join(mixed, "path").withColumn("n_blocks", n_blocks)
    return cut(edges.union(_candidates(_tiles(open_, "path", "node", "n_blocks"), ["path", "x", "y"], least)), "edges")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def exact_pairs(sets: list[np.ndarray], blocks: np.ndarray, similarity: float,
                across: bool | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later j with a Jaccard similarity of at least the threshold); only ``across`` blocks (a tile of
    two blocks, even if the rows of one are missing), by default if there are two."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, number, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[number] > 1  # a shingle of one set alone is in no intersection
    columns = np.zeros(len(seen), np.int64)
    columns[seen > 1] = np.arange(int((seen > 1).sum()))
    number, owner = columns[number[shared]], owner[shared]
    width = max(1, -(-int((seen > 1).sum()) // 64))
    bits = np.zeros((len(sets), width), np.uint64)
    np.bitwise_or.at(bits, (owner, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    two = len(np.unique(blocks)) > 1 if across is None else across
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, len(sets))
        if two:
            later = later[blocks[later] != blocks[i]]
        fits = np.minimum(n[later], n[i]) >= similarity * np.maximum(n[later], n[i]) - 1e-9
        later = later[fits]
        if len(later):
            both = np.bitwise_count(bits[later] & bits[i]).sum(axis=1, dtype=np.int64)
            yield i, later[both >= similarity * (n[later] + n[i] - both) - 1e-9]


def _links(rows: DataFrame, similarity: float, size: int) -> DataFrame:
    """Exact links of every tile (group, x, y; columns block, node, n_same, text): rows (a, b, n): the
    number n of documents linked to a (b null), or a spanning edge a, b."""
    kind = "a long, b long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), t in grouped(batches, 3):
            nodes, same = t.column("node").to_numpy(), t.column("n_same").to_numpy()
            blocks = t.column("block").to_numpy()
            sets = [shingle_set(w, size) for w in t.column("text").to_pylist()]
            # an id given to several texts: only the text of this node counts, once
            own = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == w for s, w in zip(sets, nodes.tolist(), strict=True)]
            _, once = np.unique(nodes[own], return_index=True)
            at = np.flatnonzero(own)[once]
            if len(at) < 2:
                continue
            nodes, same, blocks, sets = nodes[at], same[at], blocks[at], [sets[i] for i in at]
            linked = np.zeros(len(at), np.int64)

            def counted(across=x != y, same=same, blocks=blocks, sets=sets, linked=linked) -> Iterator[tuple[int, np.ndarray]]:
                for i, j in exact_pairs(sets, blocks, similarity, across):
                    linked[i] += same[j].sum()
                    linked[j] += same[i]
                    yield i, j

            edges = spanning(len(at), counted())
            on = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*nodes[on].tolist(), *(int(nodes[a]) for a, _ in edges)], pa.int64()),
                 pa.array([None] * len(on) + [int(nodes[b]) for _, b in edges], pa.int64()),
                 pa.array([*linked[on].tolist(), *[0] * len(edges)], pa.int64())], names=["a", "b", "n"])

    return (rows.select("group", "x", "y", "block", "node", "n_same", "text")
            .repartition("group", "x", "y").sortWithinPartitions("group", "x", "y").mapInArrow(run, kind))


def link(docs: DataFrame, similarity: float = SIMILARITY, size: int = SIZE, recall: float = RECALL,
         start: int = START_DEPTH, deepest: int = MAX_DEPTH, bucket: int = BUCKET,
         screen: float = SCREEN, tile_bytes: int = TILE_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, class_id, n_links, n_same of every document (one row per row of ``docs``)."""
    members = cut(sketches(docs, size), "sketches")
    classes = cut(members.groupBy("node").agg(F.min(F.struct("doc_id", "n_bytes", "sign")).alias("first"), F.count("*").alias("n_same"))
                  .select("node", "n_same", "first.*"), "classes")
    groups = components(candidate_edges(classes, similarity, recall, start, deepest, bucket, screen))
    size_of = groups.join(classes, "node").groupBy("component").agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
    blocks = F.greatest(F.ceil(F.col("bytes") / tile_bytes), F.ceil(F.col("rows") / tile_rows)).cast("int")
    wanted = cut(groups.join(size_of, "component").join(classes.select("node", "doc_id", "n_same"), "node")
                 .select(F.col("component").alias("group"), "node", "doc_id", "n_same", blocks.alias("n_blocks")), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(_links(_tiles(texts.join(near_join(wanted), "doc_id"), "group", "node", "n_blocks"), similarity, size), "links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    linked = components(found.filter("b IS NOT NULL"))
    named = linked.join(classes.select("node", "doc_id"), "node")
    first = named.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    verdict = (classes.select("node", "n_same", "doc_id")
               .join(named.select("node", "component").join(first, "component"), "node", "left")
               .join(counts, "node", "left")
               .select("node", "n_same", F.coalesce("smallest", "doc_id").alias("class_id"),
                       (F.coalesce("linked", F.lit(0)) + F.col("n_same") - 1).alias("n_links")))
    each = members.select("doc_id", "node").join(verdict, "node").select("doc_id", "class_id", "n_links", "n_same")
    # documents without words or without an id
    rest = docs.filter(~has_words("text") | F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    zero = F.lit(0).cast("long")
    return each.union(rest.select("doc_id", F.col("doc_id").alias("class_id"), zero.alias("n_links"), (zero + 1).alias("n_same")))


def has_words(column: str):
    return F.coalesce(F.col(column).cast("string").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"), F.lit(False))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the one whose doc_id names it.  Repeated rows of
    that document leave one; an id given to several texts stays if any of them names a class."""
    classes = cut(link(docs, **options).select("doc_id", "class_id", "n_same"), "classes")
    per_id = classes.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("class_id")).cast("int")).alias("names"),
                                           F.count("*").alias("rows"))
    gone = cut(per_id.filter("names = 0").select("doc_id"), "gone")
    again = cut(per_id.filter("names = 1 AND rows > 1").select("doc_id"), "again")
    kept = docs.join(near_join(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if again.isEmpty():
        return kept
    twice = kept.join(near_join(again), "doc_id", "left_semi").select(*kept.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(near_join(again), "doc_id", "left_anti").select(*kept.columns).union(twice)
