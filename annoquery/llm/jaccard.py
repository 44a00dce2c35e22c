"""Set-similarity join on word shingles by chosen paths.

Every distinct shingle set has a signature of ``COORDINATES`` min-hashes. A run starts with one bucket of all sets and splits
recursively: at each bucket one or two coordinates (1/threshold on average) are chosen by a hash of the bucket's path, and a set goes
to the child named by its token there. A bucket of at most ``small`` sets is compared by brute force; a larger one
is split again, down to ``depth`` levels. Runs repeat until the recall bound for pairs at the threshold is reached.

Comparing goes in two steps, so that a set's text moves once and no pairs are written. Buckets only connect sets
whose signatures look alike (spanning edges; a bucket still large at the last level is connected as a whole). Within
the connected clusters the exact Jaccard similarity of *all* pairs is taken, in blocks of bounded size, each pair in
exactly one task. A task gives one row per linked set: its number of links and the smallest set it is connected to.

Defined results: a null or empty text is a class of its own without links; a text of fewer than five words has one
shingle, all its words; equal texts are copies, linked to each other. A repeated ``doc_id`` is one document: its
rows get one class. A row without ``doc_id`` has no class. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import hashed_words, in_groups, mixed, rolled, staged, task

COORDINATES = 64
SETS = "doc_id long, d1 long, d2 long, signature binary"


def shingle_sets_of(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``width`` words."""
    hashes, edges = hashed_words(texts, plain=False)
    words = np.split(hashes, edges[1:-1])
    return [np.unique(rolled(w, min(width, len(w)), 5)) if len(w) else np.zeros(0, np.uint64) for w in words] if texts else []


def signature(shingles: np.ndarray) -> np.ndarray:
    """Min-hashes: one permuted minimum per coordinate, cut to 32 bits."""
    factors = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        permuted = shingles[at : at + 4096, None] * factors
        out = np.minimum(out, (permuted ^ (permuted >> np.uint64(31))).min(axis=0))
    return mixed(out).astype(np.uint32)


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """Signature and 128-bit digest of each document's shingle set; null without words or doc_id."""

    @task
    def make(batches):
        import xxhash

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts, 1 << 18):
                rows = []
                for key, own in zip(keys[a:b], shingle_sets_of(texts[a:b], width)):
                    if len(own) and key is not None:
                        digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                        rows.append((key, int(digest[0]), int(digest[1]), signature(own).tobytes()))
                    else:
                        rows.append((key, None, None, None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "d1", "d2", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, SETS)


def runs_for(recall: float, depth: int) -> int:
    """Runs that a pair at the threshold needs: it survives a level with as many children as a Poisson number of mean 1."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _children(paths: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and paths of the children: one coordinate for each path, and a second one with probability 1/threshold - 1."""
    seed = mixed(paths)
    first = seed % np.uint64(COORDINATES)
    second = mixed(seed) % np.uint64(COORDINATES - 1)
    second += second >= first
    twice = (mixed(seed + np.uint64(1)) >> np.uint64(11)) < np.uint64(int((1 / threshold - 1) * 2**53))
    rows = np.concatenate([np.arange(len(paths)), np.flatnonzero(twice)])
    coordinates = np.concatenate([first, second[twice]])
    tokens = signatures[rows, coordinates.astype(np.int64)].astype(np.uint64)
    return rows, mixed(paths[rows] * np.uint64(31) + mixed(tokens + (coordinates << np.uint64(32))))


def _split(nodes: DataFrame, threshold: float) -> DataFrame:
    """Children (path, cid) of nodes (path, cid, signature)."""

    def make(batches):
        for batch in batches:
            paths = batch.column("path").to_numpy().view(np.uint64)
            cids = batch.column("cid").to_numpy()
            if len(paths):
                signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                rows, children = _children(paths, signatures, threshold)
                yield pa.RecordBatch.from_pydict({"path": children.view(np.int64), "cid": cids[rows]})

    return nodes.select("path", "cid", "signature").mapInArrow(make, "path long, cid long")


def groups_of(batches, keys: list[str]):
    """Consecutive rows with equal keys, as tables, from a sorted partition."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        change = np.zeros(held.num_rows, bool)
        for key in keys:
            values = held.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        edges = np.flatnonzero(change)
        start = 0
        for end in edges.tolist():
            yield held.slice(start, end - start)
            start = end
        held = held.slice(start).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each component of n items joined by pairs."""
    root = np.arange(n)
    while len(pairs):
        least = root.copy()
        np.minimum.at(least, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], root[pairs[:, 0]])
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    return root


def _look_alike(buckets: DataFrame, least: float) -> DataFrame:
    """Spanning edges (u, v) of the sets of each small bucket whose signatures agree on a share ``least`` of coordinates."""

    def make(batches):
        us, vs = [], []
        for group in groups_of(batches, ["path"]):
            cids = group.column("cid").to_numpy()
            if len(cids) > 1:
                s = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                pairs = np.concatenate([np.column_stack([np.full(len(j), i), i + 1 + j]) for i in range(len(s) - 1) for j in [np.flatnonzero((s[i + 1 :] == s[i]).mean(axis=1) >= least)]])
                root = _roots(len(cids), pairs)
                own = np.flatnonzero(root != np.arange(len(cids)))
                us.append(cids[own])
                vs.append(cids[root[own]])
            if len(us) > 2000:
                yield pa.RecordBatch.from_pydict({"u": np.concatenate(us), "v": np.concatenate(vs)})
                us, vs = [], []
        if us:
            yield pa.RecordBatch.from_pydict({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return buckets.select("path", "cid", "signature").repartition("path").sortWithinPartitions("path", "cid").mapInArrow(make, "u long, v long")


def candidate_edges(sets: DataFrame, threshold: float, recall: float, depth: int, small: int) -> DataFrame:
    """Edges (u, v) that connect all sets which share a final bucket of some run and look alike."""
    edges = None
    starts = sets.select("cid", "signature", F.explode(F.array(*[F.lit(r) for r in range(1, runs_for(recall, depth) + 1)])).alias("run"))
    nodes = _split(starts.select(F.xxhash64("run").alias("path"), "cid", "signature"), threshold)
    for level in range(1, depth + 1):
        nodes = staged(nodes, f"level-{level}")
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n"), F.min("cid").alias("least")).where("n > 1")
        shared = nodes.join(sizes, "path").join(sets.select("cid", "signature"), "cid")
        found = _look_alike(shared.where(F.col("n") <= small), threshold - 0.2)
        large = shared.where(F.col("n") > small)
        if level == depth:
            found = found.union(large.select(F.col("cid").alias("u"), F.col("least").alias("v")).where("u <> v"))
        found = staged(found, "alike")
        edges = found if edges is None else edges.union(found)
        if level < depth:
            nodes = _split(large, threshold)
    return edges


def _compare(texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(cid, links, root) for sets with links, from rows (cluster, i, j, block, cid, copies, text), one task for each (cluster, i, j)."""
    need = round(threshold * 1000)

    @task
    def make(batches):
        for group in groups_of(batches, ["cluster", "i", "j"]):
            cids, copies, block = (group.column(c).to_numpy() for c in ("cid", "copies", "block"))
            n = len(cids)
            sets = shingle_sets_of(group.column("text").to_pylist(), width)
            sizes = np.fromiter(map(len, sets), np.int64, n)
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(n), sizes)
            shared = times > 1
            narrow = np.cumsum(shared) - 1
            row, column = row[shared[column]], narrow[column[shared[column]]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            common = np.zeros((n, n), np.int64)
            for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
                a, b = np.searchsorted(column, [at, at + 8192])
                dense = np.zeros((n, 8192), np.float32)
                dense[row[a:b], column[a:b] - at] = 1
                common += (dense @ dense.T).astype(np.int64)
            linked = common * 1000 >= need * (sizes[:, None] + sizes[None, :] - common)
            np.fill_diagonal(linked, False)
            if group.column("i")[0].as_py() != group.column("j")[0].as_py():
                linked &= block[:, None] != block[None, :]
            root = _roots(n, np.argwhere(linked))
            own = np.flatnonzero(linked.any(axis=1))
            if len(own):
                yield pa.RecordBatch.from_pydict({"cid": cids[own], "links": (linked[own] @ copies).astype(np.int64), "root": cids[root[own]]})

    keys = ["cluster", "i", "j"]
    return texts.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(make, "cid long, links long, root long")


def similarity_classes(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.99, depth: int = 4, small: int = 128, block: int = 128, broadcast_rows: int = 500_000
) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row per document.

    ``class_id`` is the smallest doc_id connected by links (similarity of at least ``threshold``), ``n_links`` the number
    of other documents similar to this one, copies included, and ``n_copies`` the documents with the same set.
    """
    each = staged(shingle_sets(docs, width), "sets")
    sets = each.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.min("signature").alias("signature"))
    sets = staged(sets, "distinct-sets")
    clusters = components(candidate_edges(sets, threshold, recall, depth, small))
    clusters = staged(clusters.select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "clusters")
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").join(sets.select("cid", "copies"), "cid")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = staged(sized.select("cluster", "cid", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks.cast("long")).cast("int").alias("block")), "members")
    few = members.count() <= broadcast_rows  # about 30 bytes a row: a proven bound for the broadcast, a shuffle join beyond it
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(F.broadcast(members) if few else members, "cid")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    texts = texts.select("cluster", "cid", "copies", "text", "block", other)
    texts = texts.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "copies", "text")
    linked = staged(_compare(texts, threshold, width), "linked")
    links = linked.groupBy("cid").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    about = sets.select("d1", "d2", "cid", "copies").join(links, "cid", "left").join(classes, "cid", "left")
    about = about.select("d1", "d2", F.coalesce("component", "cid").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    have = each.select("doc_id", "d1", "d2").join(about, ["d1", "d2"])
    rest = each.where("d1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return have.select("doc_id", "class_id", "n_links", "n_copies").union(rest)
