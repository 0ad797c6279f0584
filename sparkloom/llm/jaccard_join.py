"""N-gram Jaccard join by the chosen-path method, with an exact check.

A text's set is its windows of ``WORDS`` words, hashed with 64 bits (a text with fewer words has one window of all its words).
Equal sets form a text class that is joined once, whatever its number of copies. Every
class is embedded as ``WIDTH`` minimum hashes (its tokens are the first ``TOKENS``), so that all have equally many tokens and two agree in
a token with the probability of their similarity.

A run starts from the root; each node of its tree samples one or two tokens (1 / similarity on average, by a hash of the node's
path) and deals its sets by the values there. Buckets of up to ``SMALL`` sets and ``BUCKET_HASHES`` hashes are brute-forced; larger ones are split
again, up to ``DEPTH`` levels; what is still large then is brute-forced in pairs of blocks. ``runs``
follows from the target recall and the chance that a pair at the threshold stays together over all levels.

Brute force is done twice, each time inside the buckets. Two sets that share several buckets belong to the one with the smallest number alone: every set carries the numbers of its
buckets, so a task knows its own pairs. First sketches (a byte of each minimum hash) are compared, with ``SLACK`` below the threshold, some 4.5
standard deviations; sets with a near partner of their own in a bucket go on. Then their whole sets meet in that bucket and all of its own pairs are compared exactly. A bucket yields the number of
links of each set and a forest of them; pairs are never emitted, and pairs that share no bucket are never compared. Large buckets all of whose sets also share another one own nothing and are left out.
The work for a group of different texts that are all near each other grows with its square, as its links do, but in tasks of bounded memory.

Cases: rows with a null id take no part (class_id and text_class null, no links); a null text, or one
without a word, has an empty set, is like no other and has its own id as class. Repeated rows (same id, same text) are copies of one another.
Without any near pair every text class is its own class. Columns besides doc_id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import among, bitmap, cut, discard, marked, place, settled, slices
from sparkloom.sources.shared import small_batches
from sparkloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
WIDTH = 128
#: Of those, the tokens that runs sample.
TOKENS = 64
SMALL, DEPTH = 512, 5
TARGET_RECALL = 0.995
SLACK = 0.16
#: Hashes of all sets of a bucket, and of two groups of sets that are compared at once.
BUCKET_HASHES, AT_ONCE = 4_000_000, 2_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def survival(similarity: float, depth: int) -> float:
    """Chance that two sets this similar share a bucket ``depth`` levels down in one run."""
    two, q = 1 / similarity - 1, 1.0
    for _ in range(depth):
        apart = 1 - similarity * q
        q = 1 - ((1 - two) * apart + two * apart**2)
    return q


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """A text's sorted set of window hashes."""
    found = WORD.findall(text) if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


_CONSTANTS = np.random.default_rng(5).integers(0, 2**32, (2, WIDTH), dtype=np.uint32)
_MULTIPLIERS, _MASKS = _CONSTANTS[0] | np.uint32(1), _CONSTANTS[1]


def minimum_hashes(s: np.ndarray) -> np.ndarray:
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(WIDTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        part = (low[at : at + 1024, None] ^ _MASKS) * _MULTIPLIERS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def node_of(s: np.ndarray) -> bytes | None:
    """The id of a text class: 128 bits of its set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def embed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, signature, sketch) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            mins = [minimum_hashes(s) if len(s) else None for s in sets]
            columns = [
                b.column("doc_id"),
                pa.array([node_of(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([None if m is None else m[:TOKENS].astype(">u4").tobytes() for m in mins], pa.binary()),
                pa.array([None if m is None else m.astype(np.uint8).tobytes() for m in mins], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n", "signature", "sketch"])
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node binary, n long, signature binary, sketch binary")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by key."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        k = t.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1]) if len(t) else None
    if rest is not None and len(rest):
        yield rest


def roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The smallest index of each item's component."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


class Owners:
    """Tells which pairs of a bucket's members are its own, from the numbers of all buckets of each."""

    def __init__(self, bucket: int, lists: pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
        of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        ids = lists.flatten().to_numpy()
        of, ids = of[ids < bucket], ids[ids < bucket]
        _, column, count = np.unique(ids, return_inverse=True, return_counts=True)
        shared = count > 1
        keep = shared[column]
        of, column = of[keep], (np.cumsum(shared) - 1)[column[keep]]
        self.bits = np.zeros((len(lists), max(1, (int(shared.sum()) + 63) // 64)), np.uint64)
        np.bitwise_or.at(self.bits, (of, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))

    def own(self, i: int, j: np.ndarray) -> np.ndarray:
        """Whether member i and each of the members j share no bucket with a smaller number."""
        return ~(self.bits[i] & self.bits[j]).any(axis=1)


def with_partners(members: DataFrame, similarity: float) -> DataFrame:
    """(pair, bucket, block, other, node) of the members (and buckets, n, sketch) that have a near partner of their own in a bucket or pair of blocks."""
    least = math.floor(WIDTH * (similarity - SLACK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "pair"):
            if len(t) < 2:
                continue
            x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, WIDTH)
            n, block = t.column("n").to_numpy(), t.column("block").to_numpy()
            across = t.column("block")[0].as_py() != t.column("other")[0].as_py()
            owners, partner = Owners(t.column("bucket")[0].as_py(), t.column("buckets")), np.zeros(len(x), bool)
            for i in range(len(x) - 1):
                fits = (x[i + 1 :] == x[i]).sum(axis=1) >= least
                fits &= np.minimum(n[i + 1 :], n[i]) >= similarity * np.maximum(n[i + 1 :], n[i])
                if across:
                    fits &= block[i + 1 :] != block[i]
                j = np.flatnonzero(fits) + i + 1
                j = j[owners.own(i, j)]
                partner[j] = True
                partner[i] |= len(j) > 0
            if partner.any():
                yield from t.filter(pa.array(partner)).select(["pair", "bucket", "block", "other", "node"]).combine_chunks().to_batches()

    dealt = members.repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "pair long, bucket long, block long, other long, node binary")


def chosen_paths(classes: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, size, hashes) of the buckets of classes (node, n, signature) that are not split again, and those of them that are still large."""
    two = 1 / similarity - 1
    rng = np.random.default_rng(7)
    starts = [(run, int(i)) for run in range(runs_for(recall, similarity)) for i in rng.choice(TOKENS, 1 + (rng.random() < two), replace=False)]

    def token(i: int):
        """The token at a place of the signature."""
        return F.substring("signature", i * 4 + 1, 4)

    keys = F.array(*[F.xxhash64(F.lit(run), F.lit(i), token(i)) for run, i in starts])
    level = classes.select("node", "n", F.explode(keys).alias("bucket"))
    signatures = classes.select("node", "signature")
    fits = (F.col("size") <= SMALL) & (F.col("hashes") <= BUCKET_HASHES)
    small: DataFrame | None = None
    for depth in range(1, DEPTH + 1):
        every = cut(level, "every")
        # sizes are a table of their own, so that the join below can split a bucket that holds many of the rows
        sizes = cut(every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes")).filter("size > 1"), "sizes")
        level = cut(every.join(sizes.hint("merge"), "bucket").select("bucket", "node", "n", "size", "hashes"), "level")
        discard(every, sizes)
        done = level.filter(fits).select("bucket", "node", "size", "hashes")
        small = done if small is None else small.unionAll(done)
        large = level.filter(~fits)
        if depth < DEPTH:
            if large.isEmpty():
                break
            # the node's own samples: one token always, a second with probability 1 / similarity - 1
            first = F.pmod(F.xxhash64("bucket", F.lit("first")), F.lit(TOKENS)).cast("int")
            second = F.pmod(first + 1 + F.pmod(F.xxhash64("bucket", F.lit("second")), F.lit(TOKENS - 1)).cast("int"), F.lit(TOKENS))
            more = F.pmod(F.xxhash64("bucket", F.lit("two")), F.lit(1 << 20)) < int(two * (1 << 20))
            key = lambda i: F.xxhash64("bucket", i, F.substring(F.col("signature"), i * 4 + 1, F.lit(4)))
            next_keys = F.when(more, F.array(key(first), key(second))).otherwise(F.array(key(first)))
            level = large.join(signatures, "node").select("node", "n", F.explode(next_keys).alias("bucket"))
    return small, large.select("bucket", "node", "size", "hashes")


def dealt_members(classes: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(pair, bucket, block, other, node) of each bucket, or pair of blocks of a large one, and its members; and (node, buckets), all that a member is in."""
    small, large = chosen_paths(classes, similarity, recall)
    final = small.unionAll(large)
    lists = cut(final.groupBy("node").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")), "lists")
    # large buckets whose sets all share a bucket with a smaller number own no pair
    shared = large.join(lists, "node").select("bucket", "size", F.explode(F.filter("buckets", lambda x: x < F.col("bucket"))).alias("less"))
    covered = shared.groupBy("bucket", "less").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).filter("n = size").select("bucket").distinct()
    large = large.join(covered, "bucket", "left_anti")
    zero = F.lit(0).cast("long")
    whole = small.select(F.col("bucket").alias("pair"), "bucket", zero.alias("block"), zero.alias("other"), "node")
    n_blocks = F.greatest(F.ceil(F.col("size") / SMALL), F.ceil(F.col("hashes") / BUCKET_HASHES))
    blocks = large.withColumn("_own", F.pmod(F.xxhash64("node", "bucket"), n_blocks)).withColumn("_j", F.explode(F.sequence(zero, n_blocks - 1)))
    low, high = F.least("_own", "_j"), F.greatest("_own", "_j")
    # of a pair of blocks, block is the member's own; a block beside itself has equal ones
    halves = blocks.select(F.xxhash64("bucket", low, high).alias("pair"), "bucket", F.col("_own").alias("block"), F.col("_j").alias("other"), "node")
    return whole.unionAll(halves), lists


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs; hashes that fewer than two sets hold are left out first."""
    hashes = np.concatenate([*left, *right])
    of = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], place[column[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    width = int(shared.sum())
    for at in range(0, width, 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        m = np.zeros((len(left) + len(right), min(4096, width - at)), np.float32)
        m[of[a:b], column[a:b] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def slices_of(sizes: np.ndarray, members: np.ndarray) -> Iterator[np.ndarray]:
    """Members in groups of so many hashes, or one."""
    at = np.cumsum(sizes[members]) // (AT_ONCE // 2)
    return iter(np.split(members, np.flatnonzero(np.diff(at)) + 1))


def true_links(members: DataFrame, similarity: float) -> DataFrame:
    """(node, links, texts, root) per bucket or pair of blocks, from (pair, bucket, block, other, node, buckets, copies, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, int, bytes]] = []
        for t in groups(batches, "pair"):
            t = t.sort_by([("node", "ascending")])
            names = t.column("node").to_pylist()
            if len(set(names)) < len(names):  # a set that was made of several equal rows
                t = t.take([k for k in range(len(names)) if not k or names[k] != names[k - 1]])
            nodes, copies = t.column("node").to_pylist(), t.column("copies").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            block, other = t.column("block").to_numpy(), t.column("other").to_numpy()
            one = block[0] == other[0]  # pairs within a block
            left = np.arange(len(sets)) if one else np.flatnonzero(block == block.min())
            right = left if one else np.flatnonzero(block != block.min())
            if len(left) and len(right) and len(sets) > 1:
                owners = Owners(t.column("bucket")[0].as_py(), t.column("buckets"))
                links, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                pairs_a, pairs_b = [], []
                for a in slices_of(sizes, left):
                    for b in slices_of(sizes, right):
                        if one and a[0] > b[0]:
                            continue
                        common = overlaps([sets[i] for i in a], [sets[i] for i in b])
                        link = common >= similarity * (sizes[a][:, None] + sizes[b][None, :] - common)
                        for k in np.flatnonzero(link.any(axis=1)).tolist():
                            j = b[link[k]]
                            j = j[j > a[k]] if one else j
                            j = j[owners.own(a[k], j)]
                            links[a[k]] += copies[j].sum()
                            texts[a[k]] += len(j)
                            links[j] += copies[a[k]]
                            texts[j] += 1
                            if len(j):
                                pairs_a.append(np.full(len(j), a[k]))
                                pairs_b.append(j)
                if pairs_a:
                    top = roots(len(sets), np.concatenate(pairs_a), np.concatenate(pairs_b))
                    out += [(nodes[k], int(links[k]), int(texts[k]), nodes[top[k]]) for k in np.flatnonzero(texts).tolist()]
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=["node", "links", "texts", "root"])

    dealt = members.repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "node binary, links long, texts long, root binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, node, ...) with the hashes of its class' set, from the text of document rep.

    Texts are not shuffled: the scan makes the sets of documents that a bitmap of the wanted ids marks, and only those sets meet
    ``wanted``. A document that stands in several rows gives its set several times."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.col("rep").alias("id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            for part in slices([b.filter(pa.array(marked(bits.value, b.column("_at").to_numpy())))]):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                nodes = pa.array([node_of(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), nodes, pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "node", "hashes"])

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", place(F.col("doc_id")).alias("_at"))
    sets = rows.mapInArrow(run, "rep long, node binary, hashes binary")
    # another row may have the same id and another text, so both are compared
    return wanted.hint("merge").join(sets, ["rep", "node"]).drop("rep")


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, text_class, n_copies, n_links, n_text_links) of each document.

    class_id: the smallest id that chains of links lead to; text_class: the smallest id with an equal
    set; n_copies: documents with an equal set, itself included; n_links: other documents
    of at least this similarity, copies included; n_text_links: other text classes among them."""
    with small_batches(docs.sparkSession):
        return settled(lambda: _join(docs, similarity, recall).drop("_node", "_root"), "joined")


def _join(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """The columns of ``join``, each row's text class (_node) and the one that its class is named after (_root); both null where the set is empty."""
    embedded = cut(embed(docs), "embedded")
    taking = embedded.filter("doc_id IS NOT NULL AND node IS NOT NULL")
    classes = taking.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
    )
    classes = cut(classes, "classes")
    nodes = cut(embedded.select("doc_id", "node"), "nodes")
    discard(embedded)
    small = cut(classes.select("node", "rep", "copies"), "small")
    members, lists = dealt_members(classes.select("node", "n", "signature"), similarity, recall)
    about = cut(classes.select("node", "n", "sketch").join(lists, "node"), "about")
    partners = cut(with_partners(members.join(about.hint("merge"), "node"), similarity), "partners")
    wanted = cut(partners.join(small, "node").join(lists, "node"), "wanted")
    discard(classes, about, partners)
    linked = cut(true_links(sets_of(docs, wanted), similarity), "links")
    tops = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = linked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    ids = small.join(tops, "node").join(totals, "node", "left")
    tops_id = ids.groupBy("root").agg(F.min("rep").alias("class_id"))
    ids = ids.join(tops_id, "root").select("node", "root", "class_id", "links", "texts")
    per_class = small.join(ids, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("rep").alias("text_class"), F.coalesce("class_id", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"))
    # a table of its own, so that the join below can split a class of many copies
    per_class = cut(per_class, "per_class")
    own = F.col("doc_id").isNotNull()
    out = nodes.select("doc_id", F.when(own, F.col("node")).alias("node")).join(per_class, "node", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_class", "doc_id").alias("text_class"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), zero).alias("n_links"),
        F.coalesce("texts", zero).alias("n_text_links"),
        F.col("node").alias("_node"),
        F.col("root").alias("_root"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id. Rows without an id all stay.

    Of an id that stands in several rows, each row is judged by its own text: of those in one class one stays, those in other
    classes stay or go by themselves."""
    with small_batches(docs.sparkSession):
        joined = settled(lambda: _join(docs, similarity, recall), "joined")
    gone = cut(joined.filter("doc_id <> class_id").select("doc_id").distinct(), "gone")
    repeated = joined.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = cut(repeated, "repeated")
    out = without(docs, gone)
    if repeated.isEmpty():
        return out
    # of each class that such an id names, one text class (empty sets are one)
    node, root = (F.coalesce(c, F.lit(b"")).alias(c) for c in ("_node", "_root"))
    named = joined.filter("doc_id = class_id").join(repeated, "doc_id", "left_semi").select("doc_id", node, root)
    named = named.groupBy("doc_id", "_root").agg(F.min("_node").alias("_node")).drop("_root")
    rows = docs.filter(among(F.col("doc_id"), repeated.select(F.col("doc_id").alias("id")))).select("doc_id", "text", F.struct("*").alias("_row"))
    rows = with_node(rows.join(repeated, "doc_id", "left_semi"))
    again = rows.join(named, ["doc_id", "_node"]).dropDuplicates(["doc_id", "_node"])
    return without(out, repeated).unionAll(again.select("_row.*"))


def with_node(rows: DataFrame) -> DataFrame:
    """``rows`` and the text class of each (_node; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes = pa.array([node_of(shingles(t)) or b"" for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], names=[*b.schema.names, "_node"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_node", T.BinaryType())]))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone`` (doc_id); only rows that a bitmap marks take part in the join's shuffle."""
    maybe = among(F.col("doc_id"), gone.select(F.col("doc_id").alias("id")))
    return docs.filter(~maybe).unionAll(docs.filter(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns))
