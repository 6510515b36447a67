"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by an exact join.

The pairs come from three searches. SimHash fingerprints of the sets are linked within REACH bits by the
vantage-point trees of ``simhash``. That finds most copies, but sets of similarity 0.8 differ in about ten bits of
64, where balls around vantage points overlap nearly everywhere, so trees cannot give all of them. The rest meets by
shingles: these have one order for all documents, common ones last, and two sets as similar as that share one of the
first fifth (and one) of each. Which are common is counted over all documents in SLOTS counters; the order changes
only how many candidates are compared. Pairs that meet are compared by their whole sets: fingerprint links and
neighbours in a few orders first, then whatever these have not yet put into one component, so that a large cluster of copies
is not compared pair by pair.

Defined results: documents with equal sets are one (so are all texts without words); texts below five words are one
shingle; repeated rows stay or go together; a null doc_id takes part and always stays; an empty table gives an empty
result; further columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, utf8, without
from .components import connected_components
from .simhash import majority
from .vantage import hamming_links

SHINGLE = 5
REACH = 3
SLOTS = 1 << 23  # counters of shingles, by the low bits of their hashes
CHUNK = 1 << 14  # counters of a row
ORDERS = 4  # orders that neighbours are taken from

_ODD = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_set(text: bytes) -> np.ndarray:
    """Hashes of the word shingles of a text, sorted; ``lower`` and ``split`` of bytes know ASCII only."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    mixed = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k, odd in enumerate(_ODD[: len(words)]):
        mixed += hashed[k : k + n] * odd
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least 0.8."""
    if not 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def parities(found: np.ndarray) -> np.ndarray:
    """256 bits, in four numbers: whether a set has an odd number of shingles in each of as many slots.

    Two sets' bits differ in no more places than the sets do, so bits that differ in over a ninth of both sizes tell
    sets that are not similar.
    """
    odd = np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def shingle_levels(docs: DataFrame) -> np.ndarray:
    """How many binary digits the number of sets has that hold a shingle of each slot."""
    schema = "chunk int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in slices(batches):
            slots = np.concatenate([shingle_set(t) for t in batch.column("text").to_pylist()]) & np.uint64(SLOTS - 1)
            np.add.at(counts, slots.astype(np.int64), np.uint32(1))
        few = np.minimum(counts, 0xFFFF).astype(np.uint16)  # of one task
        parts = [(k, c.tobytes()) for k, c in enumerate(few.reshape(-1, CHUNK)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for k, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(counts, np.uint16).astype(np.float64)
        levels = [np.ceil(np.log2(c + 1)).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "counts"])

    found = np.zeros(SLOTS, np.uint8)
    for k, levels in docs.select(utf8().alias("text")).mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        found[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(levels, np.uint8)
    return found


def prefix(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, one of which every similar set has among its own first ones."""
    n = len(found)
    if not n:
        return found
    order = np.argsort(levels[(found & np.uint64(len(levels) - 1)).astype(np.int64)], kind="stable")
    return found[order[: n - (4 * n + 4) // 5 + 1]]


PARITIES = [f"odd{k}" for k in range(4)]
SETS = "doc_id long, hash long, key long, fp long, n int, prefix binary, " + ", ".join(f"{c} long" for c in PARITIES)


def shingled(docs: DataFrame) -> DataFrame:
    """A row for each document, written once; ``key`` is a hash of its set, ``fp`` its fingerprint; ``parities`` tell far sets."""
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(docs))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            keys, prints = (np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (lambda s: xxhash.xxh3_64_intdigest(s.tobytes()), lambda s: majority(iter([s]))))
            firsts = [prefix(s, levels.value).tobytes() for s in sets]
            columns = [batch.column("doc_id"), batch.column("hash"), pa.array(keys), pa.array(prints), pa.array([len(s) for s in sets], pa.int32()), pa.array(firsts, pa.binary())]
            columns += [pa.array(c) for c in np.array([parities(s) for s in sets], np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "hash", "key", "fp", "n", "prefix", *PARITIES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8()).alias("hash"), utf8().alias("text"))
    return materialize(rows.mapInArrow(compute, SETS), "shingled")


TOKEN = "token long, key long, n int, at int"


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        firsts = [np.frombuffer(p, np.int64) for p in batch.column("prefix").to_pylist()]
        sizes = [len(p) for p in firsts]
        key, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("key", "n"))
        at = np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(firsts), key, n, at)], names=["token", "key", "n", "at"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in the order of the first one, cut only between its values."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or held and held[0][0][0] != columns[0][0]:
            whole = [np.concatenate(x) for x in zip(*held, [c[:last] for c in columns], strict=True)]
            yield whole
            held, columns = [], [c[last:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _partners(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows of one token can be similar sets: as many shingles can still follow as similar sets share."""
    alike = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    return alike & (9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j]))


def _nearest(token: np.ndarray, key: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, before, shared): rows in order, the key of the nearest partner of another root before each (its own for none), and whether it has any on either side.

    The order inside a token is one of ORDERS, by the token, and others in another turn, so that a set has that many
    neighbours in a cluster.
    """
    mixed = (key.view(np.uint64) ^ (token.view(np.uint64) % np.uint64(ORDERS) + np.uint64(ORDERS * turn)) * _ODD[2]) * _ODD[0]
    order = np.lexsort((key, mixed ^ (mixed >> np.uint64(31)), token))
    token, key, n, at, root = token[order], key[order], n[order].astype(np.int64), at[order].astype(np.int64), root[order]
    number = np.arange(len(token))
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(begins, len(token)))
    before, shared = key.copy(), np.zeros(len(key), bool)
    met = number == np.repeat(begins, sizes)  # the first row of a token has none before it
    last = np.repeat(begins + sizes - 1, sizes)
    one_root = np.repeat(np.minimum.reduceat(root, begins) == np.maximum.reduceat(root, begins), sizes)
    i, step = number[~one_root], 0
    while len(i):
        # Only rows that have met none yet, on either side, go on.
        step += 1
        last_open = np.repeat(np.maximum.reduceat(np.where(met, -1, number), begins), sizes)
        i = i[i + step <= np.where(shared[i], last_open[i], last[i])]
        j = i + step
        near = (~met[j] | ~shared[i]) & (root[i] != root[j]) & _partners(n, at, i, j)
        a, b = i[near], j[near]
        first = ~met[b]
        before[b[first]] = key[a[first]]
        met[b] = shared[a] = shared[b] = True
    return order, before, shared


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TOKEN rows in order of token -> those that have a partner, each with the key of the nearest before it."""
    for token, key, n, at in _whole_groups(batches):
        order, before, shared = _nearest(token, key, n, at, key, 0)
        columns = [pa.array(x[shared]) for x in (*(c[order] for c in (token, key, n, at)), before)]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "key", "n", "at", "before"])


def _again_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, key, n, at, root) in order of token -> pairs of neighbours of different roots, in other orders."""
    for token, key, n, at, root in _whole_groups(batches):
        order, before, _ = _nearest(token, key, n, at, root, 1)
        own = key[order]
        some = before != own
        yield pa.RecordBatch.from_arrays([pa.array(f(before[some], own[some])) for f in (np.minimum, np.maximum)], names=["a", "b"])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, key, n, at, root, parities) in order of token and size -> pairs of different roots that can be similar."""
    for token, key, n, at, root, *odd in _whole_groups(batches):
        begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        mixed = np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)
        some = np.repeat(mixed, np.diff(np.append(begins, len(token))))
        token, key, root, bits = token[some], key[some], root[some], np.stack(odd, axis=1)[some].view(np.uint64)
        n, at, i, step = n[some].astype(np.int64), at[some].astype(np.int64), np.arange(int(some.sum())), 0
        while len(i):
            step += 1
            i = i[i + step < len(token)]
            i = i[(token[i] == token[i + step]) & (5 * n[i] >= 4 * n[i + step])]
            apart = root[i] != root[i + step]
            near = i[apart][_partners(n, at, i[apart], i[apart] + step)]
            near = near[9 * np.bitwise_count(bits[near] ^ bits[near + step]).sum(axis=1, dtype=np.int64) <= n[near] + n[near + step]]
            if len(near):
                a, b = key[near], key[near + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3).compress
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([pack(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["hash", "text"])


def _similar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, held, unpack = None, np.zeros(0, np.uint64), zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, 64):
        a, b, texts_a, texts_b = (c.to_pylist() for c in batch.columns)
        keep = []
        for key, one, other in zip(b, texts_a, texts_b, strict=True):
            if key != known:
                known, held = key, shingle_set(unpack(other))
            keep.append(similar(shingle_set(unpack(one)), held))
        kept = [[x for x, k in zip(c, keep, strict=True) if k] for c in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in kept], names=["a", "b"])


def fingerprint_links(sets: DataFrame) -> DataFrame:
    """(a, b) keys of sets whose fingerprints are equal or linked within REACH bits."""
    prints = materialize(sets.groupBy("fp").agg(F.min("key").alias("least")), "fingerprints")
    links = hamming_links(prints.select("fp"), REACH)
    ends = [prints.select(F.col("fp").alias(c), F.col("least").alias(f"key_{c}")) for c in "ab"]
    near = links.join(ends[0], "a").join(ends[1], "b").select("key_a", "key_b")
    same = sets.join(prints, "fp").select(F.col("key").alias("key_a"), F.col("least").alias("key_b"))
    return near.unionByName(same).where("key_a <> key_b").select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def similar_sets(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of the keys that have similar ones."""
    sets = found.groupBy("key").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.min("hash").alias("hash"), *[F.first(c).alias(c) for c in PARITIES])
    tokens = sets.select("key", "n", "prefix").mapInArrow(_token_rows, TOKEN)
    ordered = tokens.repartition("token").sortWithinPartitions("token")
    shared = materialize(ordered.mapInArrow(_shared_rows, f"{TOKEN}, before long"), "shared-shingles")
    neighbours = shared.where("before <> key").select(F.least("before", "key").alias("a"), F.greatest("before", "key").alias("b"))
    first = materialize(neighbours.unionByName(fingerprint_links(sets.select("key", "fp"))).distinct(), "first-pairs")
    wanted = first.select(F.explode(F.array("a", "b")).alias("key")).unionByName(shared.select("key")).distinct()
    rows = docs.select(F.xxhash64(utf8()).alias("hash"), utf8().alias("text")).mapInArrow(_packed_rows, "hash long, text binary")
    texts = materialize(rows.join(wanted.join(sets.select("key", "hash"), "key"), "hash").dropDuplicates(["hash"]).select("key", "text"), "candidates")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one, other = (texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")
        return materialize(both.mapInArrow(_similar_rows, "a long, b long"), name)

    def rooted(stars: DataFrame, more: DataFrame | None = None) -> DataFrame:
        own = shared.join(stars, shared.key == stars.node, "left").select("token", "key", "n", "at", F.coalesce("root", "key").alias("root"))
        own = own if more is None else own.join(more, "key").select(*own.columns, *PARITIES)
        return own.repartition("token").sortWithinPartitions("token", "n", "key")

    def linked(stars: DataFrame, links: DataFrame) -> DataFrame:
        return connected_components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))

    stars = materialize(connected_components(verified(first, "first-links")), "first-roots")
    again = materialize(rooted(stars).mapInArrow(_again_rows, "a long, b long").distinct().join(first, ["a", "b"], "left_anti"), "second-pairs")
    stars = materialize(linked(stars, verified(again, "second-links")), "second-roots")
    others = rooted(stars, sets.select("key", *PARITIES)).mapInArrow(_pair_rows, "a long, b long").distinct()
    return linked(stars, verified(others.join(first.unionByName(again), ["a", "b"], "left_anti"), "others"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one of smallest doc_id, with its own columns."""
    found = shingled(docs)
    roots = similar_sets(docs, found)
    rooted = found.join(roots, found.key == roots.node, "left").select("doc_id", "hash", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    gone = rooted.join(least, "root").where("doc_id <> least").select("doc_id", "hash").distinct()
    return without(docs, materialize(gone, "near-copies"))
