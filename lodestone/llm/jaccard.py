"""N-gram Jaccard self-join by rare-first prefix filtering, and its connected components.

A document's set holds the 64-bit hashes of its distinct word shingles. Shingles are ordered rare first (by counts of all
documents' shingles in a fixed number of buckets, then by hash: one total order for all). Two sets with Jaccard similarity
>= t share an element of their prefixes, the first n - ceil(t * n) + 1 elements, so candidates meet in prefix buckets.
They pass the length filter and the positional filter there; then, once per pair, the suffix filter, first over the sets'
outlines (counts in ranges of the order and parities) and again over the sets, and the exact count.

Documents with equal sets are one node. Links inside a group of near copies grow with the square of its size, but only
the classes are asked for, so pairs are compared until their class is certain:
1. in every bucket, each member is compared with the bucket's first members (`pivots`; the most typical ones first). A
   bucket of up to pivots + 1 members is covered in full that way;
2. of each larger bucket whose members are not in one class by then, every member outside its largest class is compared
   with every member of another class: first their sizes and outlines, then, where those leave room for a link, the sets.
   Two members of the largest class need no comparison, nor do buckets with the same members as another.
Each pair that shares a prefix element and is not known to be in one class is thus compared: no link between different
classes is lost, and there is no cap. Hot buckets are dealt to several tasks (`hot_rows` members each); the second step
compares across the parts, in blocks of sets of about one size, each with those of neighbouring sizes.

Defined cases: a null text, or one without words, has an empty set and links with nothing; with fewer words than the
shingle length the whole sequence is one shingle; rows with a null id are not nodes (they get the class of an equal set,
else null); repeated rows have equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCKS, blocks_batch, packed_blocks, pieces, saved, saved_alone, split_words, summed_arrays, tidy, to_bytes
from .graph import components
from .shards import batch_of

#: Buckets of shingle counts, entries of the filter of candidate ids, pivots of a bucket, members of a part, of a block.
COUNTS, FILTER, PIVOTS, HOT_ROWS, BLOCK_ROWS = 1 << 22, 1 << 22, 8, 100_000, 512
#: Ranges and (at least) parities of hash values that make a set's outline, and parts of a hot bucket at most.
OUTLINE, PARITY, PARTS = 64, 1024, 1 << 16
#: Members of a bucket that joins by bucket send to one task, about.
SLICE = 1024

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts, size: int = 4) -> Iterator[np.ndarray]:
    """Of every text of a column the sorted distinct hashes (uint64) of its word shingles, A-Z lower-cased."""
    codes, starts, distinct = split_words(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, to_bytes(distinct)), np.uint64, len(distinct))
    h = hashes[codes]
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        yield _shingles(h[a:b], size)


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    if not len(h):
        return h
    k = min(size, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _A + (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> np.uint64(32)))
    return np.unique(_spread(total))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall in each bucket."""

    @tidy
    def count(batches):
        total, some = np.zeros(COUNTS, np.int64), False
        for table in pieces(batches):
            sets = list(shingle_sets(table["text"], size))
            np.add.at(total, (np.concatenate(sets) % np.uint64(COUNTS)).astype(np.int64), 1)
            some = True
        if some:
            yield blocks_batch(list(packed_blocks(total)))

    return summed_arrays(docs.select("text").mapInArrow(count, BLOCKS), COUNTS)[0]


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def outline(hashes: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of OUTLINE equal ranges (255 at most), and parities of other bits: as many as
    the set has elements, rounded up to a power of two, PARITY at least. An outline is a fiftieth of a long set.

    The counts' differences, and the parities that differ, are each at most the Hamming distance of two sets. Where the
    numbers of parities differ, the longer ones are folded.
    """
    width = max(PARITY, 1 << (len(hashes) - 1).bit_length())
    counts = np.bincount((hashes >> np.uint64(64 - OUTLINE.bit_length() + 1)).astype(np.int64), minlength=OUTLINE)
    parity = np.bincount(((hashes >> np.uint64(20)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + np.packbits(parity.astype(np.uint8)).tobytes()


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bounds of the Hamming distances of sets with outlines of one length, row by row."""
    by_count = np.abs(x[..., :OUTLINE].astype(np.int16) - y[..., :OUTLINE].astype(np.int16)).sum(-1)
    return np.maximum(by_count, np.bitwise_count(x[..., OUTLINE:] ^ y[..., OUTLINE:]).sum(-1, dtype=np.int64))


def folded(lines: np.ndarray, length: int) -> np.ndarray:
    """Outlines (rows) cut down to a length: a shorter outline's parity is that of the places that fall together."""
    while lines.shape[1] > length:
        half = OUTLINE + (lines.shape[1] - OUTLINE) // 2
        lines = np.hstack([lines[:, :OUTLINE], lines[:, OUTLINE:half] ^ lines[:, half:]])
    return lines


def _stacked(lines: list[bytes], rows: np.ndarray, length: int) -> np.ndarray:
    """These rows' outlines, of one length, cut down to another."""
    return folded(np.frombuffer(b"".join([lines[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1), length)


_SETS = "doc_id long, n_shingles long, sig binary, score short, prefix array<long>, parts array<int>, outline binary"


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int, hot_rows: int) -> DataFrame:
    """Per document: set size, 128-bit signature of the set, how typical its prefix is, the prefix, the parts of its hot
    buckets (empty if there are none), and the set's outline."""
    counts = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)

    @tidy
    def prepare(batches):
        for table in pieces(batches):
            rows = []
            for doc_id, s in zip(table["doc_id"].to_pylist(), shingle_sets(table["text"], size)):
                if not len(s):
                    rows.append((doc_id, 0, None, 0, [], [], None))
                    continue
                often = counts[(s % np.uint64(COUNTS)).astype(np.int64)]
                p = _prefix_length(len(s), percent)
                some = np.argpartition(often, p - 1)[:p] if p < len(s) else np.arange(len(s))
                some = np.flatnonzero(often <= often[some].max())
                first = some[np.lexsort((s[some], often[some]))][:p]
                parts = np.minimum(often[first] // hot_rows + 1, PARTS)
                score = min(int(np.log2(1 + often[first].astype(np.float64)).mean() * 1000), 32767)
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), score, _signed(s[first]), parts if parts.max() > 1 else [], outline(s)))
            yield batch_of(rows, ["doc_id", "n_shingles", "sig", "score", "prefix", "parts", "outline"], [pa.int64(), pa.int64(), pa.binary(), pa.int16(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()])

    return docs.select("doc_id", "text").mapInArrow(prepare, _SETS)


def may_link(n: int, i: int, m: int, j: int, percent: int) -> bool:
    """Length filter, and positional filter for sets of n and m elements whose first common one stands at i and j."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    return (100 + percent) * (1 + min(n - i - 1, m - j - 1)) >= percent * (n + m)


_MEMBERS = "hot boolean, token long, part int, node long, n int, rank int, pivots array<long>"


def bucket_members(nodes: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Members of every prefix bucket with company, each with the earlier members among the bucket's first that it may link with.

    A row of the shuffle is short: the bucket (a hot token's low 16 bits make room for the part), the node, size and place.
    """
    parts = F.coalesce(F.try_element_at("parts", F.col("pos") + 1), F.lit(1))
    each = nodes.select("node", "n_shingles", "score", "parts", F.posexplode("prefix").alias("pos", "token")).withColumn("_p", parts)
    part = F.pmod(F.xxhash64("node"), F.col("_p").cast("long"))
    each = each.select(
        F.when(F.col("_p") > 1, F.col("token").bitwiseAND(F.lit(-PARTS)).bitwiseOR(part)).otherwise(F.col("token")).alias("key"),
        "node",
        F.shiftleft(F.col("n_shingles"), 32).bitwiseOR(F.col("pos").cast("long")).alias("place"),
        F.when(F.col("_p") > 1, -1 - F.col("score")).otherwise(F.col("score")).cast("short").alias("mark"),  # negative: hot
    )
    dealt = each.repartition(F.col("key")).sortWithinPartitions("key", F.desc(F.greatest(F.col("mark"), -1 - F.col("mark"))), "node")

    @tidy
    def stream(batches):
        key, first, waiting, rank = None, [], None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, node, place, mark = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "place", "mark"))
            hot = mark < 0
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            # Buckets of one member, inside the batch, have no company.
            lone = new & np.append(new[1:], False) & ~hot
            lone[0] = False
            rows = []
            for i in np.flatnonzero(~lone).tolist():
                k, h = int(keys[i]), bool(hot[i])
                me = (int(node[i]), int(place[i]) >> 32, int(place[i]) & 0xFFFFFFFF)
                named = (h, k & -PARTS, k & (PARTS - 1), me[0], me[1]) if h else (h, k, 0, me[0], me[1])
                if k != key:
                    key, first, rank, waiting = k, [], 0, None
                    if h:
                        rows.append((*named, 0, []))
                    else:
                        waiting = (*named, 0, [])
                else:
                    if waiting:
                        rows.append(waiting)
                        waiting = None
                    rank += 1
                    rows.append((*named, rank, [p[0] for p in first if may_link(me[1], me[2], p[1], p[2], percent)]))
                if len(first) < pivots:
                    first.append(me)
            yield batch_of(rows, ["hot", "token", "part", "node", "n", "rank", "pivots"], [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())])

    return dealt.mapInArrow(stream, _MEMBERS)


def _places(ids: np.ndarray) -> np.ndarray:
    h = _spread(ids.astype(np.int64).view(np.uint64) * _A)
    return np.concatenate([(h % np.uint64(FILTER)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER)).astype(np.int64)]).reshape(2, -1)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size that lets all these ids (first column) through, and others rarely while it is not full."""

    @tidy
    def mark(batches):
        seen, some = np.zeros(FILTER, np.uint8), False
        for b in batches:
            if b.num_rows:
                seen[_places(b.column(0).to_numpy(zero_copy_only=False)).ravel()] = 1
                some = True
        if some:
            yield blocks_batch(list(packed_blocks(seen)))

    return np.packbits(summed_arrays(ids.mapInArrow(mark, BLOCKS), FILTER)[0] > 0)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    where = _places(ids)
    return ((bits[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1).all(0)


def candidate_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, hashes (sorted, 8 bytes each) of these nodes, and of a few other documents that pass the filter."""
    bits = id_filter(nodes)

    @tidy
    def pick(batches):
        for table in pieces(batches):
            ids = np.array([x if x is not None else 0 for x in table["doc_id"].to_pylist()], np.int64)
            keep = passes(bits, ids) & ~np.asarray(table["doc_id"].is_null())
            chosen = table.filter(pa.array(keep))
            sets = [s.tobytes() for s in shingle_sets(chosen["text"], size)]
            yield pa.RecordBatch.from_arrays([chosen["doc_id"].combine_chunks(), pa.array(sets, pa.binary())], ["node", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(pick, "node long, hashes binary")


def outlines_fit(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' outlines leave room for a link: the suffix filter over all ranges of the order at once.

    The outlines' gap is at most the sets' Hamming distance.
    """

    @tidy
    def check(batches):
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            n, m = (np.asarray(b.column(c)) for c in ("n", "m"))
            most = n + m - 2 * -(-percent * (n + m) // (100 + percent))
            keep = np.zeros(len(x), bool)
            lengths = np.array([(len(p), len(q)) for p, q in zip(x, y)]).reshape(-1, 2)
            for p, q in np.unique(lengths, axis=0).tolist():
                rows = np.flatnonzero((lengths == (p, q)).all(1))
                keep[rows] = gaps(_stacked(x, rows, min(p, q)), _stacked(y, rows, min(p, q))) <= most[rows]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side, line, n: nodes.select(F.col("node").alias(side), F.col("outline").alias(line), F.col("n_shingles").alias(n))
    return pairs.join(of("a", "x", "n"), "a").join(of("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m").mapInArrow(check, "a long, b long")


def _hamming_floor(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """A lower bound of the sets' Hamming distance: split both at the middle of y, take the parts' size differences."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = y[len(y) // 2]
    a, b = int(np.searchsorted(x, middle)), len(y) // 2
    hit = a < len(x) and x[a] == middle
    left = _hamming_floor(x[:a], y[:b], most, depth - 1)
    if left > most:
        return left
    return left + _hamming_floor(x[a + hit :], y[b + 1 :], most - left, depth - 1) + (not hit)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Suffix filter, then the exact count: percent * |union| <= 100 * |intersection|."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    most = len(x) + len(y) - 2 * need
    if _hamming_floor(x, y, most, 3) > most:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The pairs (a, b) that are links. A set is sent to each of its partners once, and the exact count is made there.

    Rows meet by partner b and part: b's set comes first in each part, so a task holds one set at a time however many
    partners b has.
    """
    per = pairs.groupBy("b").agg((F.count("*") / hot_rows).cast("int").alias("parts"))
    dealt = pairs.join(per, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("parts") + 1).cast("int").alias("part"), F.lit(1).alias("side"))
    own = per.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"), F.lit(0).alias("side"))
    sent = sets.join(dealt.unionByName(own), "node").select("b", "part", "side", "node", "hashes")
    met = sent.repartition("b", "part").sortWithinPartitions("b", "part", "side", "node")

    @tidy
    def check(batches):
        at, mine = None, []
        for batch in batches:
            found = []
            for b, part, side, node, hashes in zip(*(batch.column(c).to_pylist() for c in ("b", "part", "side", "node", "hashes"))):
                if (b, part) != at:
                    at, mine = (b, part), []
                x = np.frombuffer(hashes, np.uint64)
                if side == 0:
                    mine.append(x)
                elif any(similar(x, y, percent) for y in mine):
                    found.append((node, b))
            yield batch_of(found, ["a", "b"], [pa.int64(), pa.int64()])

    return met.mapInArrow(check, "a long, b long")


def _block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    side = np.asarray(table["side"])
    nodes, comps = np.asarray(table["node"]), np.asarray(table["comp"])
    sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    v = np.flatnonzero(side == 1)
    if not len(v):
        return []
    flat, owner = np.concatenate([sets[i] for i in v]), np.repeat(np.arange(len(v)), [len(sets[i]) for i in v])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes, v_comp, v_node = np.array([len(sets[i]) for i in v]), comps[v], nodes[v]
    out = []
    for u in np.flatnonzero(side == 0):
        a, b = np.searchsorted(flat, sets[u], "left"), np.searchsorted(flat, sets[u], "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(v))
        hit = (100 * both >= percent * (sizes + len(sets[u]) - both)) & (v_comp != comps[u])
        done = set()
        for k in np.flatnonzero(hit).tolist():
            if v_comp[k] not in done:  # one link to a class is enough
                done.add(v_comp[k])
                out.append((int(nodes[u]), int(v_node[k])))
    return out


def open_buckets(members: DataFrame, labels: DataFrame, pivots: int, percent: int) -> DataFrame:
    """The members of buckets that the first step did not cover in full and whose members are not in one class, as counted
    gives them.

    A bucket's members meet what is known of it by slice (SLICE members of a part), so that no task gets a whole hot bucket.
    """
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("g")]
    parts = saved(members.groupBy("hot", "token", "part").agg(F.max("rank").alias("r"), *same).filter((F.col("r") > pivots) | F.col("hot")), "jaccard-parts")
    wide = parts.groupBy("hot", "token").agg(F.max("r").alias("r"), F.max("part").alias("p"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("g").alias("g"))
    wide = wide.filter((F.col("r") > pivots) | (F.col("p") > 0))
    # Shingles that the same documents share make equal buckets: one of them is enough.
    wide = wide.groupBy("x", "y", "g").agg(F.min(F.struct("hot", "token")).alias("t")).select("t.hot", "t.token")
    slice_of = lambda rank: F.shiftleft(F.col("part").cast("long"), 32) + F.floor(rank / SLICE)
    slices = parts.join(wide, ["hot", "token"]).select("hot", "token", F.explode(F.sequence(slice_of(F.lit(0)), slice_of(F.col("r")))).alias("slice"))
    named = members.select("hot", "token", slice_of(F.col("rank")).alias("slice"), "node", "n").join(slices, ["hot", "token", "slice"], "left_semi")
    named = named.join(labels, "node", "left").select("hot", "token", "slice", "node", size_class(F.col("n"), percent).alias("size"), F.coalesce("comp", "node").alias("comp"))
    return saved(counted(saved(named, "jaccard-named")), "jaccard-open")


def size_class(n: Column, percent: int) -> Column:
    """Sets that link are of one class or of neighbouring ones: a class reaches over a factor of 100 / percent and more."""
    return F.floor(F.log(n) / math.log(100.001 / percent)).cast("int")


def _in_blocks(open_: DataFrame, block_rows: int) -> DataFrame:
    """The members outside a bucket's largest class (side 0) against all (side 1) of neighbouring sizes, dealt in blocks of
    members of one size class each."""
    blocks = lambda c: F.ceil(c / block_rows).cast("int")
    mine = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    near = lambda side: F.filter("sizes", lambda x: (F.abs(x["size"] - F.col("size")) <= 1) & (x[side] > 0))
    each = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    own = F.filter("sizes", lambda x: x["size"] == F.col("size"))[0]
    to = lambda side, other: F.explode(F.flatten(F.transform(near(other), lambda x: F.transform(each(x[other]), lambda b: F.struct(x["size"].alias("size"), b.alias("block"))))))
    row = ["slice", "node", "comp"]
    u = open_.filter("comp <> top").select("hot", "token", "size", mine(own["u"]).alias("ub"), to("u", "g").alias("to"), *row)
    u = u.select("hot", "token", F.col("size").alias("us"), F.col("to.size").alias("vs"), "ub", F.col("to.block").alias("vb"), F.lit(0).alias("side"), F.col("size"), *row)
    v = open_.select("hot", "token", "size", mine(own["g"]).alias("vb"), to("g", "u").alias("to"), *row)
    v = v.select("hot", "token", F.col("to.size").alias("us"), F.col("size").alias("vs"), F.col("to.block").alias("ub"), "vb", F.lit(1).alias("side"), F.col("size"), *row)
    return u.unionByName(v)


_BLOCK = ["hot", "token", "us", "vs", "ub", "vb"]


def _blocks(batches):
    """Whole blocks of a stream of rows sorted by block."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = [np.asarray(t[c].cast(pa.int64()) if c != "hot" else t[c].cast(pa.int8())) for c in _BLOCK]
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        if held and any(held[-1][c][-1].as_py() != t[c][0].as_py() for c in _BLOCK):
            yield pa.concat_tables(held)
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), t.num_rows]
        for i, (x, y) in enumerate(zip(edges, edges[1:])):
            held.append(t.slice(x, y - x))
            if i < len(edges) - 2:
                yield pa.concat_tables(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_tables(held)


def partners(table: pa.Table, percent: int) -> np.ndarray:
    """Which rows of a block have a partner of the other side and another class that sizes and outlines leave room for."""
    side, comps, n = (np.asarray(table[c]) for c in ("side", "comp", "n"))
    lines = table["outline"].to_pylist()
    lengths = np.array([len(x) for x in lines])
    # Per length the outlines of that length and, folded, the longer ones.
    stacks, place = {}, {}
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths >= length)
        stacks[length] = np.vstack([_stacked(lines, rows[lengths[rows] == x], length) for x in np.unique(lengths[rows])])
        order = np.concatenate([rows[lengths[rows] == x] for x in np.unique(lengths[rows])])
        place[length] = np.zeros(len(lines), np.int64)
        place[length][order] = np.arange(len(order))
    us, vs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    vs = vs[np.argsort(n[vs], kind="stable")]
    found, sizes = np.zeros(table.num_rows, bool), n[vs]
    for u in us:
        a, b = np.searchsorted(sizes, -(-percent * n[u] // 100), "left"), np.searchsorted(sizes, 100 * n[u] // percent, "right")
        near = vs[a:b]
        near = near[comps[near] != comps[u]]
        if not len(near):
            continue
        most = n[u] + n[near] - 2 * -(-percent * (n[u] + n[near]) // (100 + percent))
        both = np.minimum(lengths[near], lengths[u])
        fits = np.zeros(len(near), bool)
        for length in np.unique(both).tolist():
            some, at = both == length, place[length]
            fits[some] = gaps(stacks[length][at[near[some]]], stacks[length][at[u]]) <= most[some]
        found[near[fits]] = True
        found[u] |= bool(fits.any())
    return found


def with_partners(open_: DataFrame, outlines: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """hot, token, slice, node, size, comp of the members that may have a link to another class. Members of buckets that only
    share a passage have none, so their sets are never sent."""

    @tidy
    def run(batches):
        for table in _blocks(batches):
            keep = table.filter(pa.array(partners(table, percent)))
            if keep.num_rows:
                yield from keep.select(["hot", "token", "slice", "node", "size", "comp"]).combine_chunks().to_batches()

    rows = _in_blocks(open_, block_rows).join(outlines.select("node", "outline", F.col("n_shingles").alias("n")), "node")
    dealt = rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    return dealt.mapInArrow(run, "hot boolean, token long, slice long, node long, size int, comp long").distinct()


def counted(named: DataFrame) -> DataFrame:
    """hot, token, slice, node, size, comp, top, sizes: members of buckets with several classes, with the largest class and,
    for every size class, its members (g) and those of them outside the largest class (u)."""
    counts = saved(named.groupBy("hot", "token", "comp", "size").agg(F.count("*").alias("c")), "jaccard-counts")
    classes = counts.groupBy("hot", "token", "comp").agg(F.sum("c").alias("c")).groupBy("hot", "token").agg(F.sum("c").alias("g"), F.max(F.struct("c", "comp")).alias("t"))
    still = classes.filter(F.col("g") > F.col("t.c")).select("hot", "token", F.col("t.comp").alias("top"))
    of_top = counts.join(still.withColumnRenamed("top", "comp"), ["hot", "token", "comp"]).select("hot", "token", "size", F.col("c").alias("t"))
    by_size = counts.groupBy("hot", "token", "size").agg(F.sum("c").alias("g")).join(of_top, ["hot", "token", "size"], "left").withColumn("u", F.col("g") - F.coalesce("t", F.lit(0)))
    sizes = still.join(by_size, ["hot", "token"]).groupBy("hot", "token", "top").agg(F.sort_array(F.collect_list(F.struct("size", "g", "u"))).alias("sizes"))
    # Members meet what is known of their bucket by slice.
    known = named.select("hot", "token", "slice").distinct().join(sizes, ["hot", "token"])
    return named.join(known, ["hot", "token", "slice"])


def remaining_links(open_: DataFrame, sets: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links between classes of the open buckets, in blocks of members: those outside the largest class against all."""

    @tidy
    def run(batches):
        for table in _blocks(batches):
            yield batch_of(_block_links(table, percent), ["a", "b"], [pa.int64(), pa.int64()])

    rows = _in_blocks(open_, block_rows).select(*_BLOCK, "side", "node", "comp").join(sets, "node")
    return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(run, "a long, b long")


def _nodes(sets: DataFrame) -> DataFrame:
    """One row per distinct set: that of the least id. Only sets that may have copies are shuffled with their prefixes."""
    named = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    copies = saved(named.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).filter("c > 1").select("sig", "least"), "jaccard-copies")
    bits = id_filter(copies.select(_sig_number("sig")))

    @F.pandas_udf("boolean")
    def may_be(ids):
        import pandas as pd

        return pd.Series(passes(bits, ids.to_numpy(np.int64)))

    marked = named.withColumn("_may", may_be(_sig_number("sig")))
    columns = [F.col("doc_id").alias("node"), "n_shingles", "score", "prefix", "parts", "outline"]
    several = marked.filter("_may").join(copies, "sig", "left").filter("least IS NULL OR least = doc_id").select(*columns).dropDuplicates(["node", "n_shingles", "outline"])
    return marked.filter("NOT _may").select(*columns).unionByName(several)


def _sig_number(column: str):
    return F.conv(F.hex(F.substring(column, 1, 7)), 16, 10).cast("long")


def _classes(docs: DataFrame, sets: DataFrame, size: int, percent: int, pivots: int, hot_rows: int) -> DataFrame:
    """sig, comp: the class of every distinct set."""
    members = saved(bucket_members(_nodes(sets), percent, pivots), "jaccard-members")
    pairs = members.select(F.col("node").alias("a"), F.explode("pivots").alias("b")).filter("a <> b").distinct()
    outlines = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "outline", "n_shingles").distinct()
    pairs = saved(outlines_fit(pairs, outlines, percent).distinct(), "jaccard-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links = saved(verified(pairs, candidate_sets(docs, wanted, size), percent, hot_rows), "jaccard-links")
    labels = components(links)
    open_ = open_buckets(members, labels, pivots, percent)
    open_ = saved(counted(saved(with_partners(open_, outlines, percent), "jaccard-partners")), "jaccard-blocks")
    if not open_.isEmpty():
        more = remaining_links(open_, candidate_sets(docs, open_.select("node"), size), percent)
        known = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        for side in ("a", "b"):
            more = more.join(known, more[side] == known["_n"], "left").withColumn(side, F.coalesce("_c", side)).drop("_n", "_c")
        upper = components(saved(more.filter("a <> b").distinct(), "jaccard-more"))
        upper = upper.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        lone = upper.select(F.col("_n").alias("node"), F.col("_n").alias("comp")).join(labels, "node", "left_anti")
        labels = labels.unionByName(lone).join(upper, F.col("comp") == F.col("_n"), "left").select("node", F.coalesce("_c", "comp").alias("comp"))
    least = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("node"))
    return least.join(labels, "node", "left").select("sig", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85, pivots: int = PIVOTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    sets = saved(prefixes(docs, shingle_counts(docs, size), size, percent, hot_rows), "jaccard-sets")
    classes = saved_alone(docs.sparkSession, "jaccard-classes", lambda: _classes(docs, sets, size, percent, pivots, hot_rows))
    return sets.select("doc_id", "n_shingles", "sig").join(classes, "sig", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stays per class: the one with the least id. Rows with a null id stay.

    Only rows that may be concerned are shuffled with their texts: the others pass a filter of fixed size.
    """
    found = saved_alone(docs.sparkSession, "dedup-classes", lambda: near_duplicates(docs, size, percent)).filter("doc_id IS NOT NULL")
    concerned = found.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("component_id").alias("least")).filter("c > 1 OR least < doc_id")
    concerned = saved(concerned.select("doc_id", (F.col("least") == F.col("doc_id")).alias("stays")), "dedup-concerned")
    bits = id_filter(concerned.select("doc_id"))

    @F.pandas_udf("boolean")
    def may_be(ids):
        import pandas as pd

        return pd.Series(passes(bits, ids.fillna(0).to_numpy(np.int64)) & ids.notna().to_numpy())

    # The caller's columns travel in a struct, so that none of their names can clash.
    marked = docs.select(F.struct("*").alias("row"), "doc_id").withColumn("may", may_be("doc_id"))
    maybe = marked.filter("may").join(concerned, "doc_id", "left")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    maybe = maybe.withColumn("nth", first).filter("stays IS NULL OR (stays AND nth = 1)")
    return marked.filter("NOT may").select("row.*").union(maybe.select("row.*"))
