"""Pairs of records whose bags of words overlap beyond a threshold: a blocked sparse matrix product.

Rows of the matrix are the distinct bags, columns are n-grams of their elements (an element is a word with its
occurrence number) in rising order of document frequency. An n-gram grows until its expected number of documents
falls to ``list_length``; each bag takes part only in the n-grams of the prefix that the size bounds leave, which
loses no pair (see ``_postings``). Columns that stay dense are cut into tiles. Columns are cut into blocks; the product
of a block is expanded in slices, a pair is discarded at once if sizes or parities of the bags exclude the threshold,
and the columns that the others share are counted. The counts of all blocks are added up, and a pair below the
count that its sizes ask for is discarded: one n-gram, or for bags so long that columns are single elements
``least_met`` of those in the prefixes. What is left gets the rest of its overlap from the bags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.storage import materialize, skew_join


@dataclass(frozen=True)
class Overlap:
    """Parameters: a pair counts if shared elements / elements of either >= threshold."""

    threshold: float = 0.75
    list_length: float = 800.0  # expected documents of an n-gram at which it grows no further
    block_postings: int = 500_000
    slice_pairs: int = 1_000_000  # pairs expanded at once
    tile_documents: int = 20_000  # expected documents of a column from which it is cut into tiles
    least_met: int = 3  # elements that the prefixes of two long bags must share
    class_chunk: int = 500  # members of a class that meet those of another in one group


#: Buckets of the document-frequency table, which is broadcast (8 MB at most).
DF_BUCKETS = 1 << 20
#: Most elements of an n-gram for bags up to a size; longer bags get shorter n-grams.
LONG = 256
_DEPTHS = ((64, 4), (LONG, 2), (1 << 62, 1))
_FLUSH = 60_000


def _depth(n: int) -> int:
    return next(d for most, d in _DEPTHS if n <= most)


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes of an element: two different ones of a pair of bags of a hundred are equal once in 10 ** 10 pairs.
ELEMENT_BYTES = 6


def _packed(elements: np.ndarray) -> bytes:
    return np.ascontiguousarray(elements.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ELEMENT_BYTES]).tobytes()


def _unpacked(bags: list[bytes]) -> np.ndarray:
    """All elements of some bags, one after another."""
    raw = np.frombuffer(b"".join(bags), np.uint8).reshape(-1, ELEMENT_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :ELEMENT_BYTES] = raw
    return out.view("<u8").ravel()


def _short(bags: list[bytes]) -> np.ndarray:
    """The upper 32 bits of all elements, which columns are made of: equal elements stay equal, so no pair is lost."""
    return (_unpacked(bags) >> np.uint64(8 * ELEMENT_BYTES - 32)).astype(np.uint32)


def _bags(split: Callable[[str], list[str]]):
    """Text to its bag: 128-bit hash and sorted elements of ELEMENT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            size, flat = [], []
            for text in b.column("text").to_pylist():
                found = split(text)
                size.append(len(found))
                for w in found:
                    h = known.get(w)
                    if h is None:
                        if len(known) > 500_000:
                            known.clear()
                        h = known[w] = xxhash.xxh3_64_intdigest(w)
                    flat.append(h)
            size = np.array(size, np.int64)
            word, doc = np.array(flat, np.uint64), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((word, doc))
            word, end = word[order], np.cumsum(size)
            new = np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])][: len(word)]
            at = np.arange(len(word))
            times = at - np.maximum.accumulate(np.where(new, at, 0)) if len(word) else at
            element = _mix(word + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 8 * ELEMENT_BYTES)
            element = element[np.lexsort((element, doc))]
            h1, h2, bag = [], [], []
            words, elements = word.tobytes(), _packed(element)
            for s, e in zip((end - size).tolist(), end.tolist()):
                x = xxhash.xxh3_128_intdigest(words[8 * s : 8 * e])
                h1.append((x >> 64) - (1 << 63))
                h2.append((x & ((1 << 64) - 1)) - (1 << 63))
                bag.append(elements[ELEMENT_BYTES * s : ELEMENT_BYTES * e])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bag, pa.binary())], names=["id", "h1", "h2", "bag"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(DF_BUCKETS, np.int64)
    for b in batches:
        element = _short(b.column("bag").to_pylist())
        count += np.bincount(element & np.uint32(DF_BUCKETS - 1), minlength=DF_BUCKETS)
    at = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(count[at])], names=["bucket", "n"])


def _postings(bags: np.ndarray, size: np.ndarray, p: np.ndarray, larger: bool, rules: Overlap, least_p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, bag, expected share of documents) incidences of bags in the role of the smaller or the larger one of a pair.

    bags: elements in rising frequency, [bag, position], p: their shares of documents (1 where there is none).
    Of a pair at the threshold either bag lacks at most ``miss`` of its elements, so the k-th shared element stands
    at position miss + k at most. The n-gram of the first shared elements ends as soon as its expected list is
    short enough; each element at its place is at least as rare as the bag's own one at position miss + k, so it
    ends within the prefix of both bags.
    """
    t = rules.threshold
    need = _ceil(size * t) if larger else _ceil(size * (2 * t / (1 + t)))
    miss = size - need
    smallest = _ceil(size * t) if larger else size
    grams, docs, weights = [], [], []
    for depth in sorted({d for _, d in _DEPTHS}):
        own = np.array([depth in {_depth(a), _depth(b)} for a, b in zip(smallest.tolist(), size.tolist())], bool)
        own = own & (size > 0)
        if not own.any():
            continue
        who = np.flatnonzero(own)
        width = bags.shape[1]
        # elements that the n-gram needs beyond the missing ones
        extra = np.zeros(len(who), np.int64)
        product = np.ones(len(who))
        for k in range(depth):
            more = ((product > least_p) | (k == 0)) & (miss[who] + extra < size[who])
            at = np.minimum(miss[who] + extra, width - 1)
            product = np.where(more, product * p[who, at], product)
            extra += more
        if depth == 1:
            extra = np.minimum(rules.least_met, need[who])
        prefix = np.minimum(miss[who] + extra, size[who])
        doc = np.repeat(who, prefix)
        pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        end = np.repeat(prefix, prefix)
        gram = _mix(bags[doc, pos].astype(np.uint64) + np.uint64(depth << 40))
        weight = p[doc, pos]
        for k in range(1, depth + 1):
            done = (weight <= least_p) | (k == depth)
            done |= need[doc] <= k if k < depth else False  # bags too small to reach the end
            grams.append(gram[done])
            docs.append(doc[done])
            weights.append(weight[done])
            grow = (weight > least_p) & (pos + 1 < end) if k < depth else np.zeros(len(doc), bool)
            if not grow.any():
                break
            doc, pos, end, gram, weight = doc[grow], pos[grow], end[grow], gram[grow], weight[grow]
            n = end - pos - 1
            start = np.repeat(np.cumsum(n) - n, n)
            nxt = np.repeat(pos, n) + 1 + np.arange(n.sum()) - start
            doc, end, gram, weight = np.repeat(doc, n), np.repeat(end, n), np.repeat(gram, n), np.repeat(weight, n)
            gram = _mix(gram * np.uint64(31) + bags[doc, nxt].astype(np.uint64))
            weight, pos = weight * p[doc, nxt], nxt
    if not grams:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(grams), np.concatenate(docs), np.concatenate(weights)


def _tiled(gram: np.ndarray, doc: np.ndarray, tiles: np.ndarray, larger: bool, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that stay dense at their full length, cut into tiles that go to blocks of their own.

    In the smaller role a bag takes part in one tile, in the larger role in all, so that a pair meets in just one.
    """
    dense = tiles > 1
    if not dense.any():
        return gram, doc
    g, d, n = gram[dense], doc[dense], tiles[dense]
    if larger:
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g, d = np.repeat(g, n), np.repeat(d, n)
    else:
        at = (own[d] % n.astype(np.uint64)).astype(np.int64)
    return np.concatenate([gram[~dense], _mix(g ^ _mix(at.astype(np.uint64) + np.uint64(1)))]), np.concatenate([doc[~dense], d])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _incidence(rules: Overlap, blocks: int, n_docs: int, frequency):
    """Bags to rows (block, packed bags and postings)."""
    least_p = rules.list_length / max(1, n_docs)

    def flush(ids: list[np.ndarray], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        df = frequency.value
        size = np.array([len(x) // ELEMENT_BYTES for x in raw], np.int64)
        sketch, own = np.zeros(len(raw), np.uint64), _mix(np.concatenate(ids).view(np.uint64))
        docs, grams, roles = [], [], []
        order = np.argsort(size, kind="stable")
        # bags of like size together, so that a long one doesn't widen the matrix of the others
        for part in np.split(order, np.flatnonzero(np.diff(np.ceil(np.log2(size[order] + 1)))) + 1):
            for s in range(0, len(part), 4000):
                who = part[s : s + 4000]
                width = max(1, int(size[who].max()))
                bags = np.zeros((len(who), width), np.uint64)
                mask = np.arange(width) < size[who][:, None]
                element = _short([raw[i] for i in who.tolist()])
                bags[mask] = (df[element & np.uint32(DF_BUCKETS - 1)].astype(np.uint64) << np.uint64(32)) | element
                bits = np.where(mask, np.uint64(1) << ((bags ^ (bags >> np.uint64(6))) & np.uint64(63)), np.uint64(0))
                sketch[who] = np.bitwise_xor.reduce(bits, axis=1)
                bags[~mask] = np.uint64((1 << 64) - 1)
                bags.sort(axis=1)
                p = np.where(mask, (bags >> np.uint64(32)).astype(float) / max(1, n_docs), 1.0)
                bags &= np.uint64(0xFFFFFFFF)
                for role in (0, 1):
                    g, d, w = _postings(bags, size[who], np.minimum(p, 1.0), bool(role), rules, least_p)
                    g, d = _tiled(g, d, np.ceil(w * n_docs / rules.tile_documents).astype(np.int64), bool(role), own[who])
                    docs.append(who[d])
                    grams.append(g)
                    roles.append(np.full(len(g), role, np.uint8))
        gram, doc, role = np.concatenate(grams), np.concatenate(docs), np.concatenate(roles)
        block, gram = (gram % np.uint64(blocks)).astype(np.int32), (gram >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((gram, role, block))
        gram, doc, role, block = gram[order], doc[order], role[order], block[order]
        ident = np.concatenate(ids)
        pack = zstandard.ZstdCompressor(level=1).compress
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        for k in range(blocks):
            s, e = int(cuts[k]), int(cuts[k + 1])
            if s == e:
                continue
            mid = s + int(np.searchsorted(role[s:e], 1))
            used, local = np.unique(doc[s:e], return_inverse=True)
            step = np.concatenate([np.diff(gram[a:b], prepend=np.uint32(0)) for a, b in ((s, mid), (mid, e))])
            cells = [pack(_planes(x)) for x in (ident[used], sketch[used], size[used].astype(np.uint32), step, local.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mid - s], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["block", "small", "id", "sketch", "size", "step", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, volume = [], [], 0
        for b in batches:
            ids.append(b.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
            raw += b.column("bag").to_pylist()
            volume += sum(map(len, raw[-b.num_rows :])) if b.num_rows else 0
            if volume >= _FLUSH * 200:
                yield from flush(ids, raw)
                ids, raw, volume = [], [], 0
        if raw:
            yield from flush(ids, raw)

    return run


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the counts of equal ones added up."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(count[order], start)


def _product(rules: Overlap):
    """Pairs of bags with the number of the block's columns in which they meet, but those that sizes or parities exclude."""
    t = rules.threshold

    def block(rows: list[dict]) -> Iterator[np.ndarray]:
        unpack = zstandard.ZstdDecompressor().decompress
        ids, sketches, sizes, parts, base = [], [], [], ([], []), 0
        for row in rows:
            ident, sketch, size, step, doc = (_unplanes(unpack(row[c]), kind) for c, kind in (("id", np.int64), ("sketch", np.uint64), ("size", np.uint32), ("step", np.uint32), ("doc", np.uint32)))
            for role, cut in ((0, slice(0, row["small"])), (1, slice(row["small"], None))):
                parts[role].append((np.cumsum(step[cut], dtype=np.uint32), doc[cut].astype(np.int64) + base))
            ids.append(ident)
            sketches.append(sketch)
            sizes.append(size.astype(np.int64))
            base += len(ident)
        ident, sketch, size = np.concatenate(ids), np.concatenate(sketches), np.concatenate(sizes)
        (sg, sd), (lg, ld) = ((np.concatenate([x[i] for x in p]) for i in (0, 1)) for p in parts)
        # columns in order, and within one the sizes
        key = lambda g, n: (g.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        big = key(lg, size[ld])
        order = np.argsort(big, kind="stable")
        big, ld = big[order], ld[order]
        order = np.argsort(sg, kind="stable")
        sg, sd = sg[order], sd[order]
        n = size[sd]
        lo = np.searchsorted(big, key(sg, n), "left")
        hi = np.searchsorted(big, key(sg, np.floor(n / t + 1e-9).astype(np.int64)), "right")
        count = np.maximum(hi - lo, 0)
        keep = count > 0
        sd, lo, count = sd[keep], lo[keep], count[keep]
        l_sketch, l_size = sketch[ld], size[ld]
        found, times, held = [], [], 0
        limits, total = [0], 0
        edges = np.cumsum(count)

        def pairs(key: np.ndarray, met: np.ndarray) -> np.ndarray:
            x, y = key // base, key % base
            return np.stack([ident[x], ident[y], met, np.where(size[x] > LONG, rules.least_met, 1)], 1)

        while limits[-1] < len(count):
            nxt = int(np.searchsorted(edges, total + rules.slice_pairs, "right"))
            nxt = max(nxt, limits[-1] + 1)
            limits.append(nxt)
            total = int(edges[nxt - 1])
        for s, e in zip(limits, limits[1:]):
            c = count[s:e]
            start = np.repeat(lo[s:e] - (np.cumsum(c) - c), c)
            b = start + np.arange(len(start))
            a = np.repeat(sd[s:e], c)
            differ = np.bitwise_count(sketch[a] ^ l_sketch[b])
            # |A| + |B| - 2 overlap of a pair at the threshold
            most = ((size[a] + l_size[b]) * ((1 - t) / (1 + t)) + 1e-9).astype(np.int64)
            ok = np.flatnonzero(differ <= most)
            x, y = a[ok], ld[b[ok]]
            ok = (x != y) & ((size[x] < size[y]) | (ident[x] < ident[y]))
            if ok.any():
                key = x[ok] * base + y[ok]
                key, met = _counted([key], [np.ones(len(key), np.int64)])
                found.append(key)
                times.append(met)
                held += len(key)
                if held > 2 * rules.slice_pairs:
                    key, met = _counted(found, times)
                    found, times, held = [key], [met], len(key)
                    if held > rules.slice_pairs:
                        yield pairs(key, met)
                        found, times, held = [], [], 0
        if found:
            yield pairs(*_counted(found, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after another."""
        held: list[dict] = []

        def done() -> Iterator[pa.RecordBatch]:
            for found in block(held) if held else ():
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in range(4)], names=["a", "b", "met", "least"])

        for b in batches:
            for row in b.to_pylist():
                if held and row["block"] != held[0]["block"]:
                    yield from done()
                    held = []
                held.append(row)
        yield from done()

    return run


def _exact(rules: Overlap):
    """Pairs whose overlap, counted on the bags, meets the threshold."""
    t = rules.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            left, right = b.column("bag_a").to_pylist(), b.column("bag_b").to_pylist()
            na, nb = (np.array([len(x) // ELEMENT_BYTES for x in side], np.int64) for side in (left, right))
            rows = np.arange(len(left))
            key, row = (np.concatenate(x) for x in zip(*((_unpacked(side), np.repeat(rows, n)) for side, n in ((left, na), (right, nb)))))
            key = _mix(key + _mix(row.astype(np.uint64) + np.uint64(1)))
            order = np.argsort(key)
            key = key[order]
            shared = np.bincount(row[order[1:][key[1:] == key[:-1]]], minlength=len(left))
            similarity = shared / np.maximum(na + nb - shared, 1)
            keep = pa.array(similarity >= t - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(similarity).filter(keep)], names=["a", "b", "similarity"])

    return run


def classes_and_links(rows: DataFrame, split: Callable[[str], list[str]], rules: Overlap = Overlap()) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row of ``rows(id bigint, text string)`` and (a, b, similarity) between representatives.

    Rows with equal bags form a class, whose representative is its smallest id; links join the representatives of
    classes whose similarity (sum of smaller by sum of larger counts) meets the threshold, each once. NULL texts
    and ids are left out; texts without any word form one class without links. No rows give two empty tables.
    """
    members, links, _ = _classes(rows, split, rules)
    return members.select("id", "rep"), links


def _classes(rows: DataFrame, split: Callable[[str], list[str]], rules: Overlap) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, rep), links (a, b, similarity), and classes (rep, copies)."""
    spark = rows.sparkSession
    rows = rows.filter("text is not null and id is not null").select(F.col("id").cast("bigint"), F.col("text").cast("string"))
    bags = materialize(rows.mapInArrow(_bags(split), "id bigint, h1 bigint, h2 bigint, bag binary"), "bags")
    groups = materialize(bags.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "groups")
    members = materialize(skew_join(bags.select("id", "h1", "h2"), groups, ["h1", "h2"], "copies", bags.count()).select("id", "rep"), "members")
    table = np.zeros(DF_BUCKETS, np.int64)
    for r in bags.select("bag").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # DF_BUCKETS rows at most
        table[r.bucket] = r.n
    n = members.count()
    blocks = max(1, -(-n * 32 // rules.block_postings))
    bag = materialize(bags.select("id", "bag").join(groups.select(F.col("rep").alias("id")), "id", "left_semi"), "heads")
    incidence = bag.mapInArrow(_incidence(rules, blocks, n, spark.sparkContext.broadcast(table)), "block int, small bigint, id binary, sketch binary, size binary, step binary, doc binary")
    met = incidence.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_product(rules), "a bigint, b bigint, met bigint, least bigint")
    pairs = materialize(met.groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("least").alias("least")).filter("met >= least").select("a", "b"), "pairs")
    left, right = bag.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), bag.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    full = pairs.join(left, "a").join(right, "b")
    return members, full.mapInArrow(_exact(rules), "a bigint, b bigint, similarity double"), groups.select("rep", "copies")


def expanded(rows: DataFrame, split: Callable[[str], list[str]], rules: Overlap = Overlap()) -> DataFrame:
    """All pairs of rows (id_a < id_b) of linked classes and within classes; rows as in ``classes_and_links``.

    Large classes are cut into chunks of about ``class_chunk`` members, and links into links of chunks, so that no
    task makes more than the pairs of two chunks for a link.
    """
    members, links, classes = _classes(rows, split, rules)
    links = materialize(links.select("a", "b"), "links")
    large = classes.filter(F.col("copies") > rules.class_chunk).select("rep", F.ceil(F.col("copies") / rules.class_chunk).cast("int").alias("chunks"))
    members = members.join(large, "rep", "left").select("id", "rep", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    pairs = links.unionByName(classes.filter("copies > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    for side in ("a", "b"):
        chunks = large.select(F.col("rep").alias(side), F.col("chunks"))
        pairs = pairs.join(chunks, side, "left").withColumn(f"c{side}", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    x = members.select(F.col("id").alias("x"), F.col("rep").alias("a"), F.col("chunk").alias("ca"))
    y = members.select(F.col("id").alias("y"), F.col("rep").alias("b"), F.col("chunk").alias("cb"))
    both = pairs.join(x, ["a", "ca"]).join(y, ["b", "cb"]).filter("a <> b or x < y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def class_of_each(rows: DataFrame, split: Callable[[str], list[str]], rules: Overlap = Overlap()) -> DataFrame:
    """(id, rep, n_links) of every row: its class and the class's number of links to other classes."""
    members, links, classes = _classes(rows, split, rules)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = materialize(classes.join(degree, "rep", "left").select("rep", "copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")), "classes")
    return skew_join(members, classes, ["rep"], "copies", members.count()).select("id", "rep", "n_links")
