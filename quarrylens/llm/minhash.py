"""N-gram Jaccard join by an LSH forest of MinHash signatures, with exact verification.

A document has a signature of bytes, one MinHash value each, in every tree of the forest; the forest is kept as a table
sorted by tree and signature, in which a trie's node is a run of rows with the same prefix. From the longest prefixes
on, documents that share a node gather in groups; pairs of different texts in a group are verified on the shingles
themselves, block against block, so no list of pairs is ever written. Then prefixes are shortened, and only groups that
have gained a member are looked at again, for the pairs that have not met before. From the verified similarities
follows how many links such prefixes miss; shortening ends when those are few enough, at the latest at a length that
finds any pair at the threshold with the wanted chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import map_batches, salted, staged, with_group
from .graphs import connected_components, nearest_stars
from .windows import U, mix, prefix_hashes, span_hashes, word_bounds, word_hashes

WORDS, THRESHOLD = 5, 0.8
TREES, RECALL = 40, 0.99999
#: Values by which prefixes are longer than the shortest, from the longest on.
LONGER = (6, 0)
#: Different texts in a block, and shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Bits of the map of wanted keys (8 MB when broadcast, whatever the corpus), and of one of its rows.
MAP_BITS, MAP_ROW = 1 << 26, 1 << 15


def chance(similarity: float | np.ndarray, depth: int, trees: int) -> float | np.ndarray:
    """The chance that two texts share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix (of at most 6 values) that finds a pair at the threshold with the chance ``recall``; 1 at least."""
    return max([d for d in range(1, 7) if chance(threshold, d, trees) >= recall], default=1)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted, and where each text's begin (and the end).

    A shorter text has one shingle, of all its words; a text without words has none.
    """
    data, offsets = repeats.text_buffers(texts)
    begin, end, bounds = word_bounds(data, offsets)
    symbols = word_hashes(data, begin, end)
    counts = np.diff(bounds)
    n = np.where(counts >= words, counts - (words - 1), np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + bounds[doc]
    hashes = span_hashes(prefix_hashes(symbols), at, np.minimum(at + words, bounds[doc + 1]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's signature in each tree, ``depth`` bytes and as many more as prefixes may be longer: the tree's number
    with the first bytes, and the rest. Texts have a shingle at least."""
    n, more = len(bounds) - 1, max(LONGER)
    heads, tails = np.zeros((n, trees), U), np.zeros((n, trees), U)
    factors = mix(np.arange(1, trees * (depth + more) + 1, dtype=U)) | U(1)
    at = 0
    while at < n:  # as many texts as stay in the processor's cache
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 16_384, side="right")) - 1)
        part, starts = hashes[bounds[at] : bounds[upto]], bounds[at:upto] - bounds[at]
        for t in range(trees):
            head, tail = np.full(upto - at, U(t)), np.zeros(upto - at, U)
            for k in range(depth + more):
                value = mix(np.minimum.reduceat(part * factors[t * (depth + more) + k], starts)) & U(0xFF)
                if k < depth:
                    head = (head << U(8)) | value
                else:
                    tail = (tail << U(8)) | value
            heads[at:upto, t], tails[at:upto, t] = head, tail
        at = upto
    return heads, tails


def signed_rows(rows: DataFrame, trees: int, depth: int, words: int, threshold: float) -> DataFrame:
    """Key, set identifier, number of shingles and signatures of every row.

    A set so small that no other can be as like as the threshold has none: two different sets of n or fewer shingles
    reach n / (n + 1) at most.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            hashes, bounds = shingles(part.column(1), words)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            total = np.zeros(len(sizes), U)
            if len(some):
                total[some] = np.add.reduceat(mix(hashes ^ U(0x5BD1E995)), bounds[:-1][some]) ^ mix(np.bitwise_xor.reduceat(hashes, bounds[:-1][some]))
            large = sizes / (sizes + 1.0) >= threshold - 1e-9
            kept = np.repeat(large, sizes)
            heads, tails = signatures(hashes[kept], np.r_[0, np.cumsum(sizes[large])], trees, depth)
            offsets = pa.array(np.r_[0, np.cumsum(np.where(large, trees, 0))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel().view(np.int64))) for x in (heads, tails)]
            parts.append(pa.RecordBatch.from_arrays([part.column(2), pa.array(mix(total ^ sizes.astype(U)).view(np.int64)), pa.array(sizes, pa.int64()), *lists], ["key", "set", "n", "heads", "tails"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return map_batches(rows, run, "key bigint, set bigint, n bigint, heads array<bigint>, tails array<bigint>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each pair of sets shares. Rare shingles are counted pair by pair, frequent ones by a product."""
    m = len(sets)
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    often = np.diff(np.r_[first, len(hashes)])
    rank = np.arange(len(hashes)) - np.repeat(first, often)
    each = np.repeat(often, often)
    out = np.zeros(m * m, np.float32)
    rare = each <= 24
    for step in range(1, 24):
        a = np.flatnonzero(rare & (rank + step < each))
        if not len(a):
            break
        out += np.bincount(owner[a] * m + owner[a + step], minlength=m * m).astype(np.float32)
    out = out.reshape(m, m)
    out = out + out.T
    frequent = np.flatnonzero(often > 24)
    number = np.full(len(first), -1)
    number[frequent] = np.arange(len(frequent))
    column = np.repeat(number, often)
    for low in range(0, len(frequent), 4096):
        there = (column >= low) & (column < low + 4096)
        grid = np.zeros((m, min(4096, len(frequent) - low)), np.float32)
        grid[owner[there], column[there] - low] = 1
        out += grid @ grid.T
    return out


def similarities(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The similarity of each pair of sets, exactly, where it reaches the threshold, else 0; no set is like itself."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = common_counts(sets).astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - shared
    out = np.where(shared >= threshold * union - 1e-9, shared / np.maximum(union, 1), 0.0)
    np.fill_diagonal(out, 0.0)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """The least index that each can reach."""
    label = np.arange(len(links))
    while True:
        near = np.minimum(label, np.where(links, label[None, :], len(label)).min(axis=1))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def likely_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` ``wanted`` has, and a few others, found by a map of bits of a fixed size.

    It keeps texts that no one asks for out of the shuffle; a join must follow. With more keys than bits the map fills
    up and lets most rows pass, but never loses one.
    """
    bit = F.pmod("key", F.lit(MAP_BITS))
    row, place = F.floor(bit / MAP_ROW).cast("int"), F.pmod(bit, F.lit(MAP_ROW))
    bits = wanted.select(row.alias("map_row"), place.alias("place")).groupBy("map_row").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (row == F.col("map_row")) & (F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)).select(*rows.columns)


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row a document: ``copy_of`` (the smallest id with the same shingles), ``n_copies``, ``n_links`` (different
    texts with a similarity of at least the threshold) and ``class_id`` (the smallest id reached over links and copies).

    Texts without words, null ones too, are copies of each other and linked with nothing. Null ids come last. Repeated
    rows repeat. A text of any length counts whole; one with fewer words than a shingle is one shingle.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    found = _classes(rows, words, threshold, trees, recall)
    return rows.select("id", "key").join(found, "key").select(F.col("id").alias(id_col), "copy_of", "n_copies", "n_links", "class_id")


def forest(one: DataFrame) -> DataFrame:
    """The tries' rows (``set``, ``head``, ``tail``) that share the shortest prefix with another set, sorted by signature.

    What shares no shortest prefix shares no longer one. A prefix of very many sets is a hot key of this join alone,
    whose other side has one row a prefix: adaptive execution splits it.
    """
    at = one.select("set", F.explode(F.arrays_zip("heads", "tails")).alias("x")).select("set", "x.heads", "x.tails")
    shared = at.groupBy(F.col("heads").alias("head")).agg(F.min("set").alias("_least"), F.max("set").alias("_most")).where("_least < _most").select("head")
    rows = at.join(shared, F.col("heads") == F.col("head")).select("set", "head", F.col("tails").alias("tail"))
    return staged(rows.sortWithinPartitions("head", "tail"))


def gathered(tries: DataFrame, longer: int) -> DataFrame:
    """``node`` (a set) and ``component`` of the sets that nodes of prefixes ``longer`` than the shortest join."""
    prefix = ["head", F.shiftright("tail", 8 * (max(LONGER) - longer)).alias("rest")]
    at = tries.select("set", *prefix) if longer else tries.select("set", "head", F.lit(0).cast("bigint").alias("rest"))
    nodes = at.groupBy("head", "rest").agg(F.min("set").alias("leader"), F.max("set").alias("_most")).where("leader < _most").select("head", "rest", "leader")
    return connected_components(nearest_stars(at.join(nodes, ["head", "rest"]).where("set <> leader").select(F.col("set").alias("a"), F.col("leader").alias("b"))))


def verified(rows: DataFrame, members: DataFrame, words: int, threshold: float, trees: int, depth: int) -> DataFrame:
    """The links of ``members``' sets with others of their group that they have not met before.

    ``members`` has set, key (of a row that has it), gathered (the group), before (the group so far) and n. Gives set,
    links (how many), root (the least set reached inside a block) and ``gaps``: for each of ``LONGER`` the links that
    prefixes of that length are expected to miss for those found.
    """
    members = with_group(members, ["gathered"], salted("set"), {"_k": F.count(F.lit(1)), "_s": F.sum("n")}, {"_many": F.sum("_k"), "_all": F.sum("_s")})
    blocks = F.greatest(F.ceil(F.col("_many") / BLOCK), F.ceil(F.col("_all") / BLOCK_SHINGLES)).cast("int")
    members = staged(members.select("set", "key", "gathered", "before", "n", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")))
    total = members.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    schema = "set bigint, links bigint, root bigint, gaps array<double>"
    if not total:  # no group has grown
        return rows.sparkSession.createDataFrame([], schema)
    dealt = likely_in(rows.select("key", "text"), members).join(members, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("set", "text", "gathered", "before", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    dealt = dealt.repartition(int(max(1, -(-total * 8 // (8 << 20)))), "gathered", "p", "q")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        tasks: dict[tuple, list[tuple]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                hashes, bounds = shingles(part.column("text"), words)
                names = ("set", "gathered", "before", "block", "p", "q")
                for i, (ident, group, before, block, p, q) in enumerate(zip(*(part.column(c).to_pylist() for c in names), strict=True)):
                    if (ident, p, q) not in seen:
                        seen.add((ident, p, q))
                        tasks.setdefault((group, p, q), []).append((ident, block, before, hashes[bounds[i] : bounds[i + 1]].copy()))
        out = []
        for (_, p, q), held in tasks.items():
            held.sort(key=lambda x: x[0])
            before = np.array([b for _, _, b, _ in held])
            alike = np.where(before[:, None] != before[None, :], similarities([h for *_, h in held], threshold), 0.0)
            root = roots(alike > 0)
            if p != q:  # pairs inside a block are counted where it meets itself
                block = np.array([b for _, b, *_ in held])
                alike[block[:, None] == block[None, :]] = 0.0
            count = (alike > 0).sum(axis=1)
            with np.errstate(divide="ignore"):
                gaps = np.stack([np.where(alike > 0, 1 / chance(alike, depth + m, trees) - 1, 0.0).sum(axis=1) for m in LONGER], axis=1)
            out += [(held[i][0], int(count[i]), held[r][0], gaps[i].tolist()) for i, r in enumerate(root.tolist()) if count[i] or r != i]
        if out:
            columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["set", "links", "root", "gaps"])

    return staged(dealt.mapInArrow(verify, schema))


def missed_share(checked: DataFrame, level: int) -> float:
    """Of a document's links, the share that prefixes of this level are expected to miss: the mean over documents."""
    each = checked.groupBy("set").agg(F.sum("links").alias("k"), F.sum(F.col("gaps")[level]).alias("g")).where("k > 0")
    share = each.agg(F.avg(F.col("g") / (F.col("k") + F.col("g")))).first()[0]
    return 1.0 if share is None else share


def _classes(rows: DataFrame, words: int, threshold: float, trees: int, recall: float) -> DataFrame:
    depth = shortest_prefix(trees, threshold, recall)
    signed = staged(signed_rows(rows, trees, depth, words, threshold))
    large = signed.where(F.size("heads") > 0).groupBy("set").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("heads").alias("heads"), F.first("tails").alias("tails"))
    large = staged(large)
    tries = forest(large)
    one = staged(tries.select("set").distinct().join(large.select("set", "key", "n"), "set").withColumn("before", F.col("set")))
    checked = None
    for level, longer in enumerate(LONGER):
        groups = gathered(tries, longer).select(F.col("node").alias("set"), F.col("component").alias("gathered"))
        one = staged(one.join(groups, "set", "left").select("set", "key", "n", "before", F.coalesce("gathered", "before").alias("gathered")))
        grown = with_group(one, ["gathered"], salted("set"), {"_a": F.min("before"), "_b": F.max("before")}, {"_a": F.min("_a"), "_b": F.max("_b")}).where("_a < _b")
        found = verified(rows, grown.select("set", "key", "gathered", "before", "n"), words, threshold, trees, depth)
        checked = found if checked is None else checked.union(found)
        if missed_share(checked, level) <= 1 - recall:
            break
        one = one.select("set", "key", "n", F.col("gathered").alias("before"))

    counts = checked.groupBy("set").agg(F.sum("links").alias("n_links"))
    classes = connected_components(checked.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set").withColumnRenamed("component", "class")

    ids = rows.select("key", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("id")).join(signed.select("key", "set").distinct(), "key")
    copies = ids.groupBy("set").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_copies"))
    sets = copies.join(counts, "set", "left").join(classes, "set", "left")
    sets = staged(sets.select("set", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "set").alias("class")))
    sets = with_group(sets, ["class"], salted("set"), {"_f": F.min("first")}, {"class_first": F.min("_f")})
    sets = staged(sets.select("set", F.col("first.id").alias("copy_of"), "n_copies", "n_links", F.col("class_first.id").alias("class_id"), F.col("class_first.key").alias("class_key")))
    return signed.select("key", "set").distinct().join(sets, "set").drop("set")  # a set of many copies is split as in graphs


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One document of each class (that with the smallest id), with its columns as they are; of repeated rows, one."""
    rows = repeats.keyed(docs, id_col, text_col)
    found = rows.select("key").join(_classes(rows, words, threshold, trees, recall), "key")
    stay = found.where("key = class_key").groupBy("key").agg(F.count(F.lit(1)).alias("same")).withColumnRenamed("key", "stays")
    kept = docs.select(F.struct(*docs.columns).alias("row"), repeats.row_key(id_col, text_col).alias("key")).join(stay, F.col("key") == F.col("stays"))
    return kept.where("same = 1").select("row.*").union(kept.where("same > 1").dropDuplicates(["key"]).select("row.*"))
