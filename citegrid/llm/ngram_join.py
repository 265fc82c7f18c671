"""N-gram Jaccard join: documents whose word-shingle sets overlap by a given share.

Exact, for any similarity t above one half. Steps:

1. Texts become sorted arrays of 64-bit shingle hashes. Documents with equal sets form
   a class; from here on only one representative per class is compared.
2. *Size bands.* Sets that link have sizes within a factor t, and differ in at most
   k = (1 - t) / (1 + t) * (|x| + |y|) shingles. Per band the shingle space is cut by
   hash into half as many tiles again as the largest k, so k differences leave most
   tiles whole. A set posts the hash of its k(x) + 1 largest tiles, by (size, hash); by
   the pigeonhole one of them is among those its partner posts. An empty tile, which
   strangers share, comes last in that order, and with so many tiles hardly any set
   needs one. A set posts to its own band and, if larger partners fall there, to the next.
3. Only representatives post, and they post twice: first as marks, a few bytes per tile
   in counters that show which hashes come up again, then the marked tiles themselves.
   Tiles that two different classes post are groups of candidates. Every member is
   compared with the smallest member of its groups: first by *hashed bitmaps*, whose
   bit counts bound the overlap from above, then by intersecting the sorted arrays.
4. Groups that these links do not connect are compared member by member in blocks of
   bounded size, by bitmaps, skipping pairs that are connected already. The possible
   pairs, each once, are checked as in 3; a block with many more of them than members
   returns its members instead, and a second pass over their sets returns the links
   that join its parts, not all pairs.
5. The links' connected components are the result.

Counts are combined before shuffling; the joins meet stored tables, so that a hot tile
is split by the adaptive skew join, and its member comparisons by the grid of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm import marks
from citegrid.llm.store import short_batches
from citegrid.llm.words import binary, mix, parts, rolling, word_hashes
from citegrid.operators.graph import components
from citegrid.session import Scratch

SHINGLE = 4
SIMILARITY = (85, 100)
LEAST_BITS, MOST_BITS = 256, 1 << 16
# Bytes of sets in one block of step 4, and rows of a list that may be broadcast.
BLOCK_BYTES = 1 << 20
# Pairs that a block may return per row before it returns its rows instead.
PAIRS_PER_ROW = 4
BROADCAST_ROWS = 1_000_000
# Rows of an output batch.
BATCH = 100_000


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles.

    Fewer words than ``width`` make one shingle of the whole sequence; no word, none.
    """
    for words in word_hashes(texts, fold=True):
        n = len(words)
        if n == 0:
            yield words
        elif n < width:
            yield mix(rolling(words, n) + np.uint64(n))
        else:
            yield np.unique(rolling(words, width))


def bands(similarity: tuple[int, int], most: int) -> list[tuple[int, int]]:
    """(largest set size, tiles) of each band until it holds ``most``; sizes double."""
    num, den = similarity
    out, top = [], 8
    while True:
        k = 2 * top * (den - num) // (den + num)
        out.append((top, k + k // 2 + 2))
        if top >= most:
            return out
        top *= 2


def _posts(shingles: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Hashes of the tiles that a set posts."""
    num, den = similarity
    n = len(shingles)
    largest = n * den // num
    levels = bands(similarity, largest)
    own = next(i for i, (top, _) in enumerate(levels) if top >= n)
    found = []
    for level in range(own, len(levels)):
        top, tiles = levels[level]
        if level > own and levels[level - 1][0] >= largest:
            break
        k = (n + min(largest, top)) * (den - num) // (den + num)
        tile = (mix(shingles) >> np.uint64(11)) % np.uint64(tiles)
        size = np.bincount(tile.astype(np.int64), minlength=tiles)
        order = np.argsort(tile, kind="stable")
        ends = np.cumsum(size)
        # The content of a tile as a sum of mixed values, with the band and the tile number.
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(shingles[order] ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=sums[1:])
        content = sums[ends] - sums[ends - size]
        key = mix(content + mix(np.arange(tiles, dtype=np.uint64) + np.uint64((level + 1) << 40)
                                + (size.astype(np.uint64) << np.uint64(20))))
        keep = min(tiles, k + 1)
        if keep < tiles:
            key = key[np.lexsort((key, size))[tiles - keep:]]
        found.append(key)
    return np.concatenate(found)


def _posted(batches, similarity: tuple[int, int], width: int, ours) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, doc ids) of the documents whose id is marked, some ``BATCH`` rows at a time."""
    for batch in parts(batches):
        batch = batch.filter(pa.array(marks.marked(ours, _id_hash(batch.column(0)))))
        keys, owners, rows = [], [], 0
        for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(binary(batch.column(1)), width)):
            if len(s):
                key = _posts(s, similarity)
                keys.append(key)
                owners.append(np.full(len(key), doc, np.int64))
                rows += len(key)
            if rows >= BATCH:
                yield np.concatenate(keys), np.concatenate(owners)
                keys, owners, rows = [], [], 0
        if rows:
            yield np.concatenate(keys), np.concatenate(owners)


def _id_hash(ids: pa.Array) -> np.ndarray:
    return mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _id_entries(places: int):
    """Entries that mark the ids of a table."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield marks.entries(_id_hash(batch.column(0)), np.ones(batch.num_rows, np.int64), places, 0)
    return run


def _tile_entries(similarity: tuple[int, int], width: int, ours, places: int, salts: int):
    """Entries that count how often a tile's hash is posted."""
    def run(batches):
        salt = TaskContext.get().partitionId() % salts
        held, n = [], 0
        for key, _ in _posted(batches, similarity, width, ours):
            held.append(key)
            n += len(key)
            if n >= 10 * BATCH:
                yield marks.entries(np.concatenate(held), np.ones(n, np.int64), places, salt)
                held, n = [], 0
        if n:
            yield marks.entries(np.concatenate(held), np.ones(n, np.int64), places, salt)
    return run


def _posting_rows(similarity: tuple[int, int], width: int, ours, shared):
    """(key, doc_id) of the tiles that may be posted twice."""
    def run(batches):
        for key, owner in _posted(batches, similarity, width, ours):
            keep = marks.marked(shared, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(owner[keep])], names=["key", "doc_id"])
    return run


def _class_rows(width: int):
    def run(batches):
        for batch in parts(batches):
            sizes, digests = [], []
            for s in shingle_sets(binary(batch.column(1)), width):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                names=["doc_id", "n_shingles", "class"])
    return run


def bitmap(shingles: np.ndarray) -> bytes:
    """Hashed bitmap of a set, of the first power of two from twice its size on."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(shingles)).bit_length()), MOST_BITS)
    flags = np.zeros(bits, bool)
    flags[(mix(shingles) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def fold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, larger ones folded to the size of the smallest."""
    least = min(map(len, maps))
    rows = []
    for m in maps:
        row = np.frombuffer(m, np.uint64)
        if len(m) > least:
            row = np.bitwise_or.reduce(row.reshape(-1, least // 8), axis=0)
        rows.append(row)
    return np.stack(rows)


def overlap_bound(n_x, bits_x: np.ndarray, n_y, bits_y: np.ndarray):
    """At most so many common shingles: each bit of one side alone is a shingle the other lacks."""
    only_x = np.bitwise_count(bits_x & ~bits_y).sum(axis=-1, dtype=np.int64)
    only_y = np.bitwise_count(bits_y & ~bits_x).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_x - only_x, n_y - only_y)


def _enough(common, total, similarity: tuple[int, int]):
    num, den = similarity
    return den * common >= num * (total - common)


def _linked(x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return _enough(common, len(x) + len(y), similarity)


def _set_rows(width: int):
    def run(batches):
        for batch in parts(batches):
            sets = list(shingle_sets(binary(batch.column(1)), width))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([bitmap(s) for s in sets], pa.binary())],
                names=["doc_id", "n", "shingles", "bits"])
    return run


def _possible_pairs(similarity: tuple[int, int]):
    """Pairs whose bitmaps allow a link."""
    def run(batches):
        for batch in parts(batches):
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keep = []
            for i, (n_x, x, n_y, y) in enumerate(zip(*(c[k].to_pylist() for k in ("n_x", "bits_x", "n_y", "bits_y")))):
                both = fold([x, y])
                if _enough(overlap_bound(n_x, both[0], n_y, both[1]), n_x + n_y, similarity):
                    keep.append(i)
            yield batch.select(["source", "target"]).take(pa.array(keep, pa.int64()))
    return run


def _linked_pairs(similarity: tuple[int, int]):
    """Pairs whose sets link."""
    def run(batches):
        for batch in parts(batches):
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keep = [i for i in range(batch.num_rows) if _linked(
                np.frombuffer(c["shingles_x"][i].as_py(), np.uint64),
                np.frombuffer(c["shingles_y"][i].as_py(), np.uint64), similarity)]
            yield batch.select(["source", "target"]).take(pa.array(keep, pa.int64()))
    return run


def _links(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int], scratch: Scratch, name: str) -> DataFrame:
    """The pairs that link: bitmaps first, so that few pairs bring their sets along."""
    def with_sides(rows: DataFrame, *columns: str) -> DataFrame:
        for at, suffix in (("target", "y"), ("source", "x")):
            rows = rows.join(sets.select(F.col("doc_id").alias(at), *[F.col(c).alias(f"{c}_{suffix}") for c in columns]), at)
        return rows

    schema = "source bigint, target bigint"
    possible = scratch.save(
        with_sides(pairs, "n", "bits").select("source", "target", "n_x", "bits_x", "n_y", "bits_y")
        .mapInArrow(_possible_pairs(similarity), schema).distinct(), f"possible-{name}")
    return scratch.save(
        with_sides(possible, "shingles").select("source", "target", "shingles_x", "shingles_y")
        .mapInArrow(_linked_pairs(similarity), schema).distinct(), name)


def _partners(n, side, part, bits, similarity) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of a block the later rows that it may link with and that lie in other parts.

    Sizes ascend, so partners of a row form one range after it; ``part`` may change meanwhile.
    """
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, n[i] * similarity[1] // similarity[0], side="right"))
        rest = np.arange(i + 1, max(end, i + 1))
        rest = rest[(part[rest] != part[i]) & ((side[rest] != side[i]) | (side[i] == 2))]
        if len(rest):
            rest = rest[_enough(overlap_bound(n[i], bits[i], n[rest], bits[rest]), n[i] + n[rest], similarity)]
        if len(rest):
            yield i, rest


def _block_arrays(table: pa.Table):
    table = table.sort_by([("n", "ascending"), ("doc_id", "ascending")])
    number = {r: i for i, r in enumerate(dict.fromkeys(table["root"].to_pylist()))}
    part = np.array([number[r] for r in table["root"].to_pylist()])
    return table, table["n"].to_numpy(), table["side"].to_numpy(), part, fold(table["bits"].to_pylist())


def _filter_block(similarity: tuple[int, int]):
    """Pairs of a block that may link and lie in different parts, by their bitmaps.

    A row per pair, with ``other``; but where pairs are many more than rows, the rows
    that are in any, without ``other``, so that what comes out follows what went in.
    """
    def run(table: pa.Table) -> pa.Table:
        table, n, side, part, bits = _block_arrays(table)
        keep = np.zeros(len(n), bool)
        first, second, many = [], [], 0
        for i, rest in _partners(n, side, part, bits, similarity):
            keep[i] = True
            keep[rest] = True
            many += len(rest)
            if many <= PAIRS_PER_ROW * len(n):
                first += [i] * len(rest)
                second += rest.tolist()
        columns = ["key", "lo", "hi", "side", "doc_id", "root", "n"]
        if many <= PAIRS_PER_ROW * len(n):
            out = table.take(pa.array(first, pa.int64())).select(columns)
            return out.append_column("other", table["doc_id"].take(pa.array(second, pa.int64())))
        out = table.filter(pa.array(keep)).select(columns)
        return out.append_column("other", pa.nulls(out.num_rows, pa.int64()))

    return run


def _compare_block(similarity: tuple[int, int]):
    """Links that join the parts of a block of two sides (``side`` 0, 1, or 2 for both)."""

    def run(table: pa.Table) -> pa.Table:
        table, n, side, part, bits = _block_arrays(table)
        ids, packed = table["doc_id"].to_pylist(), table["shingles"].to_pylist()
        found: list[tuple[int, int]] = []
        for i, rest in _partners(n, side, part, bits, similarity):
            x = np.frombuffer(packed[i], np.uint64)
            for j in rest.tolist():
                if part[j] != part[i] and _linked(x, np.frombuffer(packed[j], np.uint64), similarity):
                    found.append((ids[i], ids[j]))
                    part[part == part[j]] = part[i]
        return pa.table({"source": pa.array([a for a, _ in found], pa.int64()),
                         "target": pa.array([b for _, b in found], pa.int64())})

    return run


def _pick(rows: DataFrame, wanted: DataFrame, n: int, key: str) -> DataFrame:
    """Rows whose key is wanted; a list of at most ``BROADCAST_ROWS`` measured rows is broadcast."""
    return rows.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, key, "left_semi")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY,
                       scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row.

    Null or empty texts and texts of white space have no shingles, link with nothing
    and are their own component. Equal rows and equal texts share a component. Rows
    that repeat a ``doc_id`` are one document. A row without ``doc_id`` links with
    nothing and has a null component. An empty table gives an empty result. Further
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = scratch or Scratch(spark, "ngram-join")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    members, size = scratch.measure(
        texts.mapInArrow(_class_rows(shingle), "doc_id bigint, n_shingles bigint, class binary"), "members",
        F.sum("n_shingles").alias("shingles"))
    classes = scratch.save(
        members.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    reps, seen = scratch.measure(classes.select(F.col("rep").alias("doc_id")).distinct(), "reps", F.count(F.lit(1)).alias("rows"))

    # Marks let some copies through, which the exact list keeps out below.
    places = marks.places_for(16 * seen["rows"])
    ours = marks.mark(reps.mapInArrow(_id_entries(places), marks.ENTRIES), 1, places, marks.salts_for(seen["rows"]))
    num, den = similarity
    postings = 4 * (size["shingles"] or 0) * (den - num) // (den + num) + 4 * seen["rows"]
    places = marks.places_for(4 * postings)
    salts = marks.salts_for(postings)
    shared = marks.mark(usable.mapInArrow(
        _tile_entries(similarity, shingle, ours, places, salts), marks.ENTRIES), 2, places, salts)
    posted = usable.mapInArrow(_posting_rows(similarity, shingle, ours, shared), "key bigint, doc_id bigint")
    met = scratch.save(_pick(posted, reps, seen["rows"], "doc_id").distinct(), "met")
    groups = scratch.save(
        met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lead"),
                               F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"))
        .where("n > 1")
        # Groups with the same members are compared once.
        .groupBy("n", "lead", "who").agg(F.min("key").alias("key")), "groups")
    grouped, seen = scratch.measure(met.join(groups.select("key", "lead", "n"), "key"), "grouped",
                                    F.count(F.lit(1)).alias("rows"))
    scratch.drop("reps", "met")

    wanted, count = scratch.measure(grouped.select("doc_id").distinct(), "wanted", F.count(F.lit(1)).alias("rows"))
    sets = scratch.save(
        _pick(usable, wanted, count["rows"], "doc_id")
        .mapInArrow(_set_rows(shingle), "doc_id bigint, n bigint, shingles binary, bits binary")
        .dropDuplicates(["doc_id", "shingles"]) if seen["rows"] else
        spark.createDataFrame([], "doc_id bigint, n bigint, shingles binary, bits binary"), "sets")

    pairs = scratch.save(grouped.where("doc_id <> lead").select(
        F.col("lead").alias("source"), F.col("doc_id").alias("target")).distinct(), "pairs")
    links = _links(pairs, sets, similarity, scratch, "links")

    def joined(edges: DataFrame, name: str) -> DataFrame:
        found = components(edges.select(F.lit(0).alias("network"), "source", "target"))
        return scratch.save(found.select(F.col("id").alias("doc_id"), F.col("component").alias("root")), name)

    roots = joined(links, "roots")
    rooted = grouped.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    # Groups of two have been compared; larger ones matter if they are still in parts.
    apart = scratch.save(
        rooted.where("n > 2").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        .select("key"), "apart")
    rest = rooted.join(apart, "key", "left_semi").select("key", "doc_id", "root").join(
        sets.select("doc_id", "n"), "doc_id").distinct()
    size = scratch.save(rest.groupBy("key").agg((F.sum("n") * 8).alias("bytes")).withColumn(
        "blocks", F.ceil(F.col("bytes") / F.lit(block_bytes)).cast("int")).select("key", "blocks"), "size")
    dealt = rest.join(size, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    cells = dealt.select(
        "key", "doc_id", "root", "n", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
        .alias("side"), "doc_id", "root")
    block = ["key", "lo", "hi"]
    near, seen = scratch.measure(
        cells.join(sets.select("doc_id", "n", "bits"), "doc_id").groupBy(*block).applyInArrow(
            _filter_block(similarity),
            "key bigint, lo int, hi int, side int, doc_id bigint, root bigint, n bigint, other bigint"), "near",
        F.count(F.lit(1)).alias("rows"), F.count("other").alias("pairs"))
    every = roots
    if seen["rows"]:
        closer = near.where("other IS NOT NULL").select(
            F.least("doc_id", "other").alias("source"), F.greatest("doc_id", "other").alias("target")).distinct()
        more = _links(closer.join(pairs, ["source", "target"], "left_anti"), sets, similarity, scratch, "more")
        if seen["pairs"] < seen["rows"]:
            more = more.unionByName(scratch.save(
                near.where("other IS NULL").drop("other").join(
                    sets.select("doc_id", "n", "bits", "shingles"), ["doc_id", "n"])
                .groupBy(*block).applyInArrow(_compare_block(similarity), "source bigint, target bigint").distinct(),
                "most"))
        if not more.isEmpty():
            every = joined(links.unionByName(more), "every")

    known = scratch.save(classes.join(every.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "class", F.coalesce("root", "rep").alias("component")), "known")
    out = scratch.save(members.join(known, "class", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")), "result")
    scratch.drop("members", "classes", "groups", "grouped", "wanted", "sets", "pairs", "links", "possible-links", "roots",
                 "apart", "size", "near", "more", "possible-more", "most", "every", "known")
    return out


def one_per_component(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` with one document per component, the one with the smallest id; columns unchanged.

    Rows without ``doc_id`` stay. Of rows that repeat an id the smallest stays.
    """
    scratch = scratch or Scratch(docs.sparkSession, "one-per-component")
    found = jaccard_components(docs, **options)
    gone, seen = scratch.measure(
        found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("doc_id")).distinct(),
        "gone", F.count(F.lit(1)).alias("rows"))
    kept = docs.join(F.broadcast(gone) if seen["rows"] <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)
    ids = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = scratch.save(ids.where("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(again, "doc_id", "left_semi").select("doc_id", row).groupBy("doc_id")
        .agg(F.min("row").alias("row")).select("row.*"))
