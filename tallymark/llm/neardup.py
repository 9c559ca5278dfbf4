"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. ``sketch``: each text becomes its set of word shingles (64-bit hashes), the set's digest and size,
   and a MinHash signature. Texts with equal sets form one class; everything after runs on a
   representative of each class, so exact copies never meet pairwise.
2. ``neighbours``: every tree of the forest is an order of the signatures: rows sorted by ``DEPTH``
   MinHash values of their own. A row's candidates are those with the longest common prefixes, which
   in sorted order are its nearest predecessors, up to ``WINDOW``, as long as at least ``LEAST``
   values are shared. Thin regions are thereby searched down to the shortest prefix, dense ones only
   along long prefixes: the depth follows the density. Candidates that cannot be linked are left out by
   a summary of their sets: for sets up to SMALL the parity of how many shingles fall on each of 1,024
   places (two sets differ in at least as many shingles as places, so no link is lost), for larger sets
   MinHash values (a link is more than DEVIATIONS off with probability below 1e-6).
3. Candidates are confirmed on full sets, and confirmed links joined into components.
4. Regions of more than WINDOW other rows that hold more than one component are searched on by
   ``crowded_pairs``: an exact prefix filter over the full sets of their rows, without a cap.

Regions that hold more than a HOT_REGIONS-th of all rows are dealt over tasks by ranges of their order; pairs
across the edges of ranges are found by step 4.

Steps 2 and 3 run twice. The first pass uses few trees and only the nearest candidate of each row; it collapses
dense groups into components. The second uses all trees and skips pairs that are already joined, so a
group of thousands emits its spanning links and not its pairs.

A pair of similarity 0.8 shares LEAST = 3 values in one of 20 trees except with probability
(1 - 0.8**3)**20 = 6e-7, and of the rows that do each pair is either within a WINDOW or searched on. No step collects rows, links or components to the driver.

Defined results: null texts and texts without words have an empty set and no links; with fewer words
than a shingle has, the whole sequence is the one shingle; repeated rows are kept as rows of
one class; a row with a null id is never a representative; ids are unique but for repeated rows; an
empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, joined_widely, shipped, stored, table

TREES, DEPTH, LEAST = 20, 6, 3
WINDOW = 96
EXTRA = 128  #: bytes of a set's summary, by which candidates are sifted
SMALL = 1500  #: sets up to this size are summarised by parities, larger ones by MinHash values
FIRST_TREES = 4
RARITY = 1 << 20  #: places of the table of counts that orders shingles by how rare they are
HOT_REGIONS = 16_384  #: no more regions than this are dealt over tasks
CELL = 4096  #: rows of one shingle that are compared in one piece
DEVIATIONS = 5.5  #: how far below its expectation a linked pair's estimate may be
MOST_BITS = 1 << 27  #: of the bitmap that tells candidates' texts from others before they are shuffled
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_MULT = (np.random.default_rng(20240229).integers(1, 2**32, TREES * DEPTH + EXTRA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(7).integers(0, 2**62, TREES * DEPTH + EXTRA, dtype=np.uint64)
_CHUNK = 512


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    distinct: dict[bytes, int] = {}
    place = [distinct.setdefault(w, len(distinct)) for w in words]
    of = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in distinct), "<u8")[place]
    if len(of) < k:
        k = len(of)
    with np.errstate(over="ignore"):
        h = np.full(len(of) - k + 1, np.uint64(k))
        for j in range(k):
            h = _mix(h + of[j : len(of) - k + 1 + j])
    return np.unique(h)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def signature(h: np.ndarray, values: int) -> np.ndarray:
    """The first ``values`` MinHash values (uint32) of a set of hashes."""
    best = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), _CHUNK):
            v = h[at : at + _CHUNK, None] * _MULT[None, :values]
            v += _ADD[:values]
            np.minimum(best, v.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def summary(h: np.ndarray) -> tuple[bytes, bytes]:
    """The values for the trees, and EXTRA bytes to sift by."""
    small = len(h) <= SMALL
    s = signature(h, TREES * DEPTH + (0 if small else EXTRA))
    trees = s[: TREES * DEPTH].astype(">u4").tobytes()
    if small:
        odd = np.bincount((h & np.uint64(8 * EXTRA - 1)).astype(np.int64), minlength=8 * EXTRA) & 1
        return trees, np.packbits(odd.astype(np.uint8)).tobytes()
    return trees, s[TREES * DEPTH :].astype(np.uint8).tobytes()


SKETCH = "id long, n_shingles long, set_hash binary, trees binary, extra binary"


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, trees, extras = [], [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), k)
                tree, extra = summary(h)
                sizes.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                trees.append(tree)
                extras.append(extra)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, trees, extras))], ["id", "n_shingles", "set_hash", "trees", "extra"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SKETCH)


PAIRS = "a long, b long"


def linkable(na, nb, a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of sets, by their sizes and summaries, may be linked."""
    least = EXTRA * share - DEVIATIONS * (EXTRA * share * (1 - share)) ** 0.5
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    alike = (a == b).sum(axis=1)
    mixed = np.minimum(na, nb) <= SMALL
    # |A ^ B| <= (|A| + |B|) (1 - s) / (1 + s) where the similarity is s or more
    return np.where(np.maximum(na, nb) > SMALL, mixed | (alike >= least), apart <= (na + nb) * (1 - share) / (1 + share) + 1e-6)


def places(trees: int) -> F.Column:
    """A struct (tree, region) for each tree of a row: rows of one region share LEAST values."""
    return F.posexplode(F.array(*(F.substring("trees", 1 + 4 * DEPTH * t, 4 * LEAST) for t in range(trees)))).alias("tree", "region")


def large_regions(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tree, region, n of the regions that windows do not cover; and tree, region of those that hold so many
    rows that they are dealt over tasks: more than a HOT_REGIONS-th of all, so fewer than HOT_REGIONS."""
    large = stored(classes.select(places(TREES)).groupBy("tree", "region").agg(F.count("*").alias("n")).where(F.col("n") > WINDOW + 1), "regions")
    least = max(4 * WINDOW, TREES * classes.count() // HOT_REGIONS)
    return large, stored(large.where(F.col("n") > least).select("tree", "region"), "hot-regions")


def neighbours(classes: DataFrame, trees: int, nearest: int, share: float, hot: DataFrame) -> DataFrame:
    """Candidate pairs. classes: id, n_shingles, comp, trees, extra. nearest: how many candidates a
    row keeps of a tree (0: all of its window). hot: regions that no task gets as a whole; pairs across
    the edges of their parts are left to ``crowded_pairs``."""
    rows = classes.select(
        "id", "n_shingles", "comp", "extra",
        F.posexplode(F.array(*(F.substring("trees", 1 + 4 * DEPTH * t, 4 * DEPTH) for t in range(trees)))).alias("tree", "order"),
    )
    ratio = share - 1e-9

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, sizes, comps, tree = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            extra = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, EXTRA)
            region = np.frombuffer(b"".join(x[: 4 * LEAST] for x in batch.column(5).to_pylist()), ">u4").reshape(n, LEAST).astype(np.int64)
            region = np.concatenate([tree.astype(np.int64)[:, None], region], axis=1)
            now = (ids, sizes, comps, extra, region)
            if tail is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(tail, now))
            ids, sizes, comps, extra, region = now
            held, total = len(ids) - n, len(ids)
            left = np.full(total, nearest or WINDOW)
            found_a, found_b = [], []
            alive = np.arange(held, total)
            for step in range(1, WINDOW + 1):
                alive = alive[alive >= step]
                alive = at = alive[(region[alive] == region[alive - step]).all(axis=1)]
                if not len(at):
                    break
                lo, hi = np.minimum(sizes[at], sizes[at - step]), np.maximum(sizes[at], sizes[at - step])
                at = at[(lo >= ratio * hi) & (comps[at] != comps[at - step]) & (left[at] > 0)]
                at = at[linkable(sizes[at], sizes[at - step], extra[at], extra[at - step], share)]
                left[at] -= 1
                found_a.append(np.minimum(ids[at], ids[at - step]))
                found_b.append(np.maximum(ids[at], ids[at - step]))
            tail = tuple(x[max(0, total - WINDOW) :] for x in now)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (found_a, found_b)], ["a", "b"])

    rows = rows.select("id", "n_shingles", "comp", "extra", "tree", "order", F.substring("order", 1, 4 * LEAST).alias("region"))

    def scanned(dealt: DataFrame) -> DataFrame:
        return dealt.sortWithinPartitions("tree", "order", "id").drop("region").mapInArrow(scan, PAIRS)

    if hot.isEmpty():
        found = scanned(rows.repartition("tree", "region"))
    else:
        part = lambda how: rows.join(F.broadcast(hot), ["tree", "region"], how).select(*rows.columns)
        found = scanned(part("left_anti").repartition("tree", "region")).union(scanned(part("left_semi").repartitionByRange("tree", "order", "id")))
    return found.dropDuplicates(["a", "b"])


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without most of those whose id is not in ids, by a bitmap of hashed ids: it is broadcast,
    and never larger than MOST_BITS. What it lets through has still to be joined."""
    bits = 1 << 16
    wanted = 8 * ids.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    own = ids.select(F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at).alias("p")).groupBy("__bucket").agg(F.bitmap_construct_agg("p").alias("__bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    is_set = F.expr("shiftright(b, cast(p % 8 as int)) & 1 = 1")
    kept = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(own), "__bucket")
    return kept.withColumn("b", byte).withColumn("p", place).where(is_set).select(*rows.columns)


def full_sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, set: the sorted shingle hashes of each id of ids."""
    shipped(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t.as_py(), k).tobytes() for t in batch.column(1)], pa.binary())], ["id", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = among(texts, ids).join(ids, "id", "left_semi").dropDuplicates(["id"])
    return stored(texts.mapInArrow(sets, "id long, set binary"), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    have = full_sets(ends, docs, id_col, text_col, k)
    both = pairs.join(have.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(have.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (sa, sb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, PAIRS)


def crowded(classes: DataFrame, large: DataFrame) -> DataFrame:
    """id of the rows in large regions that are not all of one component. classes: id, comp, trees; large:
    tree, region."""
    rows = stored(classes.select("id", "comp", places(TREES)).join(large.select("tree", "region"), ["tree", "region"], "left_semi"), "crowd")
    mixed = rows.groupBy("tree", "region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tree", "region")
    return stored(rows.join(mixed, ["tree", "region"], "left_semi").select("id").distinct(), "crowd")


def crowded_pairs(classes: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """All pairs of rows of sets in different components that may be linked. classes: id, n_shingles,
    comp, extra; sets: id, set.

    In any one order of all shingles, linked sets share one of their first n - ceil(share * n) + 1.
    The order is by a table of counts, rare ones first; the table only decides what is cheap. Rows of a
    shingle are dealt to cells of pairs of blocks, so none meets in one task as a whole."""
    ratio = share - 1e-9
    spot = lambda h: (h & np.uint64(RARITY - 1)).astype(np.int64)

    def first(n: int) -> int:
        return n - int(np.ceil(ratio * n)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, spot(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    # at most RARITY rows, whatever the input
    counts = sets.select("set").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table_ = np.zeros(RARITY, np.int64)
    table_[counts["at"].to_numpy()] = counts["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table_)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                h = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint64)
                f = often[spot(h)]
                order = np.lexsort((h, f))[: first(len(h))]
                pos = np.arange(len(order))
                some = f[order] > 1  # others have no partner
                order, pos = order[some], pos[some]
                blocks = -(-f[order] // CELL)
                reps = np.repeat(np.arange(len(order)), blocks)
                other = np.arange(len(reps)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                salt = int(_mix(np.array([batch.column(0)[r].as_py() & (2**63 - 1)], np.uint64))[0] >> np.uint64(1))
                own = salt % blocks[reps]
                n = len(reps)
                fixed = [pa.repeat(batch.column(c)[r], n) for c in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[order][reps].view(np.int64)), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own), pa.array(pos[reps]), *fixed],
                    ["h", "lo", "hi", "own", "pos", "id", "n", "comp", "extra"])

    def pairs(cell) -> Iterator[pa.RecordBatch]:
        """cell: lo, hi, own, pos, id, n, comp, extra of one cell, by comp."""
        lo, hi, own, pos, ids, sizes, comps, extra = cell
        right = np.arange(len(ids)) if lo == hi else np.flatnonzero(own == hi)
        for a in np.arange(len(ids)) if lo == hi else np.flatnonzero(own == lo):
            b = right[np.searchsorted(comps, comps[a], "right") :] if lo == hi else right[comps[right] != comps[a]]
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            most = 1 + np.minimum(pos[a], pos[b]) + np.minimum(sizes[a] - pos[a] - 1, sizes[b] - pos[b] - 1)
            b = b[(small >= ratio * large) & (most >= ratio / (1 + ratio) * (sizes[a] + sizes[b]) - 1e-6)]
            b = b[linkable(sizes[a], sizes[b], extra[a][None, :], extra[b], share)] if len(b) else b
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # batches of the cell that is not yet complete

        def done(rows: pa.Table):
            if rows.num_rows > 1:
                own, pos, ids, sizes, comps = (rows.column(c).to_numpy() for c in ("own", "pos", "id", "n", "comp"))
                extra = np.frombuffer(b"".join(rows.column("extra").to_pylist()), np.uint8).reshape(-1, EXTRA)
                yield from pairs((rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py(), own, pos, ids, sizes, comps, extra))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if held and tuple(keys[0]) != last:
                yield from done(pa.Table.from_batches(held))
                held = []
            starts = [0, *cuts.tolist(), batch.num_rows]
            for x, y in zip(starts, starts[1:]):
                if y - x > 1 or held or y == batch.num_rows:
                    held.append(batch.slice(x, y - x))
                if y < batch.num_rows and held:
                    yield from done(pa.Table.from_batches(held))
                    held = []
            last = tuple(keys[-1])
        if held:
            yield from done(pa.Table.from_batches(held))

    rows = sets.join(classes, "id").select("id", F.col("n_shingles").alias("n"), "comp", "extra", "set")
    dealt = rows.mapInArrow(deal, "h long, lo long, hi long, own long, pos long, id long, n long, comp long, extra binary").repartition("h", "lo", "hi")
    return dealt.sortWithinPartitions("h", "lo", "hi", "comp", "id").mapInArrow(scan, PAIRS).dropDuplicates(["a", "b"])


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """id, comp (the smallest id reachable) of every id in links (a, b), by alternating large and
    small stars. A hub's neighbours are only ever aggregated and joined, never gathered."""
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # large: a < b, a the least of b's old neighbourhood
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        new = small.select(F.col("m").alias("a"), "b").union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new = stored(new, "links")
        edges, old = new, edges
        same = _same(edges, old)
        forget(old)
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two sets of edges are equal, by count and two order-free sums of hashes."""
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first()
    return total(x) == total(y)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept of every row."""
    sketches = stored(sketch(docs, id_col, text_col, k), "sketches")
    members = sketches.where("set_hash is not null and id is not null")
    least = members.groupBy("set_hash").agg(F.min(F.struct("id", "n_shingles", "trees", "extra")).alias("x"))
    classes = stored(least.select("set_hash", "x.*", F.col("x.id").alias("comp")), "classes")
    first = classes.select("set_hash", F.col("id").alias("rep"))
    large, hot = large_regions(classes)
    links = stored(confirmed(stored(neighbours(classes, FIRST_TREES, 1, percent / 100, hot), "near"), docs, id_col, text_col, k, percent), "links")
    joined = stored(components(links), "comps")
    now = classes.drop("comp").join(joined, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    more = confirmed(stored(neighbours(now, TREES, 0, percent / 100, hot), "near"), docs, id_col, text_col, k, percent)
    links = stored(links.union(more), "links")
    comps = stored(components(links), "comps")
    now = classes.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    crowd = crowded(now, large)
    if not crowd.isEmpty():
        found = stored(crowded_pairs(now, full_sets(crowd, docs, id_col, text_col, k), percent / 100), "near")
        comps = stored(components(links.union(confirmed(found, docs, id_col, text_col, k, percent))), "comps")
    of_set = first.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("comp", "rep").alias("comp"))
    # the set of a large group of copies is a hot key, and so is that of texts without words
    found = joined_widely(sketches.select("id", "n_shingles", "set_hash"), of_set, "set_hash", F.xxhash64("id", "n_shingles"))
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("comp", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


def oracle_sql(k: int = 4, percent: int = 80, docs: str = "documents") -> str:
    """Exact: all pairs that share a shingle, then reachability."""
    shingle = f"CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct({shingle})) END AS s FROM words),
classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, n, hash(unnest(s)) AS x FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS rep, min(b) AS comp FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, coalesce(m.comp, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s LEFT JOIN comp m ON m.rep = c.rep"""


ORACLES = {"op4_near_duplicates": oracle_sql()}
QUERIES = {"op4_near_duplicates": op4_near_duplicates}
