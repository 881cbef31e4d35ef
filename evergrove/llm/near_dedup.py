"""Near-duplicate groups by min-max hashing.

A document's set holds its distinct word shingles as 64-bit hashes.  Every
permutation gives two signature values, the set's minimum and its maximum, so
``bands * rows`` values cost half as many hash evaluations; both are unbiased
for the Jaccard coefficient, with a lower variance than two minima.  Documents
with one set become one class.  Classes that share a band of their signatures
are candidates; a link needs the full sets' Jaccard coefficient.

Within a band's bucket no list of all pairs is made.  First every class is
compared with one centre, the smallest member of the buckets it shares most; a
group of near copies collapses there.  What remains are buckets that still hold
more than one component.  Their classes form families (components of sharing an
unresolved bucket), which are cut into blocks of bounded bytes; two blocks meet only
if they share an open bucket.  A task compares two blocks, skips pairs already
connected, pairs without a common band and pairs whose sizes rule a link out, and
returns at most one link per component it joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.common import Scratch, checkpointed, whole_text
from evergrove.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 80  # percent
BANDS, ROWS = 32, 5
BLOCK = 128  # classes, and no more shingles than
BLOCK_SHINGLES = 1_000_000  # (8 MB of hashes), unless a single text has more
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Whole texts (UTF-8) to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        # on bytes, lower() changes A-Z only and split() cuts at blanks and \x09-\x0d only
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        # hashing a word again costs less than remembering it
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            reach = min(self.words, len(hashes))
            total = np.full(len(hashes) - reach + 1, reach, dtype=np.uint64)
            for k in range(reach):
                total = _scrambled(total * _MIX + hashes[k : len(hashes) - reach + 1 + k])
        return np.unique(total)


class MinMax:
    """Signatures of minima and maxima, and their bands' keys."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        count = -(-bands * rows // 2)
        self.a = rng.integers(0, 2**63, (count, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, (count, 1), dtype=np.uint64)
        # minima, then maxima, of the permutations in one order, begun half a turn
        # later: any ``rows`` values in sequence are of different permutations
        turn = np.roll(np.arange(count), count // 2)
        self.order = np.concatenate([np.arange(count), count + turn])[: bands * rows].reshape(bands, rows)
        self.salt = _scrambled(np.arange(1, bands + 1, dtype=np.uint64) * _MIX)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = high = None
        for at in range(0, len(hashes), 4096):
            with np.errstate(over="ignore"):
                values = self.a * hashes[at : at + 4096] + self.b
                values ^= values >> np.uint64(32)
            least, most = values.min(axis=1), values.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        return np.concatenate([low, high])

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        signature = self.signature(hashes)[self.order]
        with np.errstate(over="ignore"):
            key = self.salt.copy()
            for k in range(self.rows):
                key = _scrambled(key * _MIX + signature[:, k])
        return key.view(np.int64)


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    import xxhash

    digest = xxhash.xxh128_digest(hashes.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signed(words: int, bands: int, rows: int, with_sets: bool):
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))]
    schema = pa.schema(fields + ([("hashes", pa.binary())] if with_sets else []))

    def run(batches):
        shingles, minmax = Shingles(words), MinMax(bands, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[] for _ in schema]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    hashes = shingles(text)
                    own = minmax.keys(hashes).tolist() if len(hashes) else []
                    row = [key, len(hashes), *_set_key(hashes), own]
                    if with_sets:
                        row.append(hashes.tobytes())
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


_SIGNED = "doc_id long, n long, k1 long, k2 long, bands array<long>"


def linked(shared: int, n: int, m: int, similarity: int) -> bool:
    return 100 * shared >= similarity * (n + m - shared)


def _groups(batches, keys: int):
    """Rows of key-sorted batches, group by group; a key's columns come first,
    then (block, node, component, bands, hashes)."""
    held, current = {}, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != current:
                if held:
                    yield current, list(held.values())
                current, held = row[:keys], {}
            # rows of one document with one set (equal bands) count once
            held[row[keys], row[keys + 1], tuple(row[keys + 3])] = row[keys:]
    if held:
        yield current, list(held.values())


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _link_batches(links):
    held: list[tuple[int, int]] = []
    for link in links:
        held.append(link)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_LINKS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_LINKS)


def _star_links(similarity: int):
    """Groups (centre, salt) of (role, node, hashes), the centre's rows first."""

    def links(batches):
        centre, sets = None, {}
        for batch in batches:
            for group, salt, role, node, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, salt) != centre:
                    centre, sets = (group, salt), {}
                own = np.frombuffer(packed, np.uint64)
                if role == 0:  # repeated rows of one document have one set
                    sets[_set_key(own)] = own
                    continue
                for other in sets.values():
                    if linked(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other), similarity):
                        yield node, group
                        break

    return lambda batches: _link_batches(links(batches))


def _block_links(similarity: int):
    """Groups (a, b) of (block, node, component, bands, hashes)."""

    def links(batches):
        for (a, b), rows in _groups(batches, 2):
            yield from block_pairs([r[1:] for r in rows if r[0] == a], [r[1:] for r in rows if r[0] == b], a == b, similarity)

    return lambda batches: _link_batches(links(batches))


def block_pairs(left: list, right: list, same: bool, similarity: int):
    """Links between two blocks of (node, component, bands, hashes) that join
    components which nothing in the blocks has joined before."""
    parent: dict[int, int] = {}

    def root(c):
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    sets = [[np.frombuffer(r[3], np.uint64) for r in side] for side in (left, right)]
    sizes = np.array([len(s) for s in sets[1]])
    bands = np.array([r[2] for r in right], dtype=np.int64).reshape(len(right), -1)
    for i, (node, component, own, _) in enumerate(left):
        hashes = sets[0][i]
        n = len(hashes)
        fits = (100 * np.minimum(sizes, n) >= similarity * np.maximum(sizes, n)) & (bands == np.array(own, dtype=np.int64)).any(axis=1)
        if same:
            fits[: i + 1] = False
        todo = [j for j in np.flatnonzero(fits) if root(right[j][1]) != root(component)]
        if not todo:
            continue
        # all remaining sets against this one at once
        lengths = [len(sets[1][j]) for j in todo]
        joined = np.concatenate([sets[1][j] for j in todo])
        place = np.searchsorted(hashes, joined)
        place[place == n] = 0
        shared = np.add.reduceat((hashes[place] == joined).astype(np.int64), np.cumsum([0, *lengths[:-1]]))
        for j, common, m in zip(todo, shared, lengths):
            if linked(int(common), n, m, similarity) and root(right[j][1]) != root(component):
                parent[root(right[j][1])] = root(component)
                yield node, right[j][0]


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id and kept.

    Two documents are linked when the Jaccard coefficient of their shingle sets
    is ``similarity`` percent or more; a component is what links connect, named
    by its smallest id, and that document stays.  With the default 32 bands of 5
    values a pair at exactly 0.8 is missed once in 300,000 pairs.

    Null text counts as empty.  A text without words has an empty set, is linked
    with nothing and stays.  Fewer words than a shingle's make one shingle.
    Rows that share an id count as one document, whose texts are all its own.
    Rows with a null id are linked with nothing and stay, with a null component.
    An empty table gives an empty result.  Other columns are ignored.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.encode(whole_text(text_column), "UTF-8").alias("text"))
    with Scratch(docs.sparkSession) as own:
        signed = own.table(texts.mapInArrow(_signed(words, bands, rows, False), _SIGNED), "signed")
        usable = signed.where("n > 0 and doc_id is not null")
        grouped = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("c"))
        classes = own.table(grouped.select("k1", "k2", F.col("c.doc_id").alias("node"), "c.n", "c.bands"), "classes")
        shared = _shared_buckets(classes, own)
        members = shared.select(F.col("node").alias("wanted")).distinct()
        hot = texts.join(members, F.col("doc_id") == F.col("wanted"), "left_semi")
        # by rows: Parquet's pages and column batches of very long sets would not fit in memory
        sets = checkpointed(hot.mapInArrow(_signed(words, bands, rows, True), _SIGNED + ", hashes binary").where("n > 0").select(F.col("doc_id").alias("node"), "bands", "hashes"))
        stars = _compared_with_centres(shared, sets, similarity, own)
        first = connected_components(stars, own, "first")
        rest = _compared_in_blocks(classes, shared, sets, first, similarity, own)
        named = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("node").alias("representative"))
        same_set = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
        # an id with several texts is in several classes, and connects them
        several = usable.groupBy(F.col("doc_id").alias("i")).agg(*[f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)]).where("min_k1 <> max_k1 or min_k2 <> max_k2")
        several = own.table(several.select("i"), "several")
        bridges = usable.join(several, F.col("doc_id") == F.col("i"), "left_semi").join(named, same_set).select(F.col("doc_id").alias("u"), F.col("representative").alias("v"))
        final = connected_components(stars.unionAll(rest).unionAll(bridges), own, "final")
        # the class of every row, then the component of every class
        placed = signed.join(named, same_set & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
        labelled = placed.join(final, F.col("representative") == F.col("node"), "left")
        component = F.coalesce("component", "representative", "doc_id")
        return checkpointed(labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def _shared_buckets(classes: DataFrame, own: Scratch) -> DataFrame:
    """(bucket, node, centre) of buckets with more than one node."""
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    ends = rows.groupBy(F.col("bucket").alias("b")).agg(F.min("node").alias("centre"), F.max("node").alias("last"))
    # written first, so that the join has shuffles of its own, which Spark can split where a bucket is large
    centres = own.table(ends.where("centre <> last").drop("last"), "centres")
    shared = own.table(rows.join(centres, F.col("bucket") == F.col("b")).select("bucket", "node", "centre"), "shared")
    own.drop("centres")
    return shared


def _compared_with_centres(shared: DataFrame, sets: DataFrame, similarity: int, own: Scratch) -> DataFrame:
    """Links of every node with the centre that it shares most buckets with."""
    votes = shared.where("node <> centre").groupBy(F.col("node").alias("member")).agg(F.mode("centre", True).alias("centre"))
    best = own.table(votes, "best")
    salts = own.table(best.groupBy(F.col("centre").alias("hub")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "salts")
    dealt_to = best.join(salts, F.col("centre") == F.col("hub")).select("member", "centre", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"))
    narrow = sets.select("node", "hashes")
    compared = dealt_to.join(narrow, F.col("member") == F.col("node")).select("centre", "salt", F.lit(1).alias("role"), "node", "hashes")
    centres = salts.join(narrow, F.col("hub") == F.col("node")).select(F.col("hub").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "node", "hashes")
    dealt = centres.unionAll(compared).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return own.table(dealt.mapInArrow(_star_links(similarity), "u long, v long"), "stars")


def _compared_in_blocks(classes: DataFrame, shared: DataFrame, sets: DataFrame, components: DataFrame, similarity: int, own: Scratch) -> DataFrame:
    """The links that the stars have not found."""
    known = components.select(F.col("node").alias("n"), "component")
    marked = own.table(shared.join(known, F.col("node") == F.col("n"), "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "marked")
    ends = marked.groupBy(F.col("bucket").alias("b")).agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("node").alias("head"))
    open_buckets = own.table(ends.where("c1 <> c2").select("b", "head"), "open")
    unresolved = own.table(marked.join(open_buckets, F.col("bucket") == F.col("b")).select("bucket", "node", "component", "head"), "unresolved")
    own.drop("marked")
    families = connected_components(unresolved.select(F.col("node").alias("u"), F.col("head").alias("v")), own, "families")
    sizes = classes.groupBy(F.col("node").alias("s")).agg(F.max("n").alias("n"))
    nodes = unresolved.select(F.col("node").alias("member"), F.col("component").alias("c")).distinct()
    placed = nodes.join(families, F.col("member") == F.col("node")).select("member", "c", F.col("component").alias("family"))
    placed = own.table(placed.join(sizes, F.col("member") == F.col("s")).select("member", "c", "family", "n"), "placed")
    # a component of a block or more has blocks of its own, never compared with each other; small ones share blocks
    fill = lambda count, n: F.greatest(F.ceil(count / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    totals = placed.groupBy(F.col("family").alias("f"), F.col("c").alias("fc")).agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    totals = own.table(totals.withColumn("own", F.when((F.col("count") >= BLOCK) | (F.col("n") >= BLOCK_SHINGLES), F.col("fc"))), "totals")
    pooled = totals.groupBy(F.col("f").alias("pf"), F.col("own").alias("po")).agg(fill(F.sum("count"), F.sum("n")).alias("blocks"))
    numbered = totals.join(pooled, (F.col("f") == F.col("pf")) & F.col("own").eqNullSafe(F.col("po"))).select("f", "fc", "own", "blocks")
    block = F.xxhash64("family", F.coalesce("own", F.lit(-1)), F.pmod(F.xxhash64("member", F.lit(3)), F.col("blocks")))
    blocks = own.table(placed.join(numbered, (F.col("family") == F.col("f")) & (F.col("c") == F.col("fc"))).select("member", "c", "own", block.alias("block")), "blocks")
    # the blocks in every open bucket, then those pairs of them that can hold an unknown link
    spread = unresolved.join(blocks, F.col("node") == F.col("member")).select("bucket", "block", "own").distinct()
    spread = own.table(spread, "spread")
    other = spread.select(F.col("bucket").alias("b"), F.col("block").alias("other"), F.col("own").alias("other_own"))
    differ = F.coalesce(F.col("own") != F.col("other_own"), F.lit(True))
    pairs = own.table(spread.join(other, (F.col("bucket") == F.col("b")) & (F.col("block") <= F.col("other")) & differ).select(F.col("block").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("side"))
    rows = blocks.join(sides, F.col("block") == F.col("side")).select("a", "b", "block", "member", "c")
    rows = rows.join(sets.select("node", "bands", "hashes"), F.col("member") == F.col("node")).select("a", "b", "block", "member", "c", "bands", "hashes")
    return own.table(rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_block_links(similarity), "u long, v long"), "rest")
