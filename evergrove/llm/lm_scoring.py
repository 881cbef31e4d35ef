"""Cross-entropy difference scoring with two matched bigram models.

A target model (from documents labelled as good) and a background model (from
all documents) share one vocabulary: every word of the corpus.  Both are word
bigrams interpolated with unigrams, with the same constants.  A document's score
is its mean per-token loss under the target minus that under the background: the
lower, the more it is like the target.

Words are what stands between blanks; in scripts that write none, every code
point is a word.  Word counts, bigram counts and scores cover all documents and
all tokens.

The counts are a distributed table that grows with the corpus.  Documents are
gathered into blocks of up to about four million tokens.  A block sends each of its words
and word pairs once, with its own counts, to the task that owns the word's or
pair's key; that task adds the counts of all blocks and answers each block with
the sums, from which the block's documents are scored.  So no task and no
broadcast holds a whole model, and a word pair that is everywhere is one entry a
block.  Keys are 64-bit hashes: among a billion distinct pairs, 0.03 pairs of
them are expected to share a key (and then their counts).
"""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.common import checkpointed, whole_text

KEPT_COUNTS = 400_000  # distinct words that a task sums before it passes them on
BLOCK_TOKENS = 4_000_000  # a block ends with the text that reaches this
BLOCKS_PER_BUCKET = 2  # how many blocks' entries an owner of keys holds
ALPHA, KAPPA = 0.5, 50.0
#: Scripts without blanks between words (Thai, Lao, Burmese, Khmer, kana, CJK ideographs).
UNSPACED = re.compile("([฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff])")
UNKNOWN, END = "", " "  # tokens that no word can be; the end of a text is also what a text starts after
PAIR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", text)
    return text.split()


def _count_words(batches):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    counts: dict[str, int] = {}

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for word in words_of(text):
                counts[word] = counts.get(word, 0) + 1
            if len(counts) > KEPT_COUNTS:
                yield flushed()
                counts.clear()
    if counts:
        yield flushed()


def shared_vocabulary(rows: DataFrame, size: int) -> list[str]:
    """The ``size`` most frequent words of all texts, ties in word order."""
    counts = rows.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [row["word"] for row in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: small ones cost what they need."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], size * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed, "<u8"), dtype=np.uint64)


def _word_keys(words) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(w.encode(), digest_size=8).digest() for w in words), "<u8")


BLOCK = "block long, ids array<long>, sizes binary, words binary, tokens binary"


def _blocks(known: frozenset | None):
    """Texts to blocks: ids and token counts of texts, the keys of the block's
    words (the end first) and all tokens, as numbers of these words."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "words", "tokens"))])

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    if held is None:
                        ids, tokens, held = [], [], 0
                        number: defaultdict = defaultdict()
                        number.default_factory = number.__len__
                        number[END]
                    words = words_of(text)
                    if known is not None:
                        words = [w if w in known else UNKNOWN for w in words]
                    words.append(END)
                    ids.append(doc_id)
                    tokens.append(np.fromiter(map(number.__getitem__, words), "<u4", len(words)))
                    held += len(words)
                    if held >= BLOCK_TOKENS:
                        yield flushed(block, ids, tokens, number)
                        block, held = block + 1, None
        if held is not None:
            yield flushed(block, ids, tokens, number)

    def flushed(block, ids, tokens, number):
        packed = (np.array([len(t) for t in tokens], "<u4"), _word_keys(number), np.concatenate(tokens))
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([_packed(p)], pa.binary()) for p in packed)], schema=schema)

    return run


def _entries(words: bytes, tokens: bytes):
    """A block's tokens, its word keys, the index of every token's pair (with
    the token before), and the distinct pairs' keys."""
    keys, numbers = _unpacked(words, "<u8"), _unpacked(tokens, "<u4").astype(np.int64)
    before = np.concatenate([[0], numbers[:-1]])  # the end is number 0, and what follows it starts a text
    pairs, pair_of = np.unique(before * len(keys) + numbers, return_inverse=True)
    return keys, numbers, before, pairs, pair_of, keys[pairs // len(keys)] * PAIR + keys[pairs % len(keys)]


PIECE = "bucket int, block long, words binary, word_counts binary, pairs binary, pair_counts binary"


def _pieces(buckets: int):
    """A block to one row for every owner of keys: the keys and, for each, the
    target's count and the count of all.  ``marks``: the places of the target's
    texts in the block, if there are any."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("words", "word_counts", "pairs", "pair_counts"))])
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def cut(keys, index, good):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = [np.bincount(index[good], minlength=len(keys))[order], np.bincount(index, minlength=len(keys))[order]]
        ends = [0, *np.searchsorted(keys, bounds), len(keys)]
        return [(_packed_keys(keys[a:b]), _packed(np.concatenate([c[a:b] for c in counts]).astype("<u8"))) for a, b in zip(ends, ends[1:])]

    def run(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        keys, numbers, _, _, pair_of, pair_keys = _entries(row["words"], row["tokens"])
        sizes = _unpacked(row["sizes"], "<u4")
        good = np.zeros(len(sizes), bool)
        for places in marks.column("places").to_pylist():
            good[places] = True
        good = np.repeat(good, sizes)
        columns = zip(*(w + p for w, p in zip(cut(keys, numbers, good), cut(pair_keys, pair_of, good))))
        arrays = [pa.array(range(buckets), pa.int32()), pa.array([row["block"]] * buckets, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)]
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


ANSWER = "block long, bucket int, word_counts binary, pair_counts binary, n_words long, n_target long, n_all long"


def _answer(pieces: pa.Table) -> pa.Table:
    """All pieces of one owner: the sums over all blocks, in the order of every
    piece's keys.  Every row has the owner's distinct words and its tokens; since
    every block hears from every owner, it can add these up for itself."""
    reserved = _word_keys([UNKNOWN, END])

    def added(key_column: str, count_column: str):
        keys = [_unpacked_keys(k) for k in pieces.column(key_column).to_pylist()]
        counts = [_unpacked(c, "<u8").reshape(2, -1) for c in pieces.column(count_column).to_pylist()]
        distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.array([np.bincount(index, np.concatenate([c[k] for c in counts]), len(distinct)) for k in (0, 1)]).astype("<u8")
        ends = np.cumsum([0, *map(len, keys)])
        return distinct, sums, [_packed(sums[:, index[a:b]].ravel()) for a, b in zip(ends, ends[1:])]

    words, word_sums, word_answers = added("words", "word_counts")
    _, _, pair_answers = added("pairs", "pair_counts")
    each = lambda n: pa.array([int(n)] * len(pieces), pa.int64())
    return pa.table(
        {
            "block": pieces.column("block"),
            "bucket": pieces.column("bucket"),
            "word_counts": pa.array(word_answers, pa.binary()),
            "pair_counts": pa.array(pair_answers, pa.binary()),
            "n_words": each((~np.isin(words, reserved)).sum()),
            "n_target": each(word_sums[0].sum()),
            "n_all": each(word_sums[1].sum()),
        }
    )


def token_losses(pair, word, before, total: int, width: int, alpha: float = ALPHA, kappa: float = KAPPA) -> np.ndarray:
    """-log P(word | word before) from the counts of the pair, of the word and of
    the word before (each token is before another as often as it occurs)."""
    unigram = (word + alpha) / (total + alpha * width)
    return -np.log((pair + kappa * unigram) / (before + kappa))


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _scorer():
    def ordered(keys, answers):
        out = np.empty((2, len(keys)))
        out[:, np.argsort(keys, kind="stable")] = np.concatenate([_unpacked(a, "<u8").reshape(2, -1) for a in answers], axis=1)
        return out

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        answers = answers.sort_by("bucket")
        n_words, *totals = (sum(answers.column(c).to_pylist()) for c in ("n_words", "n_target", "n_all"))
        width = n_words + 2  # all words, the unknown one and the end
        keys, _, _, pairs, pair_of, pair_keys = _entries(row["words"], row["tokens"])
        word_counts = ordered(keys, answers.column("word_counts").to_pylist())
        pair_counts = ordered(pair_keys, answers.column("pair_counts").to_pylist())
        sizes = _unpacked(row["sizes"], "<u4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        losses = []
        for k in (0, 1):
            loss = token_losses(pair_counts[k], word_counts[k][pairs % len(keys)], word_counts[k][pairs // len(keys)], totals[k], width)
            losses.append(np.add.reduceat(loss[pair_of], starts) / sizes)
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_tokens": sizes, "target_loss": losses[0], "background_loss": losses[1], "score": losses[0] - losses[1]})

    return run


def score_by_cross_entropy(docs: DataFrame, target_ids: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: int | None = None) -> DataFrame:
    """Score every whole text: doc_id, n_tokens, target_loss, background_loss
    (nats per token) and score, their difference.

    ``target_ids`` has one column, the ids of the target's documents; an id given
    twice counts once.  Null text counts as empty; an empty text is its end token
    alone.  Without target documents the target model is uniform.  Repeated rows
    count and are scored as often as they occur; null ids are never target.  An
    empty table gives an empty result.  Other columns are ignored.  Only where
    ``vocabulary`` is given, words beyond that many of the most frequent are one
    unknown token.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    known = None if vocabulary is None else frozenset(shared_vocabulary(rows, vocabulary))
    good = target_ids.toDF("good_id").where("good_id is not null").distinct()
    blocks = checkpointed(rows.mapInArrow(_blocks(known), BLOCK))
    buckets = max(16, blocks.count() // BLOCKS_PER_BUCKET)
    placed = blocks.select(F.col("block").alias("home"), F.posexplode("ids").alias("place", "doc_id")).where("doc_id is not null")
    marks = placed.join(good, F.col("doc_id") == F.col("good_id")).groupBy("home").agg(F.collect_list("place").alias("places"))
    # the same grouping here and for the scores, so that blocks are shuffled once
    pieces = blocks.groupBy("block").cogroup(marks.groupBy("home")).applyInArrow(_pieces(buckets), PIECE)
    answers = pieces.groupBy("bucket").applyInArrow(_answer, ANSWER)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(), SCORES)
