"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of tokens.  A window of ``capacity`` tokens takes from
every queue its quantum, the queue's target share of the window; what a queue
could not be given in whole tokens stays in its deficit counter and is served
in a later window, queues with the largest deficit first.  So all windows hold
the target proportions to within a token per queue.

To run in parallel the windows are cut into blocks.  The state of all queues at
a block's start has a closed form (tokens merged by virtual finishing time, in
integers), so the deficits that one block would carry into the next are known
without running the first; a block's rounds run wherever a document needs them.
A document's place in its queue comes from a running total inside the task that
tokenised it and the totals of the tasks before it; token ids are shuffled once,
to meet those totals.  A source whose share is less than half a token a window
cannot be given its part of every window: all such sources, however many, are one
queue, whose share is theirs together.  The last, shorter window is cut into sequences whose lengths are
powers of two, so that none needs padding.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evergrove.llm.common import checkpointed, whole_text

VIRTUAL = 1 << 62
BLOCK = 64  # windows
CACHE_BYTES = 32 << 20


class Mixture:
    """The closed form of all queues' service, and the rounds inside a block."""

    def __init__(self, totals: list[int], weights: list[int] | None, capacity: int):
        self.totals = [int(t) for t in totals]
        self.weights = self.totals if weights is None else [max(1, int(w)) for w in weights]
        self.capacity = capacity
        self.total = sum(self.totals)
        self.windows = -(-self.total // capacity)
        self.horizon = max((-(-t // w) for t, w in zip(self.totals, self.weights) if w), default=1) + 1
        # what is remembered is bounded in bytes, however many queues there are
        width = max(1, len(self.totals))
        self.block = lru_cache(maxsize=max(2, CACHE_BYTES // (16 * (BLOCK + 1) * width)))(self._block)
        self.served_before = lru_cache(maxsize=max(64, min(1024, CACHE_BYTES // (100 * width))))(self._served_before)

    def _at(self, time: int) -> list[int]:
        """Tokens of each queue that are due before virtual time ``time``."""
        half = VIRTUAL >> 1
        return [min(t, (w * time + half) // VIRTUAL) for t, w in zip(self.totals, self.weights)]

    def _served_before(self, window: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
        """Tokens served from each queue in the windows before ``window``, and the
        deficits carried into it: what a queue was due beyond that."""
        wanted = min(window * self.capacity, self.total)
        if wanted == self.total:
            return tuple(self.totals), (0.0,) * len(self.totals)
        low, high = 0, self.horizon * VIRTUAL
        while high - low > 1:
            middle = (low + high) // 2
            if sum(self._at(middle)) <= wanted:
                low = middle
            else:
                high = middle
        served, after = self._at(low), self._at(high)
        missing = wanted - sum(served)
        for queue, (now, then) in enumerate(zip(served, after)):
            step = min(missing, then - now)
            served[queue] += step
            missing -= step
        due = [(min(t * VIRTUAL, w * low) - n * VIRTUAL) / VIRTUAL for t, w, n in zip(self.totals, self.weights, served)]
        return tuple(served), tuple(due)

    def _block(self, block: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(first window, service, places): row k of ``service`` has every queue's
        tokens served before the block's k-th window, row k of ``places`` where in
        that window each queue's tokens begin."""
        first = block * BLOCK
        last = min(first + BLOCK, self.windows)
        before, carried = self.served_before(first)
        start, deficit = np.array(before, dtype=np.int64), np.array(carried)
        left = np.array(self.served_before(last)[0], dtype=np.int64) - start
        weights = np.array(self.weights, dtype=float)
        served = np.zeros((last - first + 1, len(left)), dtype=np.int64)
        for k in range(last - first):
            give = self._round(min(self.capacity, int(left.sum())), left, deficit, weights)
            left -= give
            served[k + 1] = served[k] + give
        given = np.diff(served, axis=0)
        return first, served + start, np.cumsum(given, axis=1) - given

    @staticmethod
    def _round(size: int, left: np.ndarray, deficit: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Fill one window: every queue with tokens left adds its quantum to its
        deficit and is served whole tokens of it; a queue that runs dry leaves
        its part to the others, and what fractions leave over goes to the largest
        deficits.  ``deficit`` is carried on."""
        give = np.zeros_like(left)
        room = size
        while room > 0:
            active = left > give
            deficit[active] += room * weights[active] / weights[active].sum()
            step = np.where(active, np.clip(np.floor(deficit + 1e-9), 0, left - give), 0).astype(np.int64)
            if step.sum() == 0:
                step[np.argmax(np.where(active, deficit, -np.inf))] = 1
            over = int(step.sum()) - room
            while over > 0:  # carried deficits can ask for a token or two too many
                lowest = np.argmin(np.where(step > 0, deficit - step, np.inf))
                step[lowest] -= 1
                over -= 1
            give += step
            deficit -= step
            room -= int(step.sum())
            if 0 < room < len(left):
                while room > 0:
                    queue = np.argmax(np.where(left > give, deficit, -np.inf))
                    give[queue] += 1
                    deficit[queue] -= 1
                    room -= 1
        deficit[left == give] = 0.0
        return give

    def pieces(self, queue: int, start: int, length: int):
        """(start in the document, length, window, offset) of a document whose
        tokens are at [start, start + length) of the queue's stream."""
        done = 0
        low, high = 0, -(-self.windows // BLOCK)  # the block that serves token ``start``
        while high - low > 1:
            middle = (low + high) // 2
            if self.served_before(middle * BLOCK)[0][queue] <= start:
                low = middle
            else:
                high = middle
        block = low
        stop = start + length
        while done < length:
            first, served, places = self.block(block)
            column = served[:, queue]
            k = int(column.searchsorted(start + done, "right")) - 1
            last = min(int(column.searchsorted(stop, "left")), len(column) - 1)
            edges = column[k : last + 1]
            begins, ends = np.maximum(edges[:-1], start + done), np.minimum(edges[1:], stop)
            offsets = places[k:last, queue] + begins - edges[:-1]
            for begin, end, window, offset in zip(begins.tolist(), ends.tolist(), range(first + k, first + last), offsets.tolist()):
                if end > begin:
                    yield begin - start, end - begin, window, offset
            done = max(done, min(int(column[-1]), stop) - start)
            block += 1


def tail_lengths(rest: int) -> list[int]:
    """The last window's tokens as powers of two, largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _sequences(mixture: Mixture, pieces):
    """Windows to sequences: the shorter last window becomes several."""
    rest = mixture.total % mixture.capacity
    cuts = tail_lengths(rest)
    for start, length, window, offset in pieces:
        if rest == 0 or window < mixture.windows - 1:
            yield start, length, window, offset
            continue
        begin = 0
        for k, size in enumerate(cuts):
            low, high = max(offset, begin), min(offset + length, begin + size)
            if low < high:
                yield start + low - offset, high - low, window + k, low - begin
            begin += size


def _tokenise(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("chunk", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from evergrove.llm.word_bpe import worker_encoder

        encoder = worker_encoder(path)
        end = np.array([end_id], encoder.width).tobytes()
        width, chunk, totals = len(end), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys, queues = part.column(0), part.column(1).to_pylist()
                ids = [encoder.encode(text) + end for text in part.column(2).to_pylist()]
                before, lengths = [], [len(x) // width for x in ids]
                for queue, n in zip(queues, lengths):
                    before.append(totals.get(queue, 0))
                    totals[queue] = before[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(queues, pa.string()), pa.array([chunk] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                    schema=schema,
                )

    return run


def _cutter(queues: list[str | None], totals: list[int], weights, capacity: int, wide: bool):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string())]
    )

    def run(batches):
        mixture, index = Mixture(totals, weights, capacity), {q: k for k, q in enumerate(queues)}
        columns: list[list] = [[] for _ in schema]

        def batch_of():
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            for c in columns:
                c.clear()
            return found

        for batch in batches:
            for key, queue, place, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = memoryview(np.frombuffer(packed, "<u4" if wide else "<u2").astype("<u4").tobytes())
                starts, lengths, sequences, offsets = zip(*_sequences(mixture, mixture.pieces(index[queue], place, n)))
                sums = [zlib.crc32(ids[4 * a : 4 * (a + b)]) for a, b in zip(starts, lengths)]
                count = len(starts)
                for column, values in zip(columns, ([key] * count, starts, lengths, sums, [n] * count, sequences, offsets, [queue] * count)):
                    column.extend(values)
                if len(columns[0]) > 20_000:
                    yield batch_of()
        if columns[0]:
            yield batch_of()

    return run


def queue_name(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column else F.lit("")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", queue_column: str = "source", mixture: dict[str, float] | None = None) -> DataFrame:
    """Pack every document's tokens, and ``end_id`` after each, into sequences.

    ``mixture`` gives target token proportions by queue; without it, or for
    queues that it lacks, a queue's share of all tokens is its target.  When a
    queue runs dry, the others share its part, so nothing is dropped.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and queue.  Null text counts as empty, and an empty
    text is a document of one token.  Null sources form the queue ''.  Sources
    below half a token a window, unless ``mixture`` names them, share one queue,
    which is null in the result; their documents follow each other there in the
    order of tasks and names.  So at most ``2 * capacity`` queues (and those of
    ``mixture``) have a row on the driver.  Repeated ids are separate documents.
    An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), queue_name(queue_column).alias("queue"), whole_text(text_column).alias("text"))
    tokens = checkpointed(
        rows.mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, queue string, chunk long, before long, n long, ids binary")
    )
    chunks = checkpointed(tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("n")))
    sources = chunks.groupBy("queue").agg(F.sum("n").alias("n"))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * (2 * capacity) >= total
    found = sorted(map(tuple, sources.where(large | F.col("queue").isin(list(mixture)) if mixture else large).collect()))
    queues: list[str | None] = [q for q, _ in found]
    totals = [n for _, n in found]
    if sum(totals) < total:
        queues, totals = [*queues, None], [*totals, total - sum(totals)]
    weights = None
    if mixture is not None:
        known = sum(mixture.values()) or 1.0
        weights = [max(1, round(mixture.get(q, known * n / max(1, total)) / known * (1 << 40))) for q, n in zip(queues, totals)]
    own = spark.createDataFrame([(q, q) for q in queues if q is not None], "own string, label string")
    labelled = chunks.join(F.broadcast(own), F.col("queue") == F.col("own"), "left").select("queue", "chunk", "n", "label")
    # before a task's part of a queue come the tasks before it; within it, for the shared queue, the sources before by name
    ahead = Window.partitionBy("l").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    starts = labelled.groupBy(F.col("label").alias("l"), F.col("chunk").alias("c")).agg(F.sum("n").alias("n")).select("l", "c", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("label", "chunk").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    within = labelled.select("queue", "chunk", "label", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within"))
    bases = within.join(starts, F.col("label").eqNullSafe(F.col("l")) & (F.col("chunk") == F.col("c")))
    bases = bases.select(F.col("queue").alias("q"), F.col("chunk").alias("k"), "label", (F.col("start") + F.col("within")).alias("base"))
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer_path).get_vocab_size() > 1 << 16
    placed = tokens.join(bases, (F.col("queue") == F.col("q")) & (F.col("chunk") == F.col("k")))
    return placed.select("doc_id", "label", (F.col("base") + F.col("before")).alias("place"), "n", "ids").mapInArrow(
        _cutter(queues, totals, weights, capacity, wide),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string",
    )
