"""Encoding and decoding whole texts with a SentencePiece model, giant ones in
parallel chunks (see ``piece_lattice``).  Ids equal the library's own.

The scan is a tree: transfer matrices of FAN consecutive chunks are combined into
one, those again, up to one matrix a text, a task for every group.  On the way
down the states at a group's two ends give those at the boundaries inside it, and
with them every chunk finds its pieces alone.  No task sees more than FAN
matrices of a text, however long it is."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.common import checkpointed, let, whole_text
from evergrove.llm.piece_lattice import BLANK, START, Chunk, PieceModel, boundary_states, combined

CHUNK = 32_768  # characters
FAN = 16  # matrices that one task combines
REACH = 64  # characters of its neighbours that a chunk sees
_WORDS = 300_000  # remembered words of a worker, of up to
_LONGEST = 64  # characters, so that the memory is bounded in bytes
_UNIT = re.compile(" +[^ ]*")


class WordPieces:
    """Ids (32-bit little-endian) of strings of complete words, by memory."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.memory: dict[str, bytes] = {}

        self.alone = np.array(model.emit(BLANK), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """A whole text as written; the model puts a blank before it."""
        if not text:
            return b""
        if "  " not in text and text[0] != " " and text[-1] != " " and BLANK not in text:
            return self._joined(text.split(" "))
        return self.complete(" " + text.replace(BLANK, " "))

    def complete(self, words: str) -> bytes:
        """Complete words, each with the blanks before it."""
        return self._joined([unit[1:] for unit in _UNIT.findall(words)])

    def _joined(self, units: list[str]) -> bytes:
        memory, long = self.memory, {}
        if len(memory) > _WORDS:
            memory.clear()
        new = list({unit for unit in units if unit not in memory})
        if new:
            for unit, ids in zip(new, self.model.processor.encode(new, num_threads=1)):
                # the library gives nothing for an empty text; here it is a blank alone
                (memory if len(unit) <= _LONGEST else long)[unit] = np.array(ids, "<u4").tobytes() if unit else self.alone
        if long:
            return b"".join([memory[unit] if unit in memory else long[unit] for unit in units])
        return b"".join(map(memory.__getitem__, units))


@lru_cache(maxsize=1)
def worker_model(path: str) -> PieceModel:
    """The process's own model; what it remembers serves all its tasks."""
    return PieceModel(path)


@lru_cache(maxsize=1)
def worker_words(path: str) -> WordPieces:
    return WordPieces(worker_model(path))


#: What a part's ids become: the ids themselves, or a digest of them and of the
#: text that they decode to.
_IDS = [("ids", pa.binary())]
_DIGEST = [("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("text_crc32", pa.int64()), ("n_bytes", pa.int64())]
_DDL = {"ids": "ids binary", "digest": "n_ids long, ids_crc32 long, text_crc32 long, n_bytes long"}


def _decoded(raw: list[bytes], ids: bytes, part: int) -> bytes:
    """UTF-8 of one part's text; the blank before the first part is the model's."""
    text = b"".join(map(raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return text[1:] if part == 0 and text.startswith(b" ") else text


def _results(model: PieceModel, ids: list[bytes], parts: list[int], form: str) -> list[pa.Array]:
    if form == "ids":
        return [pa.array(ids, pa.binary())]
    texts = [_decoded(model.raw, x, part) for x, part in zip(ids, parts)]
    columns = ([len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [zlib.crc32(t) for t in texts], [len(t) for t in texts])
    return [pa.array(c, pa.int64()) for c in columns]


def _encode_whole(path: str, form: str):
    schema = pa.schema([("doc_id", pa.int64()), *(_IDS if form == "ids" else _DIGEST)])

    def run(batches):
        words = worker_words(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [words(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *_results(words.model, ids, [0] * len(ids), form)], schema=schema)

    return run


def _chunk(model: PieceModel, context: str, before: int, length: int, final: bool) -> Chunk:
    return Chunk(model, context, before, before + length, final)


def _matrices(path: str):
    schema = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("matrix", pa.string())])

    def run(batches):
        model = worker_model(path)
        for batch in batches:
            for row, k, context, before, length, final in zip(*(c.to_pylist() for c in batch.columns)):
                packed = _packed(_chunk(model, context, before, length, final).matrix())
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([k]), pa.array([packed])], schema=schema)

    return run


def _packed(matrix) -> str:
    return json.dumps([[list(entry), [[list(leave), weight] for leave, weight in row.items()]] for entry, row in matrix.items()])


def _opened(packed: str):
    return {tuple(entry): {tuple(leave): weight for leave, weight in row} for entry, row in json.loads(packed)}


def _combine(key, frame):
    """Up the tree: a group's matrices to their product."""
    import pandas as pd

    matrices = [_opened(packed) for packed in frame.sort_values("k")["matrix"]]
    return pd.DataFrame({"row": [key[0]], "k": [key[1]], "matrix": [_packed(combined(matrices))]})


def _divide(key, frame):
    """Down the tree: the states at a group's ends to those at its members' ends."""
    import pandas as pd

    frame = frame.sort_values("k")
    first, last = (tuple(json.loads(frame[end].iloc[0])) for end in ("entry", "leave"))
    states = [json.dumps(list(state)) for state in boundary_states([_opened(packed) for packed in frame["matrix"]], first, last)]
    return pd.DataFrame({"row": key[0], "k": frame["k"], "entry": states[:-1], "leave": states[1:]})


def chunk_states(matrices: DataFrame, last: int) -> DataFrame:
    """(row, k, matrix) of all chunks, whose largest k is ``last``, to (row, k,
    entry, leave): the best path's states at both ends of every chunk."""
    levels = [matrices]
    group = F.floor(F.col("k") / FAN)
    while last > 0:
        levels.append(checkpointed(levels[-1].groupBy("row", group.alias("g")).applyInPandas(_combine, "row long, k long, matrix string")))
        last //= FAN
    ends = json.dumps(list(START))
    states = levels.pop().select("row", "k", F.lit(ends).alias("entry"), F.lit(ends).alias("leave"))
    while levels:
        above = states.select(F.col("row").alias("r"), F.col("k").alias("g"), "entry", "leave")
        within = levels.pop().join(above, (F.col("row") == F.col("r")) & (group == F.col("g"))).select("row", "g", "k", "matrix", "entry", "leave")
        states = checkpointed(within.groupBy("row", "g").applyInPandas(_divide, "row long, k long, entry string, leave string"))
    return states


def _backtrace(path: str, form: str):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), *(_IDS if form == "ids" else _DIGEST)])

    def run(batches):
        model, words = worker_model(path), worker_words(path)

        def complete(text: str) -> list[int]:
            return np.frombuffer(words.complete(text.replace(BLANK, " ")), "<u4").tolist()

        for batch in batches:
            for doc, row, k, context, before, length, final, entry, leave in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _chunk(model, context, before, length, final).pieces(tuple(json.loads(entry)), tuple(json.loads(leave)), complete)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([row]), pa.array([k]), *_results(model, [np.array(ids, "<u4").tobytes()], [k], form)], schema=schema)

    return run


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, form: str = "ids") -> DataFrame:
    """(doc_id, part, row, ids): the ids of every whole text as 32-bit little-endian
    binary.  Texts of up to ``chunk`` characters have one part, 0; longer ones a
    part per chunk, whose ids follow each other in order of ``part``; ``row`` tells
    giant texts with one id apart.  With ``form`` 'digest', n_ids, ids_crc32, and
    text_crc32 and n_bytes of the decoded text instead of the ids.

    Null text counts as empty and has no ids.  Repeated rows give repeated
    results, null ids are kept, other columns are ignored, and an empty table
    gives an empty result.
    """
    text = whole_text(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    size = F.char_length("text")
    short = rows.where(size <= chunk).mapInArrow(_encode_whole(model_path, form), f"doc_id long, {_DDL[form]}").withColumn("part", F.lit(0).cast("long"))
    # a giant row gets a number of its own, since ids may repeat; chunks carry their neighbours' edges
    marked = F.concat(F.lit(BLANK), F.translate("text", " ", BLANK))
    cut = F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{chunk}}}+"), F.lit(0))
    near = -(-REACH // chunk)  # neighbours that REACH takes

    def in_context(parts):
        def one(own, k):
            left = F.right(F.array_join(F.slice(parts, F.greatest(k + 1 - near, F.lit(1)), F.least(k, F.lit(near))), ""), F.lit(REACH))
            after = F.left(F.array_join(F.slice(parts, k + 2, F.lit(near)), ""), F.lit(REACH))
            return F.struct(
                k.cast("long").alias("k"), F.concat(left, own, after).alias("context"), F.char_length(left).alias("before"), F.char_length(own).alias("length"), (k == F.size(parts) - 1).alias("final")
            )

        return F.transform(parts, one)

    # cut in one pass, and joined to neighbours before rows are multiplied
    giant = rows.where(size > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), let(cut, in_context).alias("pieces"))
    pieces = giant.select("doc_id", "row", F.explode("pieces").alias("p")).select("doc_id", "row", "p.*")
    chunks = checkpointed(pieces.repartition("row", "k"))
    columns = ["row", "k", "context", "before", "length", "final"]
    matrices = checkpointed(chunks.select(*columns).mapInArrow(_matrices(model_path), "row long, k long, matrix string"))
    states = chunk_states(matrices, matrices.agg(F.max("k")).first()[0] or 0)
    known = chunks.join(states.select(F.col("row").alias("r"), F.col("k").alias("j"), "entry", "leave"), (F.col("row") == F.col("r")) & (F.col("k") == F.col("j")))
    long = known.select("doc_id", *columns, "entry", "leave").mapInArrow(_backtrace(model_path, form), f"doc_id long, row long, part long, {_DDL[form]}")
    return short.withColumn("row", F.lit(None).cast("long")).unionByName(long)


def _decoder(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches):
        raw = worker_model(path).raw
        for batch in batches:
            texts = [_decoded(raw, ids, part).decode("utf-8", "replace") for part, ids in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(texts, pa.string())], schema=schema)

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``text`` to (doc_id, part, row, ids): each part's text; parts of one
    text follow each other.  A chunk ends between characters, so parts decode on
    their own."""
    return encoded.select("doc_id", "part", "row", "ids").mapInArrow(_decoder(model_path), "doc_id long, part long, row long, ids binary, text string")


def encode_report(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per part: doc_id, part, n_ids, ids_crc32 (of the 32-bit ids), and
    the CRC and bytes of the text that the ids decode to."""
    return encode(docs, model_path, form="digest").select("doc_id", "part", "n_ids", "ids_crc32", "text_crc32", "n_bytes")
