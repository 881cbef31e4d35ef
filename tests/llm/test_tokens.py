"""SentencePiece scans, packing and the pipeline."""

import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evergrove.llm import sentencepieces
from evergrove.llm.packing import BLOCK, Mixture, pack, tail_lengths
from evergrove.llm.piece_lattice import BLANK, START, Chunk, PieceModel, boundary_states, combined, product
from evergrove.llm.sentencepieces import WordPieces, decode, encode
from evergrove.llm.word_bpe import WordEncoder

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " a", "a  b ", " ", "x   y", "日本語 テスト emoji 😀 é\n\tz", "aaaaaaaaaaaaaaaaaaaa", "don't 'super l'été ½²", "İstanbul ǅ x", "a\u0085b c\x1cd", "<|endoftext|> hi<|startoftext|>", "é ́x", "a\x00b", "supercalifragilistic" * 30, "  " * 40 + "x"]


@pytest.fixture(scope="module")
def model():
    return PieceModel(PIECES)


def in_chunks(model, text, size, reach=64):
    words = WordPieces(model)
    full = BLANK + text.replace(" ", BLANK)
    chunks = []
    for begin in range(0, len(full), size):
        before, length = min(begin, reach), min(size, len(full) - begin)
        chunks.append(Chunk(model, full[begin - before : begin + length + reach], before, before + length, begin + length == len(full)))
    matrices = [c.matrix() for c in chunks]
    states = boundary_states(matrices)
    complete = lambda t: np.frombuffer(words.complete(t.replace(BLANK, " ")), "<u4").tolist()
    return [i for c, a, b in zip(chunks, states, states[1:]) for i in c.pieces(a, b, complete)], matrices


@pytest.mark.parametrize("size", [3, 17, 200])
def test_chunked_ids_are_the_library_s(model, size):
    for text in ODD:
        if text:
            assert in_chunks(model, text, size)[0] == model.processor.encode(text), repr(text)


@settings(max_examples=40, deadline=None)
@given(st.text("abcdeor thé ing.\n", min_size=1, max_size=120), st.integers(1, 40))
def test_random_texts_in_chunks(text, size):
    model = _shared()
    assert in_chunks(model, text, size)[0] == model.processor.encode(text)


_MODELS = []


def _shared():
    if not _MODELS:
        _MODELS.append(PieceModel(PIECES))
    return _MODELS[0]


def test_products_are_associative(model):
    _, m = in_chunks(model, "some words and antidisestablishmentarianism again", 9)
    assert product(product(m[0], m[1]), m[2]) == product(m[0], product(m[1], m[2]))
    assert START in m[0]


def test_combining_by_halves_is_the_fold(model):
    text = "antidisestablishmentarianism and floccinaucinihilipilification " * 4
    _, m = in_chunks(model, text, 7)
    fold = m[0]
    for matrix in m[1:]:
        fold = product(fold, matrix)
    assert combined(m) == fold
    states = boundary_states(m)
    for a in range(0, len(m), 5):
        b = min(a + 5, len(m))
        assert boundary_states(m[a:b], states[a], states[b]) == states[a : b + 1]


def test_deep_trees(spark, model, monkeypatch):
    """Groups of three matrices, up to several levels."""
    monkeypatch.setattr(sentencepieces, "FAN", 3)
    rows = [(1, "some ordinary words of a long text " * 60), (2, "z" * 1500), (3, "x y " * 33), (1, "again number one, " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(list)
    for r in sorted(encode(docs, PIECES, chunk=50).collect(), key=lambda r: (r["row"], r["part"])):
        found[r["row"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert sorted(found.values()) == sorted(model.processor.encode(t) for _, t in rows)


def test_cutting_takes_time_in_proportion(spark):
    import time

    took = []
    for n in (1_000_000, 2_000_000, 4_000_000):
        docs = spark.createDataFrame([(1, "some words é " * (n // 13))], "doc_id long, text string")
        began = time.perf_counter()
        encode(docs, PIECES, form="digest").collect()
        took.append(time.perf_counter() - began)
    assert took[2] < 2.6 * took[1]


def test_encode_and_decode_tables(spark, model):
    rows = [*enumerate(ODD), (50, None), (None, "no id"), (3, "twice"), (60, "long words " * 400), (61, "z" * 900)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, part int, row string")
    parts = decode(encode(docs, PIECES, chunk=100), PIECES).collect()
    texts, ids = defaultdict(list), defaultdict(list)
    for r in sorted(parts, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["row"] or 0, r["part"])):
        texts[r["doc_id"]].append(r["text"])
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    for i, t in rows:
        if i != 3:
            assert ids[i] == model.processor.encode(t or "")
            assert "".join(texts[i]) == (t or "")
    assert encode(docs.limit(0), PIECES).count() == 0


def test_word_encoder_is_the_tokenizer(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    tokenizer, encoder = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.width).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


# --- packing ---------------------------------------------------------------------------


def check_packing(rows, found, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["queue"]))
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
    return sequences


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "q", 2) for i, t, s in rows], "doc_id long, text string, source string, start int, queue string, n int")


def test_packing_round_trip_and_proportions(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 90))), rng.choice(["big", "big", "big", "b", "c", None])) for k in range(120)] + [(500, None, "c"), (501, "", "b"), (502, "x " * 3000, "long")]
    found = pack(documents(spark, rows).repartition(5), WORDS, capacity=256).collect()
    sequences = check_packing([(i, t) for i, t, _ in rows], found, 256)
    total = Counter()
    for r in found:
        total[r["queue"]] += r["length"]
    everything = sum(total.values())
    for own in sequences.values():
        if sum(n for _, n, _ in own) == 256:
            share = Counter()
            for _, n, q in own:
                share[q] += n
            assert all(abs(share[q] - 256 * total[q] / everything) < 3 for q in total)


def test_mixture_targets(spark):
    rows = [(k, "word " * 200, "a" if k % 2 else "b") for k in range(40)]
    found = pack(documents(spark, rows), WORDS, capacity=128, mixture={"a": 3.0, "b": 1.0}).collect()
    sequences = check_packing([(i, t) for i, t, _ in rows], found, 128)
    first = Counter()
    for _, n, q in sequences[0]:
        first[q] += n
    assert abs(first["a"] - 96) <= 2


def test_many_small_sources_share_a_queue(spark):
    """Sources below half a token a window: one queue, nothing lost, the large ones keep their share."""
    rows = [(k, "word " * (1 + k % 9), f"s{k}") for k in range(300)] + [(1000 + k, "word " * 20, "large") for k in range(60)]
    found = pack(documents(spark, rows).repartition(4), WORDS, capacity=32).collect()
    sequences = check_packing([(i, t) for i, t, _ in rows], found, 32)
    assert {r["queue"] for r in found} == {"large", None}
    part = sum(r["length"] for r in found if r["queue"]) / sum(r["length"] for r in found)
    for own in sequences.values():
        if sum(n for _, n, _ in own) == 32:
            assert abs(sum(n for _, n, q in own if q) - 32 * part) < 3
    named = pack(documents(spark, rows), WORDS, capacity=32, mixture={"large": 1.0, "s7": 1.0}).collect()
    check_packing([(i, t) for i, t, _ in rows], named, 32)
    assert {r["queue"] for r in named} == {"large", "s7", None}


def test_memories_are_bounded_in_bytes():
    from evergrove.llm import sentencepieces, toxicity, word_bpe

    rng = random.Random(3)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(5_000)) for _ in range(30)] + ["a " + "b" * 70_000 + " c"]
    encoder = word_bpe.WordEncoder(WORDS)
    encoder.words.most = 50_000
    words, lexicon = sentencepieces.WordPieces(PieceModel(PIECES)), toxicity.Lexicon({"x": 1.0})
    for text in [*texts, *(f"w{k} v{k}" for k in range(2_000))]:
        encoder.encode(text)
        words(text)
        list(map(lexicon.weight, text.split()))
        held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in encoder.words.items())
        assert held <= 50_000
    assert all(len(w) <= 64 for memory in (words.memory, lexicon.memory, encoder.words) for w in memory)


def test_packing_edges(spark):
    assert pack(documents(spark, []), WORDS).count() == 0
    one = pack(documents(spark, [(7, None, None)]), WORDS).collect()
    assert [(r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in one] == [(0, 1, 1, 0, 0)]
    twice = pack(documents(spark, [(7, "a b", "s"), (7, "a b", "s")]), WORDS).collect()
    assert sum(r["length"] for r in twice) == 6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4000), min_size=1, max_size=6), st.sampled_from([16, 64, 100]))
def test_mixture_serves_every_token_once(totals, capacity):
    mixture = Mixture(totals, None, capacity)
    seen = set()
    for queue, total in enumerate(totals):
        at = 0
        while at < total:
            length = min(37, total - at)
            for start, n, window, offset in mixture.pieces(queue, at, length):
                del start
                seen.update((window, k) for k in range(offset, offset + n))
            at += length
    everything = sum(totals)
    assert len(seen) == everything
    assert seen == {(k // capacity, k % capacity) for k in range(everything)}


@pytest.mark.parametrize("seed", range(12))
def test_parallel_blocks_are_the_serial_rounds_to_a_few_tokens(seed):
    """Rounds from the first window on, deficits carried all the way, against
    blocks that begin with the closed form."""
    rng = random.Random(seed)
    totals = [rng.randint(1, 60_000) for _ in range(rng.randint(1, 9))]
    capacity = rng.choice([16, 64, 100])
    mixture = Mixture(totals, None if seed % 2 else [rng.randint(1, 1000) for _ in totals], capacity)
    left, deficit, served = np.array(totals), np.zeros(len(totals)), np.zeros(len(totals), dtype=np.int64)
    for window in range(mixture.windows):
        first, rows, _ = mixture.block(window // BLOCK)
        assert np.abs(rows[window - first] - served).max() <= 6
        give = mixture._round(min(capacity, int(left.sum())), left, deficit, np.array(mixture.weights, dtype=float))
        left, served = left - give, served + give
    assert served.tolist() == totals


def test_tail():
    assert tail_lengths(1300) == [1024, 256, 16, 4] and tail_lengths(0) == []


# --- pipeline ---------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(rows, docs.schema)
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) >= len(texts) - 2  # redaction may make two alike
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    # where documents are cut depends on the order in which their files are read; which documents and tokens there are does not
    whole = lambda pieces: sorted((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0)
    again = P.run(spark, SF).collect()
    assert whole(again) == whole(rows) and sum(r["length"] for r in again) == sum(r["length"] for r in rows)


EDGES = [(1, None), (2, ""), (3, "some ordinary words here, and more of them to read."), (3, "another ordinary text under the same number."), (None, "a text without a number, as plain as others."), (None, "a text without a number, as plain as others."), (4, "x" * 60_000), (5, "some ordinary words here, and more of them to read."), (5, "some ordinary words here, and more of them to read."), (6, " \n\t ")]


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, no labels, no rows, clashing names."""
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = "doc_id long, text string, lang string, source string, n_chars long, i long, d string, dropped long, digest string, keep int, component_id long, spans string"
    for rows in (EDGES, []):
        docs = spark.createDataFrame([(i, t, "en", None, None, 1, "x", 2, "y", 3, 4, "z") for i, t in rows], extra)
        left = []
        for name, stage in P.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, str(tmp_path))).collect(), out.schema)
            left.append([(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else docs.collect())
            assert rows or not left[-1], name
        if rows:
            key = lambda r: (r[0] or 0, r[1] or "")
            assert sorted(left[0], key=key) == sorted(EDGES, key=key)
            want = [EDGES[3], EDGES[4], (4, "x" * 60_000), EDGES[8], EDGES[1], EDGES[9]]
            assert sorted(left[1], key=key) == sorted(left[2], key=key) == sorted(left[3], key=key) == sorted(want, key=key)
            assert sorted((r["doc_id"] or 0) for r in left[4] if r["start"] == 0) == [0, 2, 3, 4, 5, 6]


def test_one_id_with_a_good_and_a_bad_text(spark):
    """Each text is decided on its own, also under a null id."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["text"] for r in P.keep_good(spark, docs, SF).collect()}
    texts = [r["text"] for r in docs.collect()]
    good, bad = next(t for t in texts if t in kept), next(t for t in texts if t not in kept)
    more = spark.createDataFrame([(10**9, good, "en", "s", 1), (10**9, bad, "en", "s", 1), (None, good, "en", "s", 1), (None, bad, "en", "s", 1)], docs.schema)
    found = [(r["doc_id"], r["text"]) for r in P.keep_good(spark, docs.unionByName(more), SF).where("doc_id is null or doc_id = 1000000000").collect()]
    assert sorted(found, key=str) == sorted([(10**9, good), (None, good)], key=str)


def test_pipeline_stages_drop_the_right_rows(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unique = P.drop_exact_copies(spark, docs, SF).collect()
    by_text = {}
    for r in docs.collect():
        by_text[r["text"]] = max(by_text.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in unique} == set(by_text.values())
    assert P.redact_personal_data(spark, docs, SF).count() == docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in P.keep_good(spark, docs, SF).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept for i in good]) > 0.97
