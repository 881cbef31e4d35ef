"""Exact copies, fingerprints and near duplicates against brute force."""

import hashlib
import random
import re
import struct
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evergrove.llm import components
from evergrove.llm.common import Scratch, checkpoint_folder
from evergrove.llm.components import connected_components
from evergrove.llm.exact_dedup import drop_copies, exact_dedup, grace
from evergrove.llm.fingerprints import GRAM, SPACED, WINDOW, fingerprint_edits, fingerprints
from evergrove.llm.near_dedup import MinMax, Shingles, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, digest long, count string, node int, bucket int"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y", 2, 3) for i, t in rows], SCHEMA)


EDGES = [(1, "a b c d e f"), (2, "a b c d e f"), (7, None), (5, ""), (9, None), (3, "x"), (3, "x"), (4, "x" * 50_000), (6, "x" * 50_000 + "y"), (None, "z"), (None, "a b c d e f"), (8, "é ü\n\t ñ"), (10, "   ")]


# --- exact -----------------------------------------------------------------------


def test_exact_edges(spark):
    found = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup(table(spark, EDGES)).collect())
    groups = {}
    for i, t in EDGES:
        groups.setdefault(t or "", []).append(i)
    want = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i or -1, keep or -1, len(ids), i == keep) for i in ids]
    assert found == sorted(want)


def test_exact_digest_and_empty_table(spark):
    rows = {r["doc_id"]: r["text_sha256"] for r in exact_dedup(table(spark, EDGES).where("doc_id is not null")).collect()}
    assert rows[7] == hashlib.sha256(b"").hexdigest() and rows[8] == hashlib.sha256("é ü\n\t ñ".encode()).hexdigest()
    assert exact_dedup(table(spark, [])).count() == 0


def test_drop_copies_keeps_all_columns(spark):
    docs = table(spark, EDGES)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3, 4, 6, 8, 9, 10]


def test_drop_copies_beside_clashing_names(spark):
    rows = [(1, "a", 1, 5, 0), (None, "b", 2, 6, 0), (None, "b", 2, 6, 0), (4, "a", 3, 7, 0), (4, "a", 3, 7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, _digest int, ties int")
    assert sorted(drop_copies(docs).collect(), key=lambda r: r["text"]) == [(4, "a", 3, 7, 0), (None, "b", 2, 6, 0)]
    assert drop_copies(docs.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=4), st.integers(0, 50)), max_size=60), st.integers(1, 2000), st.integers(2, 16))
def test_grace_with_little_memory(rows, memory, fanout):
    records = [(hashlib.sha256(t.encode()).digest(), t, i, 1, 1) for t, i in rows]
    found = {c: (k, n, ties) for _, c, k, n, ties in grace(records, memory, fanout)}
    ids = {}
    for t, i in rows:
        ids.setdefault(t, []).append(i)
    assert found == {t: (max(own), len(own), own.count(max(own))) for t, own in ids.items()}


def test_grace_compares_contents():
    same = hashlib.sha256(b"same").digest()
    assert sorted(c for _, c, *_ in grace([(same, "a", 1, 1, 1), (same, "b", 2, 1, 1), (same, "a", 3, 1, 1)], 300, 4)) == ["a", "b"]


# --- fingerprints ------------------------------------------------------------------

UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"


def tokens_of(text):
    found = []
    for run in re.findall(f"[{UNSPACED}]|[^\\s{UNSPACED}]+", text):
        found += [*run[:-16], run[-16:]] if len(run) > 16 else [run]
    return found


def hashed(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)


def turned(value, by=1):
    by %= 64
    return (value << by | value >> (64 - by)) % (1 << 64)


def grams(text, gram=GRAM):
    """Hashes that really roll: one token leaves, one enters."""
    tokens = [hashed(t) for t in tokens_of(text)]
    if len(tokens) >= gram:
        rolling, out = 0, []
        for k, value in enumerate(tokens):
            rolling = turned(rolling) ^ value ^ (turned(tokens[k - gram], gram) if k >= gram else 0)
            if k >= gram - 1:
                out.append(rolling)
        return out
    if tokens:
        return [hashed(",".join(str(t - (1 << 64) if t >> 63 else t) for t in tokens))]
    return [hashed(text)] if text else []


def winnowed(text, gram=GRAM, width=WINDOW):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    found, chosen = grams(text, gram), []
    for start in range(max(1, len(found) - width + 1)) if found else []:
        window = found[start : start + width]
        best = start + min(range(len(window)), key=lambda j: (signed(window[j]), -j))
        if not chosen or chosen[-1] != best:
            chosen.append(best)
    return [(found[k], k) for k in chosen]


TEXTS = [" ".join(random.Random(k).choices("alpha beta gamma delta eps zeta eta".split(), k=k * 7)) for k in range(12)] + [None, "", " ", "one", "x" * 3000, "日本語のテキスト です", "same " * 100]


@pytest.mark.parametrize("gram, window", [(GRAM, WINDOW), (1, 1), (5, 8), (3, 4), (7, 2)])
def test_winnowing_is_the_brute_force(spark, gram, window):
    docs = table(spark, list(enumerate(TEXTS)))
    for r in fingerprints(docs, gram=gram, window=window).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert r["n_chars"] == len(text)
        assert [(p["hash"] % (1 << 64), p["position"]) for p in r["prints"]] == winnowed(text, gram, window)


def test_edits_of_whole_documents_are_the_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    found = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    prints = {i: {h for h, _ in winnowed(t)} for i, t in order}
    for k, (i, text) in enumerate(order):
        after, following = order[(k + 1) % len(order)]  # the last is followed by the first
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert found[i]["near_edited"] == pytest.approx(like(prints[i], {h for h, _ in winnowed(edited)}))
        assert found[i]["near_next"] == pytest.approx(like(prints[i], prints[after]))


def test_long_runs_share_prints_at_any_offset(spark):
    rng = random.Random(5)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200))
    rows = [(1, "start " + run + " end"), (2, "q" + run + "zz other"), (3, "xyz" + run)]
    prints = {r["doc_id"]: {p["hash"] for p in r["prints"]} for r in fingerprints(table(spark, rows)).collect()}
    assert all(len(prints[a] & prints[b]) > 50 for a, b in ((1, 2), (1, 3), (2, 3)))


def test_every_code_point_is_of_one_class():
    spaced, unspaced = re.compile("[" + SPACED.replace("\\x{10ffff}", "\\U0010ffff") + "]"), re.compile(f"[{UNSPACED}]")
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        assert (spaced.match(c) is not None) + (unspaced.match(c) is not None) + (c in " \t\n\x0b\f\r") == 1


def test_shared_passages_share_prints():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    shared = rng.choices(words, k=WINDOW + GRAM - 1)
    left, right = (" ".join([*rng.choices(words, k=50), *shared, *rng.choices(words, k=50)]) for _ in range(2))
    assert {h for h, _ in winnowed(left)} & {h for h, _ in winnowed(right)}


def test_edited_texts(spark):
    rows = [(i * 3 % 41, t) for i, t in enumerate(TEXTS)] + [(40, "tie one"), (40, "tie two"), (None, "no id")]
    found = fingerprint_edits(table(spark, rows)).collect()
    order = sorted(((i, t or "") for i, t in rows if i is not None and i != 40), reverse=True)
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:]):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = {h for h, _ in winnowed(t)}, {h for h, _ in winnowed(edited)}
        assert by_id[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_edits_of_one_document_and_of_none(spark):
    assert fingerprint_edits(table(spark, [(1, "abcdef")])).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprint_edits(table(spark, [])).count() == 0


def test_short_edited_texts_are_alike(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    rows = [(k, " ".join(rng.choices(words, k=6 + k % 34))) for k in range(102)]
    for r in fingerprint_edits(table(spark, rows)).collect():
        assert r["near_edited"] > r["near_next"] and len(r["fingerprint"].split()) > 1


def test_passages_of_unspaced_scripts_share_prints(spark):
    rng = random.Random(8)
    for first, last in ((0x0E01, 0x0E2E), (0x0E81, 0x0EAE), (0x1000, 0x1021), (0x1780, 0x17A2)):
        some = lambda n: "".join(chr(rng.randint(first, last)) for _ in range(n))  # noqa: E731, B023
        passage = some(64)
        left, right = (({p["hash"] for p in r["prints"]}) for r in fingerprints(table(spark, [(1, some(32) + passage), (2, some(37) + passage)])).collect())
        assert len(left & right) > 20


# --- near duplicates ----------------------------------------------------------------


def shingles(text, words):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute_components(rows, words):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, words))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(sets, 2):
        if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def corpus(seed, groups=12, copies=9, length=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for g in range(groups):
        base = rng.choices(words, k=length)
        for _ in range(rng.randint(1, copies) if g else 40):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(length)] = rng.choice(words)
            rows.append((at, " ".join(own)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_the_brute_force(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b"), (1005, " a\tb\n"), (1006, "É x y"), (1007, "é x y")]
    found = {r["doc_id"]: r for r in near_duplicates(table(spark, rows), words=2).collect()}
    want = brute_components(rows, 2)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingles(dict(rows)[i], 2)) for i, r in found.items())


def test_near_edges(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (None, None), (2, None), (3, "p q r s"), (3, "t u v w"), (4, "t u v w"), (5, "p q r s")]
    found = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_duplicates(table(spark, rows)).collect() if r["doc_id"] is not None)
    assert found == [(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False)]
    assert all(r["kept"] for r in near_duplicates(table(spark, rows)).where("doc_id is null").collect())
    assert near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[(3, "p q r s"), (3, "t u v w"), (2, "t u v w"), (5, "p q r s")], [(9, "p q r s"), (9, "t u v w"), (2, "t u v w"), (5, "p q r s"), (9, "p q r s")]])
def test_an_id_with_several_texts_connects_their_groups(spark, rows):
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(table(spark, rows)).collect()}
    assert found == {(i, 2, i == 2) for i, _ in rows}


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_ids_are_the_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [t for _, t in corpus(seed, groups=25, copies=6, length=12)]
    rows = [(rng.randrange(150), t) for t in texts for _ in range(rng.choice([1, 1, 1, 2]))]
    want = brute_components(rows, 2)
    assert {(r["doc_id"], r["component_id"]) for r in near_duplicates(table(spark, rows), words=2).collect()} == set(want.items())


def test_recall_over_a_family_of_thousands(spark):
    """Variants of few templates, most pairs near the limit: components equal the brute force's."""
    rng = random.Random(11)
    words, rows = [f"w{k}" for k in range(900)], []
    for base in (rng.choices(words, k=40) for _ in range(12)):
        for _ in range(150):
            own = list(base)
            for at in rng.sample(range(40), rng.randint(1, 4)):
                own[at] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    sets = {i: shingles(t, 2) for i, t in rows}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if i // 150 == j // 150 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(table(spark, rows), words=2).collect()}
    assert found == {i: root(i) for i, _ in rows}


def test_no_band_holds_both_ends_of_a_permutation():
    for bands, rows in ((32, 5), (40, 5), (7, 3)):
        minmax = MinMax(bands, rows)
        assert all(len({int(k) % len(minmax.a) for k in band}) == rows for band in minmax.order)
        assert len({int(k) for k in minmax.order.ravel()}) == bands * rows


def test_scratch_tables_are_gone_and_results_stay(spark):
    import glob

    folder = checkpoint_folder(spark).removeprefix("file:")
    docs = table(spark, corpus(7, groups=4))
    found = near_duplicates(docs, words=2)
    assert glob.glob(f"{folder}/scratch-*") == []
    assert found.count() == docs.count() and found.where("not kept").count() > 0
    with pytest.raises(ZeroDivisionError), Scratch(spark) as own:
        own.table(spark.range(3), "t")
        assert glob.glob(f"{folder}/scratch-*/t") != []
        own.drop("t")
        assert glob.glob(f"{folder}/scratch-*/t") == []
        raise ZeroDivisionError
    assert glob.glob(f"{folder}/scratch-*") == []


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        checkpoint_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        checkpoint_folder(Session())


def test_min_max_estimates_are_unbiased():
    rng = random.Random(5)
    sign, cut = MinMax(bands=40, rows=5), Shingles(1)
    a = [f"w{k}" for k in range(300)]
    b = a[:240] + [f"v{rng.random()}" for _ in range(60)]
    x, y = (sign.signature(cut(" ".join(t).encode())) for t in (a, b))
    assert abs((x == y).mean() - 240 / 360) < 0.1


def test_a_star_is_dealt_to_several_tasks(spark, monkeypatch):
    """Of 100,000 edges at one node no key holds more than the bound."""
    monkeypatch.setattr(components, "HEAVY", 50)
    edges = spark.range(1, 100_001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    for star in (edges, turned):
        plan = components._with_least(star, components._least(star), 100_000)
        assert plan.count() == 100_000
        found = {(r["node"], r["component"]) for r in connected_components(star).where("node % 9999 < 2").collect()}
        assert all(c == 0 for _, c in found) and len(found) == 22
    most = 2 * 100_000 // 50
    salts = turned.select(F.pmod(F.xxhash64("v"), F.lit(100_000 // most)).alias("salt")).groupBy("salt").count()
    assert salts.agg(F.max("count")).first()[0] < 1.2 * most


@pytest.mark.parametrize("task_edges, heavy", [(200_000, 5_000), (11, 5_000), (11, 3)])
def test_connected_components(spark, monkeypatch, task_edges, heavy):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    monkeypatch.setattr(components, "HEAVY", heavy)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 540)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    assert found == {n: root(n) for n in parent if any(u != v and n in (u, v) for u, v in edges)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_queries_do_not_depend_on_other_columns(spark):
    docs = table(spark, [(1, "a b c"), (2, "a b c")]).withColumn("component", F.lit(5)).withColumn("hashes", F.lit("h"))
    assert [r["component_id"] for r in near_duplicates(docs).collect()] == [1, 1]
