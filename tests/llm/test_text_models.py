"""Classifiers, language models, secrets and personal data."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evergrove.llm.boosting import fit_boosted, fit_isotonic, sigmoid
from evergrove.llm.forest import fit_forest, forest_share
from evergrove.llm.lm_scoring import ALPHA, KAPPA, score_by_cross_entropy
from evergrove.llm.pii import KINDS, NO_SPANS, earliest, find_pii, pii_report, redacted, without_overlap
from evergrove.llm.quality import score_quality, statistics
from evergrove.llm.secret_scan import secret_report
from evergrove.llm.toxicity import Lexicon, score_toxicity, toxic_features

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, x string, label int, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, "y") for i, t in rows], SCHEMA)


def labels_of(spark, column, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], f"doc_id long, {column} int")


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "a" * 100_000), (5, "One word."), (5, "One word."), (None, "no id here"), (6, "日本語 текст")]


def accuracy(spark, scores, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in scores if r["held_out"] and r["doc_id"] in labels]
    return np.mean([p == y for p, y, _ in known]), known


# --- quality ------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = score_quality(docs, labels).collect()
    assert len(scores) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scores)
    assert accuracy(spark, scores, "quality")[0] > 0.95


def test_quality_edges(spark):
    good = [(k, " ".join(random.Random(k).choices("the man saw a dog near his old house by the river and went home again".split(), k=80)) + ".") for k in range(20, 60)]
    bad = [(k, "### " * 50 + "buy " * 60) for k in range(60, 90)]
    labels = labels_of(spark, "quality", [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (1, None), (2, 7)])
    found = score_quality(table(spark, EDGES + good + bad), labels).collect()
    assert len(found) == len(EDGES) + len(good) + len(bad) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["predicted"] == 0 for r in found if r["doc_id"] in range(60, 90)) and all(r["predicted"] == 1 for r in found if r["doc_id"] in range(20, 60))
    assert all(r["score"] == pytest.approx(0.5) for r in score_quality(table(spark, EDGES), labels.limit(0)).collect())
    assert score_quality(table(spark, []), labels).count() == 0


def test_statistics_are_finite():
    for text in ("", " ", "a", "\n\n\n", "|" * 500, "x" * 1000, "A B " * 300):
        assert np.isfinite(statistics(text)).all()


# --- toxicity -----------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scores = score_toxicity(docs, labels).collect()
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(r["predicted"], known[r["doc_id"]]) for r in scores if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scores)
    assert np.mean([p == y for p, y in held]) > 0.96
    assert np.mean([p for p, y in held if y]) > 0.7 and np.mean([p for p, y in held if not y]) < 0.02


def test_toxicity_edges(spark):
    labels = labels_of(spark, "toxic", [(1, 0), (2, None), (None, 1)])
    found = score_toxicity(table(spark, EDGES), labels).collect()
    assert len(found) == len(EDGES) and all(0 <= r["score"] <= 1 for r in found)
    assert score_toxicity(table(spark, []), labels).count() == 0


def test_hidden_words_are_seen():
    index = 5
    for text in ("you are an id1ot here", "what an i d i o t", "m0r0n indeed"):
        assert toxic_features(text, Lexicon({}))[index] >= 1
    assert toxic_features("a quiet day in 1984 at 5 pm", Lexicon({}))[index] == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((sigmoid(fit_boosted(x, y).margin(x)) > 0.5) == y).mean() > 0.95
    assert fit_boosted(x, np.zeros(2000)).trees == []


def test_forest_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x[:, 2] > 0.3).astype(float)
    assert ((forest_share(fit_forest(x, y), x) > 0.5) == y).mean() > 0.93


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.integers(0, 1)), min_size=1, max_size=60))
def test_isotonic_never_falls(pairs):
    margin, y = np.array([m for m, _ in pairs]), np.array([float(v) for _, v in pairs])
    out = fit_isotonic(margin, y)(np.linspace(-6, 6, 50))
    assert (np.diff(out) >= -1e-12).all() and (out > 0).all() and (out < 1).all()


# --- language models -------------------------------------------------------------------


def test_scores_are_the_brute_force(spark):
    rng = random.Random(2)
    words = "red green blue one two three four".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(30)] + [(30, None), (31, ""), (31, "red two"), (None, "blue blue")]
    good = {1, 4, 7, 31}
    target = spark.createDataFrame([(i,) for i in [*good, 4, None]], "good long")
    found = score_by_cross_entropy(table(spark, rows), target, vocabulary=5).collect()
    counts = Counter(w for _, t in rows for w in (t or "").split())
    vocabulary = [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:5]]
    number = {w: k + 2 for k, w in enumerate(vocabulary)}
    width = len(vocabulary) + 2
    tokens = lambda t: [number.get(w, 0) for w in (t or "").split()] + [1]

    def losses(texts):
        pairs = Counter(p for t in texts for p in zip([1, *tokens(t)], tokens(t)))
        unigrams, history = Counter(), Counter()
        for (a, b), n in pairs.items():
            unigrams[b] += n
            history[a] += n
        total = sum(unigrams.values())
        one = lambda b: (unigrams[b] + ALPHA) / (total + ALPHA * width)
        return lambda a, b: -math.log((pairs[a, b] + KAPPA * one(b)) / (history[a] + KAPPA))

    inside, outside = losses([t for i, t in rows if i in good]), losses([t for _, t in rows])
    by_text = {}
    for _, t in rows:
        path = list(zip([1, *tokens(t)], tokens(t)))
        by_text[t or ""] = (len(path), sum(inside(a, b) for a, b in path) / len(path), sum(outside(a, b) for a, b in path) / len(path))
    assert len(found) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(by_text[t or ""])
    for r in found:
        assert any(r["n_tokens"] == n and r["target_loss"] == pytest.approx(a, rel=1e-4) and r["background_loss"] == pytest.approx(b, rel=1e-4) for n, a, b in texts[r["doc_id"]])
        assert r["score"] == pytest.approx(r["target_loss"] - r["background_loss"], abs=1e-5)


def test_every_word_is_in_the_models(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(6000)}" for _ in range(150))) for k in range(80)] + [(80, "日本日本語"), (81, "")]
    target = spark.createDataFrame([(k,) for k in range(0, 82, 2)], "good long")
    found = {r["doc_id"]: r for r in score_by_cross_entropy(table(spark, rows), target).collect()}
    tokens = {k: [*(list(t) if k == 80 else t.split()), " "] for k, t in rows}
    width = len({w for t in tokens.values() for w in t}) + 1
    assert width > 2050

    def loss(k, inside):
        pairs = Counter(p for i in inside for p in zip([" ", *tokens[i]], tokens[i]))
        words = Counter(w for i in inside for w in tokens[i])
        one = lambda b: (words[b] + ALPHA) / (sum(words.values()) + ALPHA * width)
        return -sum(math.log((pairs[a, b] + KAPPA * one(b)) / (words[a] + KAPPA)) for a, b in zip([" ", *tokens[k]], tokens[k])) / len(tokens[k])

    for k in (0, 1, 40, 79, 80, 81):
        assert found[k]["n_tokens"] == len(tokens[k])
        assert found[k]["target_loss"] == pytest.approx(loss(k, range(0, 82, 2)), rel=1e-9)
        assert found[k]["background_loss"] == pytest.approx(loss(k, range(82)), rel=1e-9)


def test_language_models_of_nothing(spark):
    nobody = spark.createDataFrame([], "good long")
    assert score_by_cross_entropy(table(spark, []), nobody).count() == 0
    assert score_by_cross_entropy(table(spark, EDGES), nobody).count() == len(EDGES)


# --- personal data ----------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and passes_luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


PRIVATE = [
    "mail a.b+c@x-y.example.com, and x@y", "a@b.com_c@d.ef", "a@b.com.x@y.z @@ q@r.s", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 010.000.1.255", "4111 1111 1111 1111 or 4111-1111-1111-1112", "7536784127813050 4845168114407329 x",
    "+1 (729) 555-7725 190.137.223.204", "+12 34", "call +44 20 7946 0958.", "日本 4111111111111111 é user@例え.jp user@host.jp", "", None, "5500005555555559", "id 1234567890123456789012345", "v1.2.3.4-5 +1-800-555-0199-",
]


def test_base_spans_are_the_brute_force(spark):
    rows = list(enumerate(PRIVATE))
    for r in pii_report(table(spark, rows)).collect():
        want = brute_spans(PRIVATE[r["doc_id"]] or "")
        listed = [f"{k}:{a}:{b}" for a, _, b, k in want]
        import hashlib

        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), PRIVATE[r["doc_id"]]
        assert set(listed) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[3] == k for s in want) for k in KINDS]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("0123456789.+-() @ab_", max_size=60), min_size=20, max_size=40))
def test_base_spans_of_random_texts(spark, texts):
    found = {r["doc_id"]: [tuple(s)[:4] for s in r["base"]] for r in find_pii(table(spark, list(enumerate(texts)))).collect()}
    assert found == {k: brute_spans(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("piece", ["1", "1 ", "a", "a.", "1.", "+1", "a@", "1-", "a@b.", "12:", "(at) "])
def test_very_long_runs(spark, piece):
    text = piece * (60_000 // len(piece))
    found = pii_report(table(spark, [(1, text)])).collect()
    assert len(found) == 1


def test_added_spans(spark):
    found = {r["doc_id"]: r["spans"] for r in pii_report(table(spark, [(1, "my card 4111111111111111 9999999999999999"), (2, "reach jo (at) host (dot) com now"), (3, "order 9807915762804491 was sent"), (4, "the year 1999 and 12 of 40")])).collect()}
    assert "card:8:24" in found[1] and found[2].startswith("email:6:") and found[3] == "" and found[4] == ""


def test_wide_spans_meet_no_base_span_nor_each_other(spark):
    """The running passes against every pair."""
    rng = random.Random(2)
    some = lambda n: [(a, rng.randrange(4), a + rng.randint(1, 9), "phone", 0, "") for a in sorted(rng.sample(range(200), n))]
    rows = [(k, some(rng.randint(0, 20)), some(rng.randint(0, 30))) for k in range(40)] + [(40, [(a, 0, a + 1, "ip", 0, "") for a in range(0, 2000, 3)], [(a, 0, a + 2, "ip", 0, "") for a in range(2000)])]
    frame = spark.createDataFrame(rows, f"k int, known {NO_SPANS}, wide {NO_SPANS}")
    for r in frame.select("k", "known", "wide", without_overlap(F.col("wide"), F.col("known")).alias("clear"), earliest(F.col("wide")).alias("first")).collect():
        meets = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
        assert r["clear"] == sorted(w for w in r["wide"] if not any(meets(w, b) for b in r["known"]))
        first = []
        for w in r["wide"]:
            if not first or w["start"] >= first[-1]["end"]:
                first.append(w)
        assert r["first"] == first


def test_local_numbers_and_capitals(spark):
    texts = {1: "call 030 12345678 now", 2: "tel: 06 12 34 56 78", 3: "mobile 912 345 678", 4: "REACH JO (AT) HOST (DOT) COM", 5: "on 01.02.2024 and 05/06/2020", 6: "version 0.12 of 10.04"}
    found = {r["doc_id"]: r["spans"] for r in pii_report(table(spark, list(texts.items()))).collect()}
    assert found[1] == "phone:5:17" and found[2] == "phone:5:19" and found[3] == "phone:7:18"
    assert found[4].startswith("email:6:") and found[5] == found[6] == ""


def test_time_grows_with_the_number_of_spans(spark):
    import time

    took = []
    for n in (6_000, 12_000, 24_000):
        docs = table(spark, [(1, "a@b.co 555 123 4567 x " * n)])
        began = time.perf_counter()
        found = find_pii(docs)
        assert found.select(F.size("spans").alias("n"), F.length(redacted(found["text"], found["spans"])).alias("l")).first() == (2 * n, 18 * n)
        took.append(time.perf_counter() - began)
    assert took[2] < 2.6 * took[1]


def test_redaction_over_chunks(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["é", "x ", "a@b.co ", "日本", "+1 555 123 4567 "]) for _ in range(3000))
    found = find_pii(table(spark, [(1, text)]))
    row = found.select("spans", redacted(found["text"], found["spans"]).alias("t")).first()
    want, at = [], 0
    for s in row["spans"]:
        assert text[s["start"] : s["end"]] == s["text"]
        if s["start"] >= at:
            want += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    assert row["t"] == "".join(want) + text[at:]


def test_redaction(spark):
    rows = find_pii(table(spark, [(1, "x a@b.com y 1.2.3.4 z"), (2, None), (3, "none")]))
    found = {r["doc_id"]: r["t"] for r in rows.select("doc_id", redacted(rows["text"], rows["spans"]).alias("t")).collect()}
    assert found == {1: "x [EMAIL] y [IP] z", 2: "", 3: "none"}


# --- secrets ---------------------------------------------------------------------------


def test_secrets(spark):
    rng = random.Random(4)
    secret = "".join(rng.choices("0123456789abcdef", k=40))
    texts = {
        1: f'say token = "{secret}" here', 2: f"commit {secret} was fine", 3: "an ordinary text about 2 dogs and version 1.2.3", 4: "/usr/share/module42/config/settings", 5: f'TOKEN = "{secret.upper()}"', 6: None, 7: "",
        8: "key AKIA" + "ABCDEFGH12345678", 9: "x" * 100_000, 10: "1a" * 50_000,
    }
    found = {r["doc_id"]: r for r in secret_report(table(spark, list(texts.items()))).collect()}
    assert [i for i, r in sorted(found.items()) if r["n_secrets"] and i < 9] == [1, 5, 8]
    assert found[1]["secrets"] == f"{len('say token = ') + 1}:{len('say token = ') + 41}"
    assert len(found) == len(texts) and secret_report(table(spark, [])).count() == 0


def test_long_tokens_are_candidates_wherever_their_digits_are(spark):
    rng = random.Random(8)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=260))
    lines = {1: f"token = '{letters}7'", 2: f"secret={letters[:40]}", 3: "Donaudampfschifffahrtsgesellschaft", 4: "-" * 70, 5: "x" * 300 + "é" + "token=" + letters[:32]}
    found = {r["doc_id"]: r for r in secret_report(table(spark, list(lines.items()))).collect()}
    assert {i: r["n_candidates"] for i, r in found.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    assert [i for i, r in sorted(found.items()) if r["n_secrets"]] == [1, 2, 5]
    assert found[1]["secrets"] == "9:270" and found[5]["secrets"] == "307:339"


def test_secrets_without_quotes(spark):
    rng = random.Random(6)
    secret = "".join(rng.choices("0123456789abcdef", k=39)) + "7"
    lines = {
        1: f"API_KEY={secret}", 2: f"see https://host.org/list?token={secret}&page=2", 3: f"export APP_PASSWORD={secret}\nDEBUG=1", 4: f"client_secret={secret[:32]}",
        5: f"sha1={secret}", 6: "https://www.host.org/usr/share/module42/config/settings", 7: "reader.first_second_third_name_1234", 8: f"image@commit={secret}",
    }
    found = {r["doc_id"]: r for r in secret_report(table(spark, list(lines.items()))).collect()}
    assert {i: r["n_candidates"] for i, r in found.items()} == dict.fromkeys(lines, 1)
    assert [i for i, r in sorted(found.items()) if r["n_secrets"]] == [1, 2, 3, 4]
    for i in (1, 2, 3):
        at = lines[i].index(secret)
        assert found[i]["secrets"] == f"{at}:{at + len(secret)}"
