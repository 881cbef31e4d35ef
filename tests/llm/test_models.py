"""Trained models against plain restatements: discriminants, boosted trees with
calibration, forests; and what they find in documents."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evergrove.llm import pii, secret_scan, toxicity
from evergrove.llm.boosting import fit_boosted, fit_isotonic
from evergrove.llm.common import chunked
from evergrove.llm.forest import fit_forest, forest_column, forest_share
from evergrove.llm.quality import score_quality, statistics

SF = "/root/testdata/sf0.01"


def walk(tree, x):
    """One row down one tree."""
    node = 0
    while tree.feature[node] >= 0:
        node = 2 * node + (2 if x[tree.feature[node]] > tree.threshold[node] else 1)
    return tree.value[node]


def margin(model, x):
    return model.base + sum(model.rate * walk(tree, x) for tree in model.trees)


def pooled(pairs):
    """Isotonic calibration by merging neighbours until none falls."""
    pools = [[1.0, float(y), float(m)] for m, y in sorted(pairs, key=lambda p: p[0])]
    k = 0
    while k < len(pools) - 1:
        if pools[k][1] / pools[k][0] >= pools[k + 1][1] / pools[k + 1][0]:
            pools[k : k + 2] = [[a + b for a, b in zip(pools[k], pools[k + 1])]]
            k = max(k - 1, 0)
        else:
            k += 1
    knots = [p[2] / p[0] for p in pools]
    values = list(np.maximum.accumulate([(p[1] + 0.5) / (p[0] + 1) for p in pools]))

    def at(m):
        if m <= knots[0]:
            return values[0]
        for a, b, u, v in zip(knots, knots[1:], values, values[1:]):
            if m <= b:
                return u + (v - u) * (m - a) / (b - a)
        return values[-1]

    return at


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- quality -------------------------------------------------------------------------


def test_quality_scores_are_the_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    taught = [i for i in texts if i in marks and fold(i) != 1]
    raw = np.array([statistics(texts[i]) for i in taught])
    ordered = np.sort(raw, axis=0)
    place = lambda p: ordered[max(math.ceil(p * len(ordered)) - 1, 0)]
    low, high = place(0.002), place(0.998)
    x, y = np.clip(raw, low, high), np.array([marks[i] for i in taught])
    own = [x[y == c] for c in (0, 1)]
    centred = [part - part.mean(axis=0) for part in own]
    within = sum(c.T @ c for c in centred) / len(x)
    density = []
    for part, c in zip(own, centred):
        covariance = 0.95 * (0.75 * (c.T @ c) / len(part) + 0.25 * within) + 0.05 * np.eye(x.shape[1]) * np.trace(within) / x.shape[1]
        inverse, (_, logdet) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
        density.append(lambda v, m=part.mean(axis=0), s=inverse, d=logdet, n=len(part): math.log(n + 0.5) - d / 2 - (v - m) @ s @ (v - m) / 2)
    scores = {r["doc_id"]: r["score"] for r in score_quality(docs, labels).collect()}
    assert len(scores) == len(texts)
    for i, text in texts.items():
        v = np.clip(np.array(statistics(text)), low, high)
        gap = float(np.clip(density[1](v) - density[0](v), -40, 40))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-gap)), abs=1e-6)


# --- toxicity ------------------------------------------------------------------------


def test_toxicity_scores_are_the_brute_force(spark):
    """Terms, features, trees walked row by row, and calibration, restated."""
    rng = random.Random(4)
    plain = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    bad = ["zzgrol", "zzgrolen", "vrekk"]
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=rng.randint(5, 40)) + (rng.choices(bad, k=rng.randint(1, 3)) + ["you"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic), 0))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table(spark, rows), labels).collect()}
    texts = dict(rows)
    taught = [(i, y) for i, y, _ in marks if zlib.crc32(str(i).encode()) % 5 != 0]
    parts = {r["id"]: r["p"] for r in spark.range(400).select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)).alias("p")).collect()}
    lessons = [(i, y) for i, y in taught if parts[i] < 4]
    counts = {}
    for i, y in lessons:
        for term in {w for word in set(re.findall(r"[^\W\d_]+", texts[i].lower())) for w in (word, *(f"{word[:k]}*" for k in range(3, 7) if len(word) > k))}:
            counts.setdefault(term, [0, 0])[1 - y] += 1
    n = [sum(y for _, y in lessons), sum(1 - y for _, y in lessons)]
    odds = {t: math.log((a + 0.5) / (n[0] + 1)) - math.log((b + 0.5) / (n[1] + 1)) for t, (a, b) in counts.items() if a >= 4}
    best = sorted((t for t in odds if odds[t] >= math.log(6.0)), key=lambda t: (-odds[t] * math.sqrt(counts[t][0]), t))[:2000]
    lexicon = toxicity.Lexicon({t: odds[t] for t in best})
    assert {"zzgrol", "vrekk"} <= set(best)
    x = {i: toxicity.toxic_features(t, lexicon) for i, t in rows}
    fit = sorted(i for i, _ in taught if 4 <= parts[i] < 8)
    calibrate = sorted(i for i, _ in taught if parts[i] >= 8)
    truth = dict(taught)
    model = fit_boosted(np.array([x[i] for i in fit]), np.array([truth[i] for i in fit], dtype=float), rounds=60)
    probability = pooled([(margin(model, x[i]), truth[i]) for i in calibrate])
    for i in texts:
        assert found[i] == pytest.approx(probability(margin(model, x[i])), abs=1e-6)


def test_repeated_ids_teach_once(spark):
    rows = [(k, f"word{k} some text") for k in range(50)] + [(7, "seven again")] * 40
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(50)] + [(7, 0, 0)] * 30, "doc_id long, toxic int, quality int")
    assert toxicity.score_toxicity(table(spark, rows), labels, max_rows=20).count() == 90


def test_calibration_is_the_brute_force():
    rng = np.random.default_rng(3)
    m = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    ours, plain = fit_isotonic(m, y), pooled(list(zip(m, y)))
    for v in np.linspace(-4, 4, 101):
        assert float(ours(np.array([v]))[0]) == pytest.approx(plain(v), abs=1e-9)


# --- secrets and personal data: expressions against plain walks ------------------------------


def test_boosted_columns_are_the_walks(spark):
    model, _ = pii._fitted(spark, 0.97, 30)
    lines = [line for line, _ in pii.training_lines(300, seed=99)]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    spans = rows.select(F.explode(F.transform(pii.wide_spans(F.col("line")), lambda s: F.array(*pii.features(chunked(F.col("line")), s)))).alias("x"))
    found = spans.select("x", model.column([F.get("x", F.lit(k)) for k in range(len(pii.FEATURES))]).alias("m")).collect()
    assert len(found) > 200
    for r in found:
        assert r["m"] == pytest.approx(margin(model, r["x"]), abs=1e-9)


def test_forest_columns_are_the_walks(spark):
    forest, _ = secret_scan._fitted(spark, 0.98)
    lines = [line for line, _ in secret_scan.labelled_findings(300, seed=77)]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    spans = rows.select(F.explode(F.transform(secret_scan.candidates(F.col("line")), lambda s: F.array(*secret_scan.features(chunked(F.col("line")), s)))).alias("x"))
    found = spans.select("x", forest_column(forest, [F.get("x", F.lit(k)) for k in range(len(secret_scan.NAMES))]).alias("s")).collect()
    assert len(found) > 200
    for r in found:
        assert r["s"] == pytest.approx(sum(walk(tree, r["x"]) for tree in forest) / len(forest), abs=1e-9)


def test_forest_shares_are_the_walks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    forest = fit_forest(x, (x[:, 1] > 0).astype(float), trees=5)
    assert np.allclose(forest_share(forest, x), [np.mean([walk(t, row) for t in forest]) for row in x])


def test_secrets_of_the_documents(spark):
    """The documents plant ``name = "40 hexadecimal digits"`` lines; nothing else in them is a secret."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = duckdb.sql("""select doc_id, text from '/root/testdata/sf0.1/documents.parquet'
        where regexp_matches(lower(text), '(token|secret|password|api_key|key)\\s*[=:]\\s*"[0-9a-zA-Z+/_-]{20,}"')""").fetchall()
    found = {r["doc_id"]: r["n_secrets"] for r in secret_scan.secret_report(docs).where("n_secrets > 0").collect()}
    caught = sum(i in found for i, _ in planted)
    assert planted and caught / len(planted) > 0.95 and len(set(found) - {i for i, _ in planted}) <= 0.05 * len(planted)
