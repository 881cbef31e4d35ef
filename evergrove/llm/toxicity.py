"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features: densities of two lexicons, how near second-person words are to their
hits, capitals, punctuation, and rates of obfuscated words (digits or signs for
letters, letters set apart).  One lexicon is a fixed list of abuse; the other has
the words and word beginnings that labelled toxic texts use far more often than
others, whatever their language.  A bounded sample of labelled rows teaches: a
part of it the lexicon, another the trees, and margins become probabilities by
pool-adjacent-violators on a third that neither saw.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evergrove.llm.boosting import fit_boosted, fit_isotonic
from evergrove.llm.common import checkpointed, crc_fold, whole_text

#: Words of abuse and contempt, by strength.
STRONG = frozenset(
    "idiot idiots moron morons scum loser losers stupid worthless disgusting pathetic trash clown clowns imbecile imbeciles retard retarded "
    "bastard bastards bitch bitches asshole assholes dumbass jackass shithead fucker fucking fuck shit bullshit cunt whore slut vermin "
    "scumbag douchebag dipshit idiota estupido imbécil basura idiotin arschloch dummkopf abschaum connard salope imbécile ordure".split()
)
MILD = frozenset("dumb ugly fool fools foolish garbage filthy filth jerk creep freak lame useless hate hated shut lazy liar liars crap sucks damn hell kill die".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton vous votre usted ustedes tú ti su".split())
#: Signs that stand for letters.
LOOKALIKE = str.maketrans("013457@$!+|", "oieastasitl")

NAMES = (
    "strong per word", "strong hits", "strong distinct", "mild per word", "hidden per word", "hidden hits", "near second person",
    "second person per word", "capitals", "capital words", "exclamations", "marks", "obfuscated per word", "words",
    "learned per word", "learned hits", "learned distinct", "learned weight per word",
)
D = len(NAMES)
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_][013457@$!+|*.\-_]+[^\W\d_]|[@$013457][^\W\d_]")
_APART = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
REACH = 6  # words
PREFIXES = range(3, 7)  # lengths of word beginnings
LONGEST = 64  # characters of a word that is remembered


class Lexicon:
    """Learned terms with their log odds; a word weighs what its best term does."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.memory: dict[str, float] = {}

    def weight(self, word: str) -> float:
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            terms = self.terms
            known = max(terms.get(word, 0.0), *(terms.get(f"{word[:k]}*", 0.0) if len(word) > k else 0.0 for k in PREFIXES))
            if len(word) <= LONGEST:  # in scripts without blanks a word can be a whole text
                self.memory[word] = known
        return known


def terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {f"{word[:k]}*" for word in words for k in PREFIXES if len(word) > k}


def toxic_features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of one whole text, in the order of NAMES."""
    words = _WORD.findall(text.lower())
    n = len(words)
    strong = [k for k, w in enumerate(words) if w in STRONG]
    weights = list(map(lexicon.weight, words)) if lexicon.terms else []
    learned = [k for k, weight in enumerate(weights) if weight]
    hits = sorted({*strong, *learned})
    mild = sum(map(MILD.__contains__, words))
    second = [k for k, w in enumerate(words) if w in SECOND] if hits else []
    at, near = 0, 0
    for k in hits:
        while at < len(second) and second[at] < k - REACH:
            at += 1
        near += at < len(second) and second[at] <= k + REACH
    hidden = mixed = 0
    if _MIXED.search(text):
        for word in text.lower().split():
            if _MIXED.search(word):
                mixed += 1
                plain = re.sub(r"[\W\d_]+", "", word.translate(LOOKALIKE))
                if plain in STRONG and not any(part in STRONG for part in _WORD.findall(word)):
                    hidden += 1
    for found in _APART.finditer(text.lower()):
        hidden += re.sub(r"[\W\d_]+", "", found.group()) in STRONG
    upper = sum(map(str.isupper, text))
    letters = max(1, sum(map(len, words)))
    tokens = text.split()
    m = max(1, len(tokens))
    return [
        len(strong) / max(1, n), float(np.log1p(len(strong))), float(len({words[k] for k in strong})), mild / max(1, n), hidden / max(1, n), float(hidden),
        near / max(1, len(hits)), len(second) / max(1, n), upper / letters, sum(1 for t in tokens if len(t) > 1 and t.isupper()) / m,
        text.count("!") / m, sum(text.count(c) for c in "#$%&*@?") / m, mixed / m, float(np.log1p(n)),
        len(learned) / max(1, n), float(np.log1p(len(learned))), float(len({words[k] for k in learned})), sum(weights) / max(1, n),
    ]


def _measure(terms: dict[str, float]):
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = [toxic_features(text, lexicon) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], schema=schema)

    return run


def _count_terms(batches):
    """(term, toxic texts, other texts) of a task's rows, flushed when large."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
    counts: dict[str, list[int]] = {}

    def flushed():
        toxic, other = zip(*counts.values())
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())], schema=schema)

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for term in terms_of(text):
                counts.setdefault(term, [0, 0])[0 if label else 1] += 1
            if len(counts) > 300_000:
                yield flushed()
                counts.clear()
    if counts:
        yield flushed()


def learn_lexicon(rows: DataFrame, size: int = 2000, least: int = 4, ratio: float = 6.0) -> dict[str, float]:
    """The ``size`` terms that best tell toxic texts of ``rows`` (text, label):
    in at least ``least`` toxic texts and ``ratio`` times as often as in others."""
    totals = rows.groupBy("label").count().collect()
    toxic = sum(r["count"] for r in totals if r["label"] == 1)
    other = sum(r["count"] for r in totals if r["label"] == 0)
    counts = rows.select("text", "label").mapInArrow(_count_terms, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    best = counts.where(F.col("toxic") >= least).select("term", odds.alias("odds"), (odds * F.sqrt("toxic")).alias("rank")).where(F.col("odds") >= float(np.log(ratio)))
    return {r["term"]: float(r["odds"]) for r in best.orderBy(F.desc("rank"), "term").limit(size).collect()}


def _scorer(model, isotonic):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(isotonic(model.margin(x)))], schema=schema)

    return run


def _features(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    return rows.select("doc_id", "text").mapInArrow(_measure(terms), "doc_id long, x array<double>")


def fit_toxicity(x: np.ndarray, y: np.ndarray, calibration: np.ndarray, rounds: int = 60):
    model = fit_boosted(x[~calibration], y[~calibration], rounds=rounds)
    return model, fit_isotonic(model.margin(x[calibration]), y[calibration])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_out: int = 0, max_rows: int = 40_000) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1) and predicted.

    Only labelled rows outside the held-out fold teach the model: at most about
    ``max_rows`` ids of them, taken by hash; an id with several labels has the
    larger.  Null text counts as empty; an
    empty text has features and so a score.  Labels other than 0 and 1 are
    ignored; without labels every score is 1/2 or below.  Repeated rows give
    repeated rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("label"))
    # one label an id, the larger of several, so that rows of the sample are as many as its ids
    known = known.where(crc_fold("labelled", folds) != held_out).groupBy("labelled").agg(F.max("label").alias("label"))
    count = known.count()
    if count > max_rows:
        known = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    # the sample is at most about max_rows pairs of numbers, so it may be broadcast: no text is shuffled
    taught = rows.join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)))
    terms = learn_lexicon(taught.where("part < 4"))
    features = checkpointed(_features(rows, terms))
    sample = features.join(F.broadcast(known), F.col("doc_id") == F.col("labelled")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)))
    # of documents that share an id one teaches
    found = sample.where("part >= 4").groupBy("doc_id", "label", "part").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), D)
    model = fit_toxicity(x, found["label"].to_numpy(dtype=float), found["part"].to_numpy() >= 8)
    scored = features.mapInArrow(_scorer(*model), "doc_id long, score double")
    return scored.select("doc_id", (crc_fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
