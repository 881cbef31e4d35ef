"""Secret scans: wide candidate patterns, a random forest against false alarms.

Candidates are known key formats and any unbroken token of 16 characters or
more, wherever it starts: after a quote, a blank, '=', '.' or '@'.  The
forest sees their length, character transitions, dictionary coverage, whether
they are part of a path, and the words beside them.  It learns from labelled
findings; the tables have none, so ``labelled_findings`` writes them from
templates.  Documents only meet DataFrame expressions: the trees become CASE
expressions, and the training findings get their features from the same ones.
"""

from __future__ import annotations

import json
import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.llm.common import chunked, let, piece, whole_text
from evergrove.llm.forest import fit_forest, forest_column, forest_share
from evergrove.llm.pii import NO_SPANS, _located

#: Public formats of access keys.
KNOWN = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_TOKEN = "A-Za-z0-9+/_-"
CANDIDATE = rf"{KNOWN}|(?<![{_TOKEN}])[{_TOKEN}]{{16,}}+={{0,2}}"
#: Words that name a secret, or something that looks like one.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|signing"
PUBLIC_WORDS = "sha[0-9]*|hash|commit|md5|checksum|uuid|guid|digest|revision|etag|isbn|build|nonce|example|sample|dummy|placeholder|trace"
DICTIONARY = (
    "the and for you that with this from have not are was but all can her one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "about after again could every first found great house large learn never other place plant point right small sound spell still study their there these thing think three water where which world would write "
    "access account action address admin alert article asset backup batch button cache client color common component config content context control count create custom data date default delete demo design device document domain download email error event example export false feature field file filter folder form format frame function global group handler header health height hidden image import index input install item label language layout length level library license limit link list load local login manager map menu message method model module name network node note null number object offset option order output package page panel parent password path pattern payment point port post private process product profile project public query queue read record release remote report request reset resource response result role root route rule sample schema script search section select sender server service session setting shared size source stage start state static status store stream string style submit system table target task template test text theme thread time title token total trace track transfer true type update upload user utils value version video view warning web widget width window worker"
).split()
NAMES = ("length", "digits", "capitals", "transitions", "distinct", "hexadecimal", "dictionary", "known format", "in a path", "quoted", "assigned", "secret word", "public word", "dashes", "repeats")


def candidates(text: Column) -> Column:
    possible = text.rlike(rf"[{_TOKEN}]{{16}}")
    return F.when(possible, _located(text, CANDIDATE, "email", 0)).otherwise(F.array().cast(NO_SPANS))


def features(chunks: Column, span: Column) -> list[Column]:
    """Features of a candidate in a `chunked` text, as doubles in the order of NAMES."""
    token = span["text"]
    size = F.greatest(F.char_length(token), F.lit(1))
    rest = lambda pattern: F.char_length(F.regexp_replace(token, pattern, ""))
    before = F.lower(piece(chunks, F.greatest(span["start"] - 40, F.lit(0)), span["start"]))
    after = F.lower(piece(chunks, span["end"], span["end"] + 24))
    moved = F.regexp_replace(token, "([a-z])(?=[^a-z])|([A-Z])(?=[^A-Z])|([0-9])(?=[^0-9])", "$0 ")
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    return [
        c.cast("double")
        for c in (
            size,
            (size - rest("[0-9]")) / size,
            (size - rest("[A-Z]")) / size,
            (F.char_length(moved) - size) / size,
            F.size(F.array_distinct(F.split(token, ""))) / F.least(size, F.lit(40)),
            token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
            (size - F.char_length(F.regexp_replace(F.lower(token), words, ""))) / size,
            token.rlike(rf"^(?:{KNOWN})"),
            token.contains("/") | before.rlike("[/\\\\.][a-z0-9_-]*$|https?:\\S*$") | after.rlike("^[/.][a-z]"),
            before.rlike("[\"'`]$") & after.rlike("^[\"'`]"),
            before.rlike("[=:]\\s{0,2}[\"'`]?$"),
            before.rlike(SECRET_WORDS),
            before.rlike(rf"(?:{PUBLIC_WORDS})\b[^a-z]*$") | F.lower(token).rlike("example|sample|dummy|placeholder|xxxx"),
            token.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"),
            token.rlike("(.)\\1{4}"),
        )
    ]


def labelled_findings(rows: int = 2400, seed: int = 5) -> list[tuple[str, int]]:
    """(line, 1 for a secret): findings as reviewers would label them."""
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    names = ["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "TOKEN", "bearer"]
    public = ["sha1", "commit", "checksum", "md5", "uuid", "digest", "etag", "hash", "revision"]
    prose = "that the of under report when over after and more than value line".split()
    say = lambda n: " ".join(rng.choice(prose) for _ in range(n))
    lines = []
    for _ in range(rows):
        kind, secret = rng.randrange(15), rng.random() < 0.5
        text = pick(hexa, rng.choice([32, 40, 40, 64])) if rng.random() < 0.6 else pick(alnum, rng.randint(20, 48))
        text = text.upper() if rng.random() < 0.1 else text
        quote = rng.choice(['"', "'", '"', ""])
        if secret and kind < 6:
            line = f"{rng.choice(names)}{rng.choice([' = ', '=', ': '])}{quote}{text}1{quote}"
        elif secret and kind > 11:  # letters without a digit
            line = f"{rng.choice(names)}{rng.choice([' = ', '=', ': '])}{quote}{pick(string.ascii_letters, rng.randint(20, 48))}{quote}"
        elif secret and kind > 8:
            name = rng.choice(names)
            line = rng.choice([f"{name}={text}1", f"{name.upper()}={text}1", f"export APP_{name.upper()}={text}1", f"https://{rng.choice(DICTIONARY)}.org/list?page=2&{name}={text}1"])
        elif secret:
            line = rng.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(alnum, 36), "sk-" + pick(alnum, 40), "AIza" + pick(alnum, 35)])
        elif kind < 3:
            line = f"{rng.choice(public)}{rng.choice([' ', ': ', '='])}{text}1"
        elif kind == 3:
            line = "/".join(["", rng.choice(DICTIONARY), rng.choice(DICTIONARY), rng.choice(DICTIONARY) + str(rng.randint(1, 99)), rng.choice(DICTIONARY)])
        elif kind == 4:
            line = f"{rng.choice(['id', 'uuid', 'request'])} {pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-a{pick(hexa, 3)}-{pick(hexa, 12)}"
        elif kind == 5:
            line = "-".join(rng.choice(DICTIONARY) for _ in range(4)) + f"-{rng.randint(1, 2030)}"
        elif kind == 6:
            line = f"{rng.choice(names)} = {quote}{rng.choice(['example', 'xxxxxxxx', 'placeholder', 'dummy'])}{rng.choice(['-', '_'])}{rng.choice(['token', 'secret', 'key'])}-{'0' * 8}{quote}"
        elif kind == 7:
            line = pick("0123456789", rng.randint(16, 24))
        elif kind == 8:
            line = "_".join(rng.choice(DICTIONARY) for _ in range(3)) + str(rng.randint(10, 99999))
        elif kind == 9:
            line = f"https://www.{rng.choice(DICTIONARY)}.com/" + "/".join(rng.choice(DICTIONARY) for _ in range(3)) + rng.choice([f"/{rng.randint(1, 99999)}", f"-{rng.randint(1, 2030)}", f"?id={text}1"])
        elif kind == 10:
            line = f"{rng.choice(DICTIONARY)}{rng.choice(['.', '@', '='])}" + rng.choice(["_", "-", "/"]).join(rng.choice(DICTIONARY) for _ in range(4)) + str(rng.randint(1, 99999))
        elif kind == 12:  # long words, names of things, rules of marks
            line = rng.choice(["".join(rng.choice(DICTIONARY) for _ in range(4)), "".join(rng.choice(DICTIONARY).title() for _ in range(4)), pick(string.ascii_lowercase[:9], rng.randint(16, 40)), rng.choice("-_/+") * rng.randint(16, 80)])
        elif kind == 13:
            line = rng.choice(["-", "_", "/"]).join(rng.choice(DICTIONARY) for _ in range(5))
        elif kind == 14:
            line = f"{rng.choice(public)}{rng.choice([' ', ': ', '='])}{pick(string.ascii_letters, rng.randint(20, 40))}"
        else:
            line = f"{rng.choice(['id', 'ref', 'v', 'key_id', 'request', 'page', *public])}{rng.choice(['=', '=', '@', '.'])}{text}1"
        lines.append((f"{say(3)} {line} {say(3)}.", int(secret)))
    return lines


@lru_cache(maxsize=2)
def _fitted(spark: SparkSession, precision: float):
    """The forest and the share from which held-out findings reach ``precision``."""
    lines = json.dumps([{"line": line, "label": label} for line, label in labelled_findings()])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(lines), "array<struct<line:string,label:int>>")).alias("r")).select("r.line", "r.label")
    spans = rows.select("line", "label", candidates(F.col("line")).alias("spans"))
    found = [(row["label"], x) for row in spans.select("label", F.transform("spans", lambda s: F.array(*features(chunked(F.col("line")), s))).alias("x")).collect() for x in row["x"]]
    x, y = np.array([f for _, f in found]), np.array([label for label, _ in found], dtype=float)
    fit = np.arange(len(y)) % 3 != 0
    forest = fit_forest(x[fit], y[fit])
    share = forest_share(forest, x[~fit])
    order = np.argsort(-share, kind="stable")
    good = np.flatnonzero(np.cumsum(y[~fit][order]) / np.arange(1, len(order) + 1) >= precision)
    return forest, max(0.5, float(share[order][good[-1]])) if len(good) else 1.1


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", precision: float = 0.98) -> DataFrame:
    """All candidates of every whole text: doc_id and ``found``, an array of
    (start, end, share, secret), offsets in code points.

    Null text counts as empty and has no candidates.  Repeated rows give repeated
    rows.  Other columns are ignored.  An empty table gives an empty result.
    """
    forest, limit = _fitted(docs.sparkSession, precision)
    text = F.col("text")

    def judged(chunks: Column, span: Column) -> Column:
        share = lambda x: forest_column(forest, [F.get(x, F.lit(k)) for k in range(len(NAMES))])
        return let(
            let(F.array(*features(chunks, span)), share),
            lambda s: F.struct(span["start"].alias("start"), span["end"].alias("end"), s.alias("share"), (s >= limit).alias("secret")),
        )

    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,share:double,secret:boolean>>")
    in_text = lambda spans: let(chunked(text), lambda chunks: F.transform(spans, lambda s: judged(chunks, s)))
    return rows.select("doc_id", let(candidates(text), lambda spans: F.when(F.size(spans) == 0, none).otherwise(in_text(spans))).alias("found"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: candidates, secrets, and the secrets' start:end."""
    found = scan_secrets(docs)
    secrets = F.filter("found", lambda s: s["secret"])
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("secrets"),
    )
