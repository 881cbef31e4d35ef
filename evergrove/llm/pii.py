"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Everything that touches documents is a DataFrame expression.  Two sets of
patterns propose spans.  The base set is a fixed definition and its spans always
stay.  The wider set is high recall: numbers inside longer digit runs, phone
numbers without a country prefix, spelled-out mail addresses, IPv6.  Its spans
get format and context features, a gradient-boosted score (trees written out as
CASE expressions), and a threshold per kind that was calibrated for precision
on held-out spans.  There is no table of labelled spans, so the trees learn from
labelled findings that ``training_lines`` writes from templates.

Loops in the patterns are possessive: Java runs those without recursion and
without backtracking, so very long runs of digits or letters neither overflow
the stack nor take quadratic time; they match exactly what the greedy forms do.
Spans are placed, compared and replaced in running passes over sorted arrays, and
their context is cut from short pieces of the text, so a text with very many
spans takes time in proportion.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrove.llm.boosting import fit_boosted, fit_isotonic
from evergrove.llm.common import chunked, let, piece, scanned, whole_text

KINDS = ("email", "ip", "card", "phone")

#: The base definitions.  A local part starts where its run of
#: characters does (or where the match before ended), which is where the
#: leftmost match starts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
IP_VALID = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: The wider patterns, by (kind, form).
WIDE = {
    ("card", 0): r"(?<![0-9])[0-9]{13,19}(?![0-9])",
    ("card", 1): r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    ("phone", 2): r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    ("email", 3): r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?(?i:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?i:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,}+)++",
    ("phone", 5): r"(?<![0-9A-Za-z+./-])(?:0[0-9]{1,4}(?:[ /.-][0-9]{2,8}+){1,4}|[0-9]{3} [0-9]{3} [0-9]{3})(?![0-9A-Za-z])",
    ("ip", 4): r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
#: Words near a span that speak for it or against it.
FOR_WORDS = "phone|tel|call|mobile|fax|sms|card|visa|mastercard|amex|credit|debit|payment|mail|contact|write|ip|host|server|address|login"
AGAINST_WORDS = "order|invoice|isbn|issn|serial|version|ticket|sku|part|ref|token|hash|sha|commit|build|timestamp|id"
SPAN = "struct<start:int,rank:int,end:int,kind:string,form:int,text:string>"
NO_SPANS = f"array<{SPAN}>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""

    def check(backwards: Column) -> Column:
        def added(total: Column, k: Column) -> Column:
            digit = F.ascii(F.substring(backwards, k + 1, F.lit(1))) - 48
            doubled = digit * 2
            return total + F.when(k % 2 == 0, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

        return F.aggregate(F.sequence(F.lit(0), F.length(backwards) - 1), F.lit(0), added) % 10 == 0

    return (F.length(digits) > 0) & let(F.reverse(digits), check)


def _located(text: Column, pattern: str, kind: str, form: int) -> Column:
    """All leftmost non-overlapping matches with their code-point offsets: what
    lies between matches, by ``split``, gives where each one starts."""

    def step(at: Column, item: Column):
        start = at + F.char_length(item["gap"])
        end = start + F.char_length(item["match"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(form).alias("form"), item["match"].alias("text")
        ).cast(SPAN)
        return end, span

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        return scanned(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), F.lit(0), step, SPAN)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: F.when(F.size(matches) == 0, F.array().cast(NO_SPANS)).otherwise(placed(matches)))


def _valid(span: Column) -> Column:
    digits = F.length(_digits(span["text"]))
    card = digits.between(14, 19) & luhn(F.when(digits <= 19, _digits(span["text"])).otherwise(F.lit("1")))
    return F.when(span["kind"] == "ip", span["text"].rlike(IP_VALID)).when(span["kind"] == "card", card).when(span["kind"] == "phone", digits.between(10, 15)).otherwise(F.lit(True))


def base_spans(text: Column) -> Column:
    """The base spans, by start and then kind."""
    none = F.array().cast(NO_SPANS)
    needs = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){13}"), "phone": text.contains("+")}
    found = [F.when(needs[kind], _located(text, BASE[kind], kind, -1)).otherwise(none) for kind in KINDS]
    return F.array_sort(F.filter(F.concat(*found), _valid))


def wide_spans(text: Column) -> Column:
    none = F.array().cast(NO_SPANS)
    needs = {0: text.rlike("[0-9]{13}"), 1: text.rlike("[0-9]{4}[ .-][0-9]{4}"), 2: text.rlike("[0-9]{3}[ .-][0-9]{4}"), 3: text.rlike("(?i)[(\\[{]at[)\\]}]"), 4: text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), 5: text.rlike("0[0-9]{1,4}[ /.-][0-9]{2}|[0-9]{3} [0-9]{3} [0-9]{3}")}
    found = [F.when(needs[form], _located(text, pattern, kind, form)).otherwise(none) for (kind, form), pattern in WIDE.items()]
    return F.array_sort(F.concat(*found))


FEATURES = ("form", "digits", "length", "separators", "luhn", "distinct", "first", "word_before", "word_after", "hex_around", "for", "against")


def features(chunks: Column, span: Column) -> list[Column]:
    """Format and context of a span of a `chunked` text, as doubles in the order of FEATURES."""
    digits = _digits(span["text"])
    count = F.length(digits)
    before = F.lower(piece(chunks, F.greatest(span["start"] - 24, F.lit(0)), span["start"]))
    after = F.lower(piece(chunks, span["end"], span["end"] + 24))
    around = F.concat_ws(" ", before, after)
    return [
        c.cast("double")
        for c in (
            span["form"],
            count,
            F.char_length(span["text"]),
            F.char_length(span["text"]) - F.char_length(F.regexp_replace(span["text"], "[ ().:-]", "")),
            luhn(F.when(count.between(1, 19), digits).otherwise(F.lit("1"))),
            F.size(F.array_distinct(F.split(digits, ""))),
            F.when(count > 0, F.ascii(digits) - 48).otherwise(F.lit(-1)),
            before.rlike("[a-z0-9_=/#]$"),
            after.rlike("^[a-z0-9_=/]"),
            before.rlike("[0-9a-f]{8,}[\"' ]{0,2}$") | after.rlike("^[\"' ]{0,2}[0-9a-f]{8,}"),
            around.rlike(rf"\b(?:{FOR_WORDS})"),
            around.rlike(rf"\b(?:{AGAINST_WORDS})\b"),
        )
    ]


def _luhn_digits(rng: random.Random, length: int, valid: bool) -> str:
    body = [rng.choice("3456")] + [rng.choice("0123456789") for _ in range(length - 2)]
    total = 0
    for k, digit in enumerate(reversed(body)):
        value = int(digit) * (2 if k % 2 == 0 else 1)
        total += value - 9 if value > 9 else value
    check = (10 - total % 10) % 10
    return "".join(body) + str(check if valid else (check + rng.randint(1, 9)) % 10)


def training_lines(rows: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(line, whether the wide span in it is personal data): labelled findings
    from templates.  Labels follow what a reviewer can know: a card number passes
    Luhn and is not called something else, a phone number is not part of an
    identifier, a spelled-out address names a domain."""
    rng = random.Random(seed)
    filler = "the of and report value about there line over under along system other great".split()
    words = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    good = ["", "", "phone", "tel:", "call", "my card", "visa", "contact", "payment card", "mobile"]
    bad = ["order", "invoice", "isbn", "serial", "ticket", "sku", "ref", "build", "hash", "timestamp"]
    lines = []
    for _ in range(rows):
        kind = rng.randrange(10)
        personal = rng.random() < 0.5
        near = rng.choice(good if personal else bad)
        number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        if kind in (0, 1):  # a bare number, beside another one at times
            span = _luhn_digits(rng, rng.choice([14, 15, 16, 16, 16]), personal or rng.random() < 0.1)
            if kind == 1:
                near = rng.choice(["", number(16), number(16)]) if personal else rng.choice(["", number(16), number(13)])
        elif kind == 2:
            digits = _luhn_digits(rng, 16, personal or rng.random() < 0.1)
            sep = rng.choice(" -.")
            span = sep.join(digits[k : k + 4] for k in range(0, 16, 4))
        elif kind in (3, 4):
            sep = rng.choice(" .-")
            span = f"{rng.randint(200, 989)}{sep}{number(3)}{sep}{number(4)}" if rng.random() < 0.5 else f"({rng.randint(200, 989)}) {number(3)}-{number(4)}"
        elif kind == 5:
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", ".")])
            gap = rng.choice(["", " "])
            span = f"{rng.choice('jkmst')}{rng.choice(filler)}{gap}{at}{gap}{rng.choice(filler)}{gap}{dot}{gap}{rng.choice(['com', 'org', 'net'])}"
            personal, near = True, rng.choice(good)
        elif kind == 6:
            span = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))
            near = rng.choice(["ip", "host", "server", ""]) if personal else rng.choice(["hash", "sha", "commit", "serial"])
        elif kind == 8:  # a local number, or a date
            sep = rng.choice(" /-.")
            if personal:
                span = rng.choice([f"0{rng.randint(10, 9999)}{sep}{number(rng.randint(6, 8))}", "0" + sep.join([str(rng.randint(1, 9)), *(f"{rng.randint(0, 99):02d}" for _ in range(4))]), f"{rng.choice('69')}{number(2)} {number(3)} {number(3)}"])
            else:
                span = rng.choice([f"0{rng.randint(1, 9)}{sep}0{rng.randint(1, 9)}{sep}{rng.randint(1950, 2039)}", f"0{rng.randint(10, 99)}{sep}{number(2)}", f"{rng.randint(1, 9)}{number(2)} {number(3)} {number(3)}"])
                near = rng.choice([*bad, "on", "about", "dated", "version"])
        elif kind == 9:  # spelled-out addresses in capitals
            span = f"{rng.choice('jkmst')}{rng.choice(filler)} {rng.choice(['(AT)', '[AT]', '(At)'])} {rng.choice(filler)} {rng.choice(['(DOT)', '[DOT]', '.'])} {rng.choice(['com', 'org', 'net'])}"
            personal, near = True, rng.choice(good)
        else:  # the inside of something longer
            span, personal = f"{number(13)}", False
            near = rng.choice(['token = "', "id=", "v", "#"]) + rng.choice(["", "a3f09bc7d1e2"])
        glue = "" if kind == 7 else " "
        lines.append((f"{words(3)} {near}{glue}{span} {words(3)}", int(personal)))
    return lines


def _labelled(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Features of the training lines' wide spans, by the very expressions that
    documents go through.  The lines are part of the plan: no Python worker."""
    lines = training_lines()
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(_as_json(lines)), "array<struct<line:string,label:int>>")).alias("r")).select("r.line", "r.label")
    spans = rows.select("line", "label", wide_spans(F.col("line")).alias("spans"))
    wanted = spans.select("label", F.transform("spans", lambda s: F.array(*features(chunked(F.col("line")), s))).alias("x"))
    found = [(row["label"], x) for row in wanted.collect() for x in row["x"]]
    return np.array([x for _, x in found]), np.array([label for label, _ in found], dtype=float)


def _as_json(lines: list[tuple[str, int]]) -> str:
    import json

    return json.dumps([{"line": line, "label": label} for line, label in lines])


@lru_cache(maxsize=4)
def _fitted(spark: SparkSession, precision: float, rounds: int):
    x, y = _labelled(spark)
    fit = np.arange(len(y)) % 3 != 0
    model = fit_boosted(x[fit], y[fit], rounds=rounds, depth=3, rate=0.25)
    margin, truth, form = model.margin(x[~fit]), y[~fit], x[~fit, 0]
    isotonic = fit_isotonic(margin, truth)
    thresholds = {}
    for (_, code) in WIDE:
        own = form == code
        order = np.argsort(-margin[own], kind="stable")
        hits = np.cumsum(truth[own][order])
        good = np.flatnonzero(hits / np.arange(1, len(hits) + 1) >= precision)
        # the lowest margin down to which the calibrated precision holds; none: nothing of this form
        lowest = float(margin[own][order][good[-1]]) if len(good) else float("inf")
        even = float(np.interp(0.5, isotonic.values, isotonic.knots))
        thresholds[code] = max(lowest, even)
    return model, thresholds


def all_spans(spark: SparkSession, text: Column, base: Column, precision: float = 0.97, rounds: int = 30) -> Column:
    """Base spans and the wide ones that the trees accept.

    An accepted span that overlaps a base span gives way to it; of two accepted
    ones the earlier stays, then the one whose kind is listed first, then the
    longer.
    """
    model, thresholds = _fitted(spark, precision, rounds)
    wanted = [(code, t) for code, t in thresholds.items() if t != float("inf")]

    def accepted(chunks: Column, span: Column) -> Column:
        def judged(x: Column) -> Column:
            margin = model.column([F.get(x, F.lit(k)) for k in range(len(FEATURES))])
            limit = F.lit(float("inf"))
            for code, threshold in wanted:
                limit = F.when(span["form"] == code, F.lit(threshold)).otherwise(limit)
            return margin >= limit

        return let(F.array(*features(chunks, span)), judged)

    def chosen(known: Column, candidates: Column) -> Column:
        clear = let(chunked(text), lambda chunks: F.filter(without_overlap(candidates, known), lambda s: accepted(chunks, s)))
        return F.array_sort(F.concat(known, earliest(clear)))

    def joined(known: Column) -> Column:
        return let(wide_spans(text), lambda candidates: F.when(F.size(candidates) == 0, known).otherwise(chosen(known, candidates)))

    return let(base, joined)


def without_overlap(spans: Column, known: Column) -> Column:
    """Those of ``spans`` that meet none of ``known``, in order: one pass back for
    the known span that starts next, one forward for the furthest end so far."""
    marked = "struct<span:" + SPAN + ",known:boolean,next:int>"
    both = F.concat(F.transform(known, lambda s: F.struct(s.alias("span"), F.lit(True).alias("known"))), F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(False).alias("known"))))
    far = F.lit(2**31 - 1)

    def back(following: Column, item: Column):
        start = item["span"]["start"]
        made = F.struct(item["span"].alias("span"), item["known"].alias("known"), following.alias("next")).cast(marked)
        return F.when(item["known"], F.least(start, following)).otherwise(following), made

    def forward(end: Column, item: Column):
        span = item["span"]
        keep = ~item["known"] & (span["start"] >= end) & (span["end"] <= item["next"])
        return F.when(item["known"], F.greatest(end, span["end"])).otherwise(end), F.struct(span.alias("span"), keep.alias("keep")).cast(f"struct<span:{SPAN},keep:boolean>")

    # a known span comes after others with its start in the way back, and before them in the way forward
    order = lambda first: lambda a, b: F.when(a["span"]["start"] != b["span"]["start"], F.when(a["span"]["start"] < b["span"]["start"], -1).otherwise(1)).otherwise(F.when(a["known"] == b["known"], 0).when(a["known"] == F.lit(first), -1).otherwise(1))
    backward = scanned(F.reverse(F.array_sort(both, order(False))), far, back, marked)
    judged = scanned(F.array_sort(F.reverse(backward), order(True)), F.lit(0), forward, f"struct<span:{SPAN},keep:boolean>")
    found = F.transform(F.filter(judged, lambda j: j["keep"]), lambda j: j["span"])
    return F.when(F.size(known) == 0, spans).otherwise(F.array_sort(found))


def earliest(spans: Column) -> Column:
    """Of sorted spans the first, and every one that begins after those taken."""

    def step(end: Column, span: Column):
        clear = span["start"] >= end
        return F.when(clear, span["end"]).otherwise(end), F.struct(span.alias("span"), clear.alias("keep")).cast(f"struct<span:{SPAN},keep:boolean>")

    judged = scanned(spans, F.lit(0), step, f"struct<span:{SPAN},keep:boolean>")
    return F.transform(F.filter(judged, lambda j: j["keep"]), lambda j: j["span"])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carried: list[str] | None = None) -> DataFrame:
    """All personal-data spans of every whole text: the id (or the ``carried``
    columns), the text, ``base`` and ``spans``, arrays of (start, rank, end,
    kind, form, text) in code points.

    Null text counts as empty and has no spans.  Repeated rows give repeated
    rows; other columns are ignored.  An empty table gives an empty result.
    """
    text = F.col("text")
    own = [F.col(c) for c in carried] if carried else [F.col(id_column).alias("doc_id")]
    names = carried or ["doc_id"]
    rows = docs.select(*own, whole_text(text_column).alias("text"))
    # most texts have no digit, no sign and no bracket that any pattern needs
    possible = text.rlike("[0-9@+]|[(\\[{][Aa][Tt]|[0-9A-Fa-f]:[0-9A-Fa-f]")
    none = F.array().cast(NO_SPANS)
    both = F.when(possible, let(base_spans(text), lambda base: F.struct(base.alias("base"), all_spans(docs.sparkSession, text, base).alias("spans")))).otherwise(
        F.struct(none.alias("base"), none.alias("spans"))
    )
    return rows.select(*names, "text", both.alias("found")).select(*names, "text", "found.base", "found.spans")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    found = find_pii(docs)
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _of(kind: str):
    return lambda span: span["kind"] == kind


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind."""

    def replaced(chunks: Column) -> Column:
        def step(at: Column, span: Column):
            clear = span["start"] >= at
            put = F.concat(piece(chunks, at, span["start"]), F.lit("["), F.upper(span["kind"]), F.lit("]"))
            return F.greatest(at, span["end"]), F.when(clear, put).otherwise(F.lit(""))

        rest = piece(chunks, F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text))
        return F.concat(F.array_join(scanned(spans, F.lit(0), step, "string"), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(chunked(text), replaced))
