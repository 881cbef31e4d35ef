"""Winnowing fingerprints, with DataFrame functions only.

Tokens are runs of up to 16 non-blank code points, and single code points in
scripts that write no blanks and in what precedes the last 16 of longer runs, so
that a passage copied to another place inside a run has the same tokens there.
Every k consecutive tokens have a rolling hash, the cyclic polynomial of their
64-bit hashes: rotated once, without the token that leaves, with the one that
enters.  Array functions have no state to roll, so the hashes of all places are
made together, of two halves each, which gives the same values (tests roll them).

Of every window of ``window`` consecutive hashes the smallest is chosen, the
rightmost of equal ones, and its position is kept.  Hence any two texts that share
``window + k - 1`` consecutive tokens share a fingerprint, and none is chosen for
less than k tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evergrove.llm.common import let, shuffle_partitions, whole_text

#: Scripts without blanks between words (Thai, Lao, Burmese, Khmer,
#: kana, CJK ideographs, Hangul).
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
#: All other code points but blanks, most frequent first; a listed
#: class is several times as fast as a negated one.
SPACED = r"\x21-\u0dff\u0f00-\u0fff\u10a0-\u177f\u1800-\u303f\u3100-\u33ff\ua000-\uabff\ud7b0-\x{10ffff}\x00-\x08\x0e-\x1f"
TOKEN = rf"[{SPACED}]{{1,16}}+(?![{SPACED}])|\S"

GRAM = 2
WINDOW = 2  # small, so that a short text keeps several fingerprints
LOWEST = -(2**63)


def rotated(value: Column, by: int) -> Column:
    """The 64 bits of ``value``, rotated to the left."""
    by %= 64
    return value if not by else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def rolling_hashes(hashes: Column, gram: int) -> Column:
    """The cyclic polynomial of every ``gram`` consecutive hashes: that of
    m + n is that of the first m, rotated n times, with that of the next n."""
    if gram == 1:
        return hashes
    left, right = gram - gram // 2, gram // 2

    def joined(firsts: Column) -> Column:
        count = F.size(hashes) - (gram - 1)
        pair = lambda seconds: F.zip_with(F.slice(firsts, F.lit(1), count), F.slice(seconds, F.lit(left + 1), count), lambda a, b: rotated(a, right).bitwiseXOR(b))
        return pair(firsts) if left == right else let(rolling_hashes(hashes, right), pair)

    return joined(hashes) if left == 1 else let(rolling_hashes(hashes, left), joined)


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """The hash of every ``gram`` consecutive tokens; of all tokens if fewer."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def rolled(hashes: Column) -> Column:
        count = F.size(hashes)
        return (
            F.when(count >= gram, rolling_hashes(hashes, gram))
            .when(count > 0, F.array(F.xxhash64(F.concat_ws(",", F.transform(hashes, lambda h: h.cast("string"))))))
            .when(F.length(text) > 0, F.array(F.xxhash64(text)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), rolled)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash, position>> in order of position."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")

    def chosen(hashes: Column) -> Column:
        count = F.size(hashes)
        # the place of the minimum over 1, 2, 4, ... hashes; of equal ones the right one
        later = lambda a, b: F.when(F.get(hashes, b) <= F.get(hashes, a), b).otherwise(a)
        if window == 1:
            places = F.transform(hashes, lambda _, i: i)
        else:
            places, reach = F.transform(hashes, lambda h, i: F.when(F.get(hashes, i + 1) <= h, i + 1).otherwise(i)), 2
            while reach < window:
                places = let(places, _reaching(reach, later))
                reach *= 2
        windows = F.array_distinct(F.slice(places, 1, F.greatest(count - (window - 1), F.lit(1))))
        opened = F.transform(windows, lambda place: F.struct(F.get(hashes, place).alias("hash"), place.alias("position")))
        return F.when(count > 0, opened).otherwise(F.array().cast("array<struct<hash:bigint,position:int>>"))

    return let(gram_hashes(text, gram), chosen)


def _reaching(step: int, later):
    """From places over ``step`` hashes to those over twice as many."""
    return lambda places: F.transform(places, lambda a, i: later(a, F.coalesce(F.get(places, i + step), a)))


def fingerprint_text(prints: Column) -> Column:
    return F.concat_ws(" ", F.transform(prints, lambda p: F.concat(F.lower(F.hex(p["hash"])), F.lit("@"), p["position"].cast("string"))))


def likeness(left: Column, right: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct hashes; of two empty ones 1."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def distinct_hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def with_next(rows: DataFrame, key: str, carried: list[str], added: dict[str, Column] | None = None) -> DataFrame:
    """Add ``next_<c>`` for every carried column: the row with the next lower
    ``key`` (after the lowest: the highest).  The columns ``added`` are made
    after the shuffle, which does not carry them; they may be ``carried``.

    Rows are dealt to key ranges, several to a task, whose upper bounds are keys
    that occur; the row at a range's upper bound is also sent, as a guest, to the
    range above, where it follows that range's lowest row.  So no task sees more
    than its ranges, and no second join is needed.  The bounds are one number per
    range, whatever the size of the table.
    """
    spark = rows.sparkSession
    ranges = min(4 * shuffle_partitions(spark), 20_000)
    found = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges)).alias("b"), F.max(key).alias("top")).first()
    if found["top"] is None:
        bounds: list[int] = [0]
    else:
        bounds = sorted({*(found["b"] or []), found["top"]})
    above = {b: k + 1 for k, b in enumerate(bounds)}
    above[bounds[-1]] = 0  # after the last range: the first row again
    guests = spark.createDataFrame([(b, r) for b, r in above.items()], "guest_key long, guest_range int")
    upper = F.array(*[F.lit(b) for b in bounds])
    own = rows.withColumn("__range", _range_of(F.col(key), upper, len(bounds)))
    # one row per bound: the broadcast is as large as the list of ranges
    both = own.join(F.broadcast(guests), F.col(key) == F.col("guest_key"), "left")
    placed = both.withColumn(
        "__place",
        F.explode(
            F.when(F.col("guest_range").isNull(), F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest")))).otherwise(
                F.array(F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest")), F.struct(F.col("guest_range").alias("r"), F.lit(True).alias("guest")))
            )
        ),
    ).select(*rows.columns, F.col("__place.r").alias("__range"), F.col("__place.guest").alias("__guest"))
    placed = placed.repartition("__range").withColumns(added or {})
    order = Window.partitionBy("__range").orderBy("__guest", F.col(key).desc(), "__tie")
    return placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where(~F.col("__guest")).drop("__range", "__guest")


def _range_of(key: Column, upper: Column, count: int) -> Column:
    """Index of the first bound that is not below the key, by bisection."""
    below = F.lit(0)  # bounds known to be below the key
    step = 1 << count.bit_length()
    while step:
        below = let(below, _raised(key, upper, count, step))
        step >>= 1
    return F.least(below, F.lit(count - 1))


def _raised(key: Column, upper: Column, count: int, step: int):
    return lambda n: F.when((n + step <= count) & (F.get(upper, n + step - 1) < key), n + step).otherwise(n)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprint every text: the id, ``n_chars`` and ``prints``, an array of
    (hash, position in tokens).

    Null text counts as empty and has no prints; a text of blanks only has one,
    its own hash.  Texts of fewer than ``gram`` tokens have the hash of all of
    them.  Repeated rows give repeated rows.  Other columns are ignored.
    """
    text = whole_text(text_column)
    return docs.select(F.col(id_column).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), winnow(text, gram, window).alias("prints"))


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they
    and the next document's are.

    The edited form has the text's last third (in code points, rounded down)
    replaced by the start of the next document, in descending id; the last
    document is followed by the first.  Null ids come last; rows with one id are
    ordered by their text's hash.  A single document is its own next.  Two empty
    fingerprints have likeness 1, an empty and another one 0.
    """
    text = whole_text(text_column)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("__key"),
        text.alias("text"),
        F.xxhash64(text).alias("__tie"),
    )
    paired = with_next(rows, "__key", ["text", "prints"], {"prints": winnow(F.col("text"))})
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "prints",
        "next_prints",
        F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"),
    ).select("*", winnow(F.col("edited")).alias("edited_prints"))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("prints")).alias("fingerprint"),
        fingerprint_text(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(distinct_hashes(F.col("prints")), distinct_hashes(F.col("edited_prints"))).alias("near_edited"),
        likeness(distinct_hashes(F.col("prints")), distinct_hashes(F.col("next_prints"))).alias("near_next"),
    )
