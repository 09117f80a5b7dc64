"""Temperature mixing of sources: shares raised to an exponent, realised as budgeted block permutations.

A source's weight is its token share to the power ``a``, normalised: 1 keeps the proportions, 0 makes sources equal.
The exponent is bisected on a grid of ``2 ** -STEPS`` until the weights reach a target entropy, or until no source is
repeated more than a limit beside the least repeated. Each source then gets its weight of the token budget in blocks:
whole permutations of its documents, and a part of one more, cut where the tokens come nearest to the budget. Everything is
DataFrame functions; bisection works on sums over sources, and the cut on sums over slices of the permutation, so
that a source with most of the rows is never ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.shared import store

#: Bisection steps, and how many of them one pass over the sources evaluates.
STEPS, AT_ONCE = 20, 5
#: Slices of a permutation, by the first hexadecimal digits of the documents' digests: as many as make a slice of the
#: largest source about so many documents.
SLICE_ROWS, LEAST_DIGITS, MOST_DIGITS = 4096, 2, 6


def token_count(text: Column) -> Column:
    """Spaces and line feeds plus one: the number of words where single ones part them; empty and null texts have 0."""
    parts = F.length(text) - F.length(F.translate(text, " \n", "")) + 1
    return F.when(F.length(text) > 0, parts).otherwise(0).cast("bigint")


def _grid(sources: DataFrame, tops: list[int]) -> list[tuple[float, float, float]]:
    """For each exponent (in steps of 2 ** -STEPS): sum of p ** a, sum of p ** a * ln p, largest p ** (a - 1) over least."""
    columns = []
    for i, top in enumerate(tops):
        a = top / 2**STEPS
        power = F.pow("share", F.lit(a))
        columns += [F.sum(power).alias(f"s{i}"), F.sum(power * F.log("share")).alias(f"l{i}"), (F.pow(F.min("share"), F.lit(a - 1)) / F.pow(F.max("share"), F.lit(a - 1))).alias(f"r{i}")]
    row = sources.agg(*columns).first()
    return [(row[f"s{i}"], row[f"l{i}"], row[f"r{i}"]) for i in range(len(tops))]


def exponent(sources: DataFrame, entropy: float | None = None, max_repeat: float | None = None) -> float:
    """The least exponent in [0, 1] whose weights have at most ``entropy`` (nats) or ratio of repetition ``max_repeat``.

    sources: (source, share > 0). Entropy and repetition both fall as the exponent grows to 1, where the ratio is 1. With
    no limit, or no sources, it is 1. Each pass evaluates all points that AT_ONCE bisection steps could ask for.
    """
    if entropy is None and max_repeat is None or sources.isEmpty():
        return 1.0

    def fits(total: float, logs: float, ratio: float, a: float) -> bool:
        return (entropy is None or math.log(total) - a * logs / total <= entropy) and (max_repeat is None or ratio <= max_repeat)

    low, high = -1, 2**STEPS  # high fits, or is the end of the range
    while high - low > 1:
        step = max(1, (high - low) >> AT_ONCE)
        tops = list(range(low + step, high, step))
        if not tops:
            break
        good = [fits(*x, top / 2**STEPS) for x, top in zip(_grid(sources, tops), tops, strict=True)]
        first = next((i for i, ok in enumerate(good) if ok), None)
        low, high = (tops[-1], high) if first is None else (tops[first] - step, tops[first])
    return high / 2**STEPS


def digest(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Decides a document's place in a permutation."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id).cast("binary"))


def _named(doc_id: Column, text: Column) -> Column:
    """What a document is known by: its id, or its text's digest if that is null, so that such rows have places of their own."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


#: Columns that ``mix`` appends.
ADDED = ("_source", "_tokens", "_epoch", "_copies", "_weight", "_order")


def mix(documents: DataFrame, entropy: float | None = None, max_repeat: float | None = 1.5, budget: int | None = None, seed: int = 1) -> DataFrame:
    """documents with the columns ADDED appended (in place of any of that name), once per time a document is used.

    ``budget`` counts tokens; by default it is the least at which every source is used whole at least once, so that
    nothing is lost. ``_order`` in [0, 1) spreads each source evenly over the mixture. A null source is a source of its
    own; documents without tokens follow their source's whole permutations and stand in none of the parts (once, if
    the source has no tokens at all). Repeated rows are documents like others, but share a place in the permutation with
    those of the same id, and those without an id with those of the same text.
    """
    columns = [c for c in documents.columns if c not in ADDED]
    source = F.when(F.col("source").isNull(), F.lit("null:")).otherwise(F.concat(F.lit("source:"), F.col("source").cast("string")))
    docs = documents.select(*columns, source.alias("_mx_source"), token_count(F.col("text")).alias("_mx_tokens"), _named(F.col("doc_id"), F.col("text").cast("string")).alias("_mx_id"))
    slim, _ = store(docs.select("_mx_id", "_mx_source", "_mx_tokens"), "tokens")
    sums, _ = store(slim.groupBy("_mx_source").agg(F.sum("_mx_tokens").alias("_mx_available"), F.count("*").alias("_mx_rows")), "sources")
    total, most = sums.agg(F.coalesce(F.sum("_mx_available"), F.lit(0)), F.coalesce(F.max("_mx_rows"), F.lit(0))).first()
    digits = min(MOST_DIGITS, max(LEAST_DIGITS, math.ceil(math.log(max(1, most / SLICE_ROWS), 16))))
    shares = sums.where("_mx_available > 0").withColumn("share", F.col("_mx_available") / F.lit(float(max(total, 1))))
    a = exponent(shares, entropy, max_repeat)
    # A source is repeated weight * budget / available times: by default the largest, which is repeated least, once.
    norm, least = shares.agg(F.sum(F.pow("share", F.lit(a))), F.pow(F.max("share"), F.lit(a - 1))).first()
    norm, least = norm or 1.0, least or 1.0
    tokens = float(total) * norm / least if budget is None else float(budget)
    weight = F.pow("share", F.lit(a)) / F.lit(norm)
    plan = shares.select("_mx_source", weight.alias("_mx_weight"), F.col("_mx_available"), F.floor(weight * tokens + F.lit(0.5)).cast("bigint").alias("_mx_wanted")).select(
        "_mx_source", "_mx_weight", F.expr("_mx_wanted DIV _mx_available").cast("int").alias("_mx_whole"), F.expr("_mx_wanted % _mx_available").alias("_mx_rest"), (F.col("_mx_wanted") / F.col("_mx_available")).alias("_mx_copies")
    )

    # The part: sums over slices of the permutation find the slice in which a source's rest ends, ranks in it the place.
    tagged = slim.join(plan, "_mx_source").where("_mx_rest > 0 AND _mx_tokens > 0").withColumn("_mx_key", digest(seed, F.col("_mx_whole"), F.col("_mx_id"))).withColumn("_mx_slice", F.substring("_mx_key", 1, digits))
    slices, _ = store(tagged.groupBy("_mx_source", "_mx_slice").agg(F.sum("_mx_tokens").alias("held"), F.max("_mx_rest").alias("rest")), "slices")
    slices = slices.withColumn("before", F.sum("held").over(Window.partitionBy("_mx_source").orderBy("_mx_slice")) - F.col("held"))
    last, _ = store(slices.where("before < rest AND before + held >= rest").select("_mx_source", "_mx_slice", "before"), "last")
    within = F.sum("_mx_tokens").over(Window.partitionBy("_mx_source").orderBy("_mx_key", "_mx_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = tagged.join(last, ["_mx_source", "_mx_slice"]).withColumn("upto", F.col("before") + within)
    # Nearest to the budget: a document is in if at least half of it fits.
    cut = edge.groupBy("_mx_source").agg(F.max("_mx_slice").alias("_mx_edge"), F.max(F.when(2 * F.col("_mx_rest") >= 2 * F.col("upto") - F.col("_mx_tokens"), F.col("_mx_key"))).alias("_mx_last"))
    placing, _ = store(plan.join(cut, "_mx_source", "left"), "plan")

    placed = docs.join(placing, "_mx_source", "left")
    whole, copies = F.coalesce("_mx_whole", F.lit(1)), F.coalesce("_mx_copies", F.lit(1.0))
    part = digest(seed, whole, F.col("_mx_id"))
    in_part = (F.col("_mx_rest") > 0) & (F.col("_mx_tokens") > 0) & ((F.substring(part, 1, digits) < F.col("_mx_edge")) | (part <= F.coalesce("_mx_last", F.lit(""))))
    times = whole + F.coalesce(in_part, F.lit(False)).cast("int")
    used = placed.withColumn("_mx_times", times).where("_mx_times > 0").withColumn("_mx_epoch", F.explode(F.expr("sequence(0, _mx_times - 1)")))
    fraction = F.conv(F.substring(digest(seed, F.col("_mx_epoch"), F.col("_mx_id")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    order = F.least((F.col("_mx_epoch") + fraction) / F.greatest(copies, F.lit(1e-9)), F.lit(1 - 1e-9))
    found = (F.expr("CASE WHEN _mx_source LIKE 'source:%' THEN substring(_mx_source, 8) END"), F.col("_mx_tokens"), F.col("_mx_epoch"), copies, F.coalesce("_mx_weight", F.lit(0.0)), order)
    return used.select(*(F.col(f"`{c}`") for c in columns), *(x.alias(c) for x, c in zip(found, ADDED, strict=True)))
