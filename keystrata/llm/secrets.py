"""Secret scans: fixed patterns, and a battery of randomness tests over the other long tokens.

Everything is DataFrame or SQL functions. A match's place follows from the lengths of the matches and of what lies
between them. For the battery each token's encoding is inferred as the smallest alphabet that holds its symbols; a
chi-squared test of uniformity, a runs test and a lag-one serial correlation give p-values under "uniformly random",
which Fisher's rule combines into how far from random a token looks. What has to be kept rare is the other error, a word
or identifier that is taken for a secret. So each token gets DECOYS: identifiers of its length, digits and kinds of
letters, made of the document's words from places that a checksum picks, joined as identifiers are. The share of decoys
that look as random as a token is its p-value under "word-like", and the Benjamini-Hochberg rule at ``Q`` picks secrets
within classes of length and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import discard, store

#: Order of kinds at the same start.
KINDS = ("assign", "access", "hex", "random")
# The base patterns. Runs are matched whole, so that a length can be asked for in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Tokens for the battery; a letter must occur.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Expected share of word-like tokens among those reported, decoys for a token, and steps of 1/8 that statistics are counted in.
Q, DECOYS, BINS = 0.05, 24, 400
#: What follows a document's own prose, so that none is without.
PROSE = " it was a long and quiet morning and the people of the town walked slowly along the river before they went to work in the fields and shops beyond the old bridge "

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of encodings from small to large.
ENCODINGS = (
    _DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER, _UPPER + _LOWER,
    _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _UPPER + _LOWER + _DIGITS + "+/-_",
)
PLACES = "array<struct<start:int,end:int>>"


def _running(array: str, step: str, start: str) -> str:
    """The running result of ``step`` over a and b, in blocks of the array's root in size, so that no fold copies it all.

    What a lambda reads is bound by a lambda around it: a column that is named inside would be computed for each element.
    """
    fold = "aggregate({0}, CAST(array() AS array<bigint>), (r, b) -> concat(r, transform(array(coalesce(CASE WHEN size(r) > 0 THEN element_at(r, -1) END, {1})), a -> {2})))"
    root = "CAST(ceil(sqrt(size(q))) AS int)"
    blocks = f"transform(sequence(1, size(q), {root}), i -> {fold.format(f'slice(q, i, {root})', start, step)})"
    before = fold.format("transform(slice(s, 1, size(s) - 1), x -> element_at(x, -1))", start, step)
    each = f"transform(array({blocks}), s -> flatten(zip_with(s, concat(array(CAST({start} AS bigint)), {before}), (x, a) -> transform(x, b -> {step}))))[0]"
    return f"transform(array({array}), q -> CASE WHEN size(q) > 0 THEN {each} ELSE CAST(array() AS array<bigint>) END)[0]"


def _places(matches: str, between: str) -> Column:
    """[(start, end)] of matches, given the array of matches and the array of texts between them."""
    lengths = f"zip_with({matches}, slice({between}, 1, size({matches})), (m, t) -> CAST(length(m) + length(t) AS bigint))"
    ends = _running(lengths, "a + b", "0L")
    return F.expr(f"CAST(zip_with({ends}, {matches}, (e, m) -> struct(e - length(m), e)) AS {PLACES})")


def _find(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds the columns ``_{name}`` (matches) and ``_{name}_at`` (their places); both empty where nothing matches."""
    df = df.withColumn(f"_{name}", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    some = F.size(f"_{name}") > 0
    df = df.withColumn("_between", F.when(some, F.split("_text", pattern, -1)))
    return df.withColumn(f"_{name}_at", F.when(some, _places(f"_{name}", "_between")).otherwise(F.expr(f"CAST(array() AS {PLACES})"))).drop("_between")


def _normal_tail(z: str) -> str:
    """P(Z > z) for z >= 0, by a rational approximation (absolute error under 1e-7), 1e-300 at least."""
    t = f"(1 / (1 + 0.2316419 * ({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"greatest(exp(-least(({z}) * ({z}) / 2, 690)) * 0.3989422804014327 * {poly}, 1e-300)"


def _with_decoys(tokens: str, prose: str) -> str:
    """[(start, end, class, real, token)]: each token and its decoys, which are of its class.

    The class tells the length's power of two, and whether digits, small and capital letters and signs occur.
    """
    kinds = [f"CAST(t.token RLIKE '{x}' AS int)" for x in ("[0-9]", "[a-z]", "[A-Z]", "[^0-9A-Za-z]")]
    class_ = " + ".join(f"{2**i} * {x}" for i, x in enumerate(kinds)) + " + 16 * CAST(floor(log2(length(t.token))) AS int)"
    sized = f"transform({tokens}, t -> struct(t.start AS start, t.end AS end, t.token AS token, regexp_replace(t.token, '[^0-9]', '') AS digits, {class_} AS class))"
    sized = f"transform({sized}, t -> struct(t.start, t.end, t.token, t.digits, t.class, length(t.token) - length(t.digits) AS m))"
    # Words from a place in the prose, which goes round: twice the length, as spaces may go.
    more = f"repeat(substring({prose}, 1, 2 * t.m), CAST(2 * t.m DIV length({prose}) AS int) + 1)"
    words = f"substring(CASE WHEN length({prose}) >= o + 2 * t.m THEN substring({prose}, o + 1, 2 * t.m) ELSE concat(substring({prose}, o + 1), {more}) END, 1, 2 * t.m)"
    cased = f"CASE WHEN t.class & 6 = 6 THEN initcap({words}) WHEN t.class & 4 = 4 THEN upper({words}) ELSE {words} END"
    joined_ = f"CASE WHEN t.class & 8 = 8 THEN translate({cased}, ' ', CASE WHEN r % 2 = 0 THEN '-' ELSE '_' END) ELSE replace({cased}, ' ', '') END"
    letters = f"transform(array(pmod(crc32(CAST(concat(t.token, ':', r) AS binary)), length({prose}))), o -> rpad(substring({joined_}, 1, t.m), t.m, 'e'))"
    decoy = f"transform({letters}, w -> CASE WHEN r % 3 = 0 THEN concat(w, t.digits) ELSE concat(substring(w, 1, t.m DIV 2), t.digits, substring(w, t.m DIV 2 + 1)) END)[0]"
    versions = f"concat(array(struct(true AS real, t.token AS token)), transform(sequence(1, {DECOYS}), r -> struct(false AS real, {decoy} AS token)))"
    return f"flatten(transform({sized}, t -> transform({versions}, v -> struct(t.start AS start, t.end AS end, t.class AS class, v.real AS real, v.token AS token))))"


def _battery(tokens: str) -> Column:
    """[(start, end, class, real, bin)]: how far from random each token looks, in steps of 1/8 of -ln of its combined p-value."""
    which = "CASE " + " ".join(f"WHEN t.token RLIKE '^[{a.replace('-', '')}{'-' * ('-' in a)}]+$' THEN '{a}'" for a in ENCODINGS) + " END"
    kept = "t.start AS start, t.end AS end, t.class AS class, t.real AS real"
    around = "zip_with(slice(t.x, 1, t.n - 1), slice(t.x, 2, t.n - 1), (a, b) -> {})"
    turns = around.format("CAST((2 * a >= t.k) <> (2 * b >= t.k) AS int)")
    serial = around.format("(a - (t.k - 1) / 2D) * (b - (t.k - 1) / 2D)")
    # Fisher's rule: a chi-squared variable with six degrees of freedom, h being half of it.
    nlp = "t.h - ln(1 + t.h + t.h * t.h / 2)"
    return F.expr(f"""transform(transform(transform(transform(transform(transform({tokens},
      t -> struct({kept}, t.token AS token, {which} AS alphabet)),
      t -> struct({kept}, t.token AS token, t.alphabet AS alphabet, length(t.alphabet) AS k, length(t.token) AS n, transform(split(t.token, ''), c -> instr(t.alphabet, c) - 1) AS x)),
      t -> struct({kept}, t.k AS k, t.n AS n,
        aggregate(sequence(1, t.k), 0D, (s, j) -> s + power(t.n - length(replace(t.token, substring(t.alphabet, j, 1), '')), 2)) * t.k / t.n - t.n AS chi,
        aggregate({turns}, 0, (s, c) -> s + c) AS turns,
        aggregate({serial}, 0D, (s, c) -> s + c) / ((t.k * t.k - 1) / 12D) AS serial)),
      t -> struct({kept}, (t.chi - (t.k - 1)) / sqrt(2D * (t.k - 1) * (t.n - 1) / t.n) AS z1, abs(t.turns - (t.n - 1) / 2D) / sqrt((t.n - 1) / 4D) AS z2, abs(t.serial) / sqrt(t.n - 1) AS z3)),
      t -> struct({kept}, -ln(CASE WHEN t.z1 < 0 THEN 1 - {_normal_tail("-t.z1")} ELSE {_normal_tail("t.z1")} END) - ln(2 * {_normal_tail("t.z2")}) - ln(2 * {_normal_tail("t.z3")}) AS h)),
      t -> struct({kept}, CAST(least(floor(greatest(0, {nlp}) * 8), {BINS}) AS int) AS bin))
    """)


TESTS = "array<struct<start:int,end:int,class:int,real:boolean,bin:int>>"


def _scanned(documents: DataFrame, columns: list[str]) -> DataFrame:
    """(row, _base, _tests): each row's columns as a struct, its base spans, and the battery's results over tokens beside these."""
    df = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN)):
        df = _find(df, name, pattern)
    df = df.withColumn("_value", F.when(F.size("_assign") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2))))
    span = "transform({0}, p -> struct(p.start AS start, {1} AS kind, p.end AS end))"
    long = span.format("filter(zip_with(_assign_at, coalesce(_value, array()), (p, v) -> struct(p.start AS start, p.end AS end, length(v) AS n)), p -> p.n >= 6)", 0)
    df = df.withColumn("_base", F.expr(f"""array_sort(concat({long}, {span.format("_access_at", 1)}, {span.format("_hex_at", 2)}))"""))
    # Beside base spans: none that begins earlier reaches in, none that begins later begins inside.
    tokens = "filter(zip_with(_token_at, _token, (p, t) -> struct(p.start AS start, 1 AS token_, p.end AS end, t AS token)), t -> t.token RLIKE '[A-Za-z]')"
    df = df.withColumn("_tokens", F.when(F.size("_token") > 0, F.expr(tokens)))
    both = "array_sort(concat(transform(_base, b -> struct(b.start AS start, 0 AS token_, b.end AS end, '' AS token)), _tokens))"
    df = df.withColumn("_both", F.when((F.size("_tokens") > 0) & (F.size("_base") > 0), F.expr(both)))
    earlier = _running("transform(_both, x -> CAST(CASE WHEN x.token_ = 0 THEN x.end ELSE 0 END AS bigint))", "greatest(a, b)", "0L")
    later = _running("transform(reverse(_both), x -> CAST(CASE WHEN x.token_ = 0 THEN x.start ELSE 2147483647 END AS bigint))", "least(a, b)", "2147483647L")
    df = df.withColumn("_earlier", F.when(F.col("_both").isNotNull(), F.expr(earlier))).withColumn("_later", F.when(F.col("_both").isNotNull(), F.expr(f"reverse({later})")))
    reached = "zip_with(zip_with(_both, _earlier, (x, a) -> struct(x, a)), _later, (y, b) -> struct(y.x AS x, y.a <= y.x.start AND b >= y.x.end AS beside))"
    beside = F.expr(f"transform(filter({reached}, y -> y.x.token_ = 1 AND y.beside), y -> y.x)")
    df = df.withColumn("_beside", F.when(F.col("_both").isNotNull(), beside).otherwise(F.col("_tokens")))
    some = F.size("_beside") > 0
    df = df.withColumn("_prose", F.when(some, F.concat(F.lower(F.regexp_replace("_text", TOKEN + "|[^A-Za-z]+", " ")), F.lit(PROSE))))
    df = df.withColumn("_versions", F.when(some, F.expr(_with_decoys("_beside", "_prose"))))
    tests = F.when(some, _battery("_versions")).otherwise(F.expr(f"CAST(array() AS {TESTS})"))
    return df.select("row", "_base", tests.alias("_tests"))


def random_limits(scanned: DataFrame, q: float = Q) -> dict[int, int]:
    """For each class the bin up to which tokens are reported, from the counts of tokens and decoys over all documents.

    A bin's p-value is the share of decoys, itself counted as one, that look as random; it is reported if that is at most
    q times the share of tokens. There are at most 512 classes of BINS bins.
    """
    tests = scanned.select(F.explode("_tests").alias("t")).groupBy("t.class", "t.bin", "t.real").count().collect()
    out = {}
    for which in {r["class"] for r in tests}:
        real, decoys = ({r.bin: r["count"] for r in tests if r["class"] == which and r.real == kind} for kind in (True, False))
        seen = below = 0
        for b in range(BINS):
            seen, below = seen + real.get(b, 0), below + decoys.get(b, 0)
            if seen and (1 + below) / (1 + sum(decoys.values())) <= q * seen / sum(real.values()):
                out[which] = b
    return out


def _reported(scanned: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Adds ``_all``: the base spans and those of the tokens within their class's limit, sorted."""
    cases = " ".join(f"WHEN {c} THEN t.bin <= {limit}" for c, limit in sorted(limits.items()))
    keep = f"CASE t.class {cases} ELSE false END" if cases else "false"
    more = F.expr(f"transform(filter(_tests, t -> t.real AND {keep}), t -> struct(t.start AS start, 3 AS kind, t.end AS end))")
    return scanned.select("row", "_base", F.array_sort(F.concat("_base", more)).alias("_all"))


def find_secrets(documents: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    """(row, _base, _all): each row of documents as a struct, and its spans (start, kind, end) in code points, end exclusive, sorted.

    kind indexes KINDS; ``_all`` holds the base patterns' spans and the battery's. Null texts count as empty and have no spans; rows with null or repeated ids are scanned alike.
    """
    if limits is None:
        # Stored, as exploding the tests would push a filter through all of the plan and repeat its expressions.
        tests, path = store(_scanned(documents, ["text"]).select("_tests"), "tests")
        limits = random_limits(tests)
        discard(documents.sparkSession, path)
    return _reported(_scanned(documents, documents.columns), limits)


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of every document; the texts are read once."""
    scanned, _ = store(_scanned(documents.select("doc_id", "text"), ["doc_id"]), "scanned")
    found = _reported(scanned, random_limits(scanned))
    count = lambda k: F.expr(f"CAST(size(filter(_base, s -> s.kind = {k})) AS bigint)")
    return found.select("row.doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(joined("_base").cast("binary"), 256).alias("base_sha256"), joined("_all").alias("spans"), F.expr("CAST(size(_all) - size(_base) AS bigint)").alias("n_random"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every span of text replaced by ``mark``; spans that overlap are one. Null texts stay null.

    Text is cut into one stretch for each block of spans and these are cut up, so that no span is sought from the start.
    """
    found = find_secrets(documents).withColumn("_some", F.when(F.size("_all") > 0, F.col("_all")))
    reach = _running("transform(_some, s -> CAST(s.end AS bigint))", "greatest(a, b)", "0L")
    found = found.withColumn("_reach", F.when(F.col("_some").isNotNull(), F.expr(reach)))
    cuts = "zip_with(_some, concat(array(0L), slice(_reach, 1, size(_reach) - 1)), (s, at) -> struct(CAST(at AS int) AS at, s.start AS start, s.end AS end))"
    found = found.withColumn("_cuts", F.when(F.col("_some").isNotNull(), F.expr(f"filter({cuts}, c -> c.start >= c.at)")))
    root = "CAST(ceil(sqrt(size(_cuts))) AS int)"
    blocks = f"transform(sequence(1, size(_cuts), {root}), i -> slice(_cuts, i, {root}))"
    stretch = f"transform({blocks}, b -> struct(b AS cuts, b[0].at AS at, substring(row.text, b[0].at + 1, element_at(b, -1).start - b[0].at) AS text))"
    piece = f"concat(substring(x.text, c.at - x.at + 1, c.start - c.at), '{mark}')"
    rest = "substring(row.text, CAST(element_at(_reach, -1) AS int) + 1)"
    clean = F.expr(f"concat(array_join(flatten(transform({stretch}, x -> transform(x.cuts, c -> {piece}))), ''), {rest})")
    text = F.when(F.col("_some").isNotNull(), clean).otherwise(F.col("row.text")).alias("text")
    return found.select(*(text if c == "text" else F.col(f"row.`{c}`") for c in documents.columns))
