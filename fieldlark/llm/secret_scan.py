"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens.

DataFrame and SQL functions only. Spans of a pattern come from splitting a text
by it: the parts between and the matches add up to the text, so running sums of
their lengths give the places.

The battery looks at long tokens that no fixed pattern covers. By the characters
it has, a token's encoding is inferred, which names an alphabet, listed from the
characters that ordinary text has most to those it has least. Three tests ask how
likely ordinary text of that encoding would look as random as the token does:
chi-squared uniformity over the alphabet (by how often two characters are the
same), the number of runs within the two halves of the alphabet, and lag-1 serial
correlation of the places in it. What is usual in ordinary text is measured on the corpus' own
tokens, per encoding and class of length: on those that surely aren't random, as the tests below reject
that, and together with a stated prior, as a corpus may have few of them. That a token is all hex digits is evidence of its
own, and so is the mixture of small and capital letters, digits and signs where an alphabet has several of
these: the likelihood of the moves between them in a random token over that in ordinary tokens.
Stouffer's rule combines all into one p-value; few characters say little, so
short tokens weigh little (20 digits or letters of one case hardly tell). Over all tokens of the corpus the Benjamini-Hochberg
rule, applied per encoding and class of length, keeps the share of false finds
below a set rate.

A find has to be consistent with randomness too: the same three tests, now
against a uniform alphabet, must not reject it, neither as too uneven nor, as
alphabets and keyboard rows are, as too even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Kind, pattern, the group whose length counts and its least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a whole run of [0-9a-f], as such a run holds no other
]
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, LETTERS = "0123456789", "etaoinsrhldcumfpgwybvkxjqz"
#: Encodings, the first that fits: name, characters, alphabet (common characters first) and its size; the prior for ordinary
#: tokens: the chance that two characters are the same, that neighbours are of different halves of the alphabet, and
#: the serial correlation.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS, 10, 0.17, 0.35, 0.2),
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", DIGITS + "eadcfb", 16, 0.14, 0.25, 0.2),
    ("lower", "^[a-z]+$", LETTERS, 26, 0.066, 0.25, 0.2),
    ("upper", "^[A-Z]+$", LETTERS, 26, 0.066, 0.25, 0.2),
    ("base32", "^[A-Z2-7]+$", LETTERS + "234567", 32, 0.06, 0.2, 0.2),
    ("lower36", "^[a-z0-9]+$", LETTERS + DIGITS, 36, 0.06, 0.2, 0.2),
    ("upper36", "^[A-Z0-9]+$", LETTERS + DIGITS, 36, 0.06, 0.2, 0.2),
    ("base64", "^[A-Za-z0-9+/_-]+$", LETTERS + "_-/" + DIGITS + LETTERS.upper() + "+", 64, 0.058, 0.2, 0.2),
]
#: Chance that a character of an ordinary token is a hex digit, and that one of a number is a letter.
HEX_IN_WORD, LETTER_IN_NUMBER = 0.5, 0.05
#: Kinds of characters: small letters, capitals, digits, signs. Shares of them in the alphabets that mix them (a body is in small letters but for base64).
KIND_PATTERNS = ("[a-z]", "[A-Z]", "[0-9]")
MIXED = {"base64": (26 / 64, 26 / 64, 10 / 64, 2 / 64), "lower36": (26 / 36, 0.0, 10 / 36, 0.0), "upper36": (26 / 36, 0.0, 10 / 36, 0.0), "base32": (26 / 32, 0.0, 6 / 32, 0.0)}
#: The prior for moves from a kind (row) to a kind in ordinary tokens.
MOVES = ((0.78, 0.08, 0.05, 0.09), (0.75, 0.17, 0.04, 0.04), (0.08, 0.04, 0.70, 0.18), (0.55, 0.20, 0.20, 0.05))
#: Tokens, and moves from each kind, that the priors count for.
PRIOR, PRIOR_MOVES = 100.0, 500.0
#: What a token's z by the priors has to be over to count as an ordinary one.
LOOKS = -3.0
#: Quantiles that the lower tail of ordinary tokens is fitted by, and the normal distribution's there.
TAIL, TAIL_Z = (0.05, 0.01), (-1.6448536269514722, -2.3263478740408408)
#: Correlation that is allowed for between two tests of a token.
TOGETHER = 0.2
#: Standard deviations beyond which a test rejects randomness, and as too even; rate of false finds; bins per power of ten.
REJECT, EVEN, RATE, BINS = 3.29, 2.58, 0.01, 10
SPANS = "array<struct<s:int,e:int,kind:string>>"
PLACES = "array<struct<s:int,e:int,token:string>>"


def find(text: Column, pattern: str, group: int, least: int) -> Column:
    """(s, e, token) of all leftmost non-overlapping matches whose group has ``least`` characters, in code points."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)).alias("n"),
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"),
    )

    def placed(x: Column) -> Column:
        def at(begin: Column) -> Column:
            start = lambda i: (F.get(begin, i) + F.get(x["gap"], i)).cast("int")
            found = F.transform(x["whole"], lambda m, i: F.struct(start(i).alias("s"), (start(i) + F.length(m)).alias("e"), m.alias("token"), F.get(x["n"], i).alias("n")))
            return F.transform(F.filter(found, lambda m: m["n"] >= least), lambda m: F.struct(m["s"], m["e"], m["token"]))

        return common.let(common.running(F.transform(x["whole"], lambda m, i: F.length(m) + F.get(x["gap"], i))), at)

    return F.when(F.regexp_like(text, F.lit(pattern)), common.let(parts, placed)).otherwise(F.expr(f"cast(array() as {PLACES})"))


def _phi(z: Column) -> Column:
    """The normal distribution function; its lower tail by a continued fraction, as that is where it counts."""
    near = 1 / (1 + F.exp(-z * (1.5976 + 0.070566 * z * z)))
    x = F.greatest(-z, F.lit(1.0))
    below = x
    for k in range(8, 0, -1):
        below = x + k / below
    return F.when(z < -2, F.exp(-z * z / 2) / (below * 2.5066282746)).otherwise(near)


def _encoding(token: Column) -> Column:
    """The encoding's row of ``ENCODINGS``, as a struct; null where none fits."""
    out = None
    for name, pattern, letters, size, same, change, serial in ENCODINGS:
        row = F.struct(F.lit(name).alias("encoding"), F.lit(letters).alias("letters"), F.lit(float(size)).alias("a"), F.lit(same).alias("same"), F.lit(change).alias("change"), F.lit(serial).alias("serial"))
        fits = F.regexp_like(token, F.lit(pattern))
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out


def _pairs(c, f) -> Column:
    return F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), f)


def measured(tokens: DataFrame) -> DataFrame:
    """Adds to tokens (column token) what the tests ask for, their stratum (encoding, length class), and whether a test rejects randomness."""
    t = tokens.withColumn("body", F.regexp_replace("token", "=+$", "")).withColumn("enc", _encoding(F.col("body"))).where("enc is not null")
    t = t.select("*", "enc.*").withColumn("body", F.when(F.col("encoding") == "base64", F.col("body")).otherwise(F.lower("body")))
    t = t.withColumns({"n": F.length("body").cast("double"), "v": F.transform(F.split("body", ""), lambda c: F.instr(F.col("letters"), c) - 1)})
    squares = F.aggregate(F.array_distinct("v"), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter("v", lambda y: y == x)).cast("double"), F.lit(2.0)))
    t = t.withColumns({"squares": squares, "mean": F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n"), "up": F.transform("v", lambda x: (x.cast("double") * 2 >= F.col("a")).cast("int"))})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    # one sign for each kind of character, then the numbers of the moves
    kinds = F.split(F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", KIND_PATTERNS[2], "2"), KIND_PATTERNS[0], "0"), KIND_PATTERNS[1], "1"), "+/_-", "3333"), "")
    moves = F.when(F.col("encoding").isin(*MIXED), _pairs(F.transform(kinds, lambda c: c.cast("int")), lambda x, y: x * 4 + y))
    t = t.withColumns(
        {
            "ones": total("up"),
            "changes": total(_pairs("up", lambda x, y: (x != y).cast("double"))),
            "covered": total(_pairs("v", lambda x, y: (x - F.col("mean")) * (y - F.col("mean")))),
            "spread": F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))),
            "letters": F.size(F.filter("v", lambda x: x >= 10)).cast("double"),
            "moves": moves,
        }
    )
    a, n = F.col("a"), F.col("n")
    t = t.withColumns({"alike": (F.col("squares") - n) / (n * (n - 1)), "varied": F.col("changes") / (n - 1), "r": F.abs(F.when(F.col("spread") > 0, F.col("covered") / F.col("spread")))})
    df = a - 1
    even = (F.pow(F.greatest(a / n * F.col("squares") - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    many = 2 * F.col("ones") * (n - F.col("ones")) / n
    runs = (F.col("changes") - many) / F.sqrt(F.greatest(many * (many - 1) / (n - 1), F.lit(1e-9)))
    t = t.withColumns(
        {
            "rejected": F.coalesce((even > REJECT) | (even < -EVEN) | (F.abs(runs) > REJECT) | (F.col("r") * F.sqrt(n) > REJECT), F.lit(True)),
            "stratum": F.concat_ws("/", "encoding", F.floor(F.log2(n)).cast("string")),
        }
    )
    return t.select(*tokens.columns, "encoding", "stratum", "rejected", "n", "same", "change", "serial", "alike", "varied", "r", "letters", "moves")


def _odds(random: Column, chance) -> Column:
    """Of each of the 16 moves the logarithm of its chance in a random token over that in an ordinary one."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda m: F.when(F.get(random, m % 4) > 0, F.log(F.get(random, m % 4) / chance(m))).otherwise(0.0))


def _mixtures(spark) -> DataFrame:
    """(encoding, random, prior): of each encoding of ``MIXED`` the shares in a random token, and the prior for the moves."""
    rows = [(e, list(r), [x for row in _prior_moves(r) for x in row]) for e, r in MIXED.items()]
    return spark.createDataFrame(rows, "encoding string, random array<double>, prior array<double>")


def usual(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is usual in ordinary tokens: (stratum, m, u_..), sums by stratum, and (encoding, odds) of moves."""
    sums = plain.groupBy("stratum").agg(F.count("r").alias("m"), *[F.sum(F.when(F.col("r").isNotNull(), F.col(c))).alias(f"u_{c}") for c in ("alike", "varied", "r")])
    seen = plain.select("encoding", F.explode("moves").alias("move")).groupBy("encoding", "move").agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = seen.groupBy("encoding").agg(F.map_from_entries(F.collect_list(F.struct("move", "n"))).alias("seen"))  # 16 at most
    got = _mixtures(plain.sparkSession).join(seen, "encoding", "left")
    count = lambda m: F.coalesce(F.try_element_at("seen", m), F.lit(0.0))
    row = lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, j: s + count((F.floor(m / 4) * 4 + j).cast("int")))
    chance = lambda m: (count(m) + PRIOR_MOVES * F.get("prior", m)) / (row(m) + PRIOR_MOVES)
    return sums, got.select("encoding", _odds(F.col("random"), chance).alias("odds"))


def _prior_moves(random: tuple[float, ...]) -> list[list[float]]:
    """``MOVES`` among the kinds that an alphabet has."""
    own = [[m if random[j] > 0 else 0.0 for j, m in enumerate(row)] for row in MOVES]
    return [[m / sum(row) if sum(row) else 0.0 for m in row] for row in own]


def _z(same: Column, change: Column, serial: Column) -> Column:
    """How far below the usual figures a token's lie, all tests taken together; null where a test can't tell."""
    n, r = F.col("n"), F.col("r")
    z_chi = (F.col("alike") - same) / F.sqrt(2 * same * (1 - same) / (n * (n - 1)))
    z_runs = (n - 1) * (change - F.col("varied")) / F.sqrt((n - 1) * change * (1 - change))
    z_serial = (r - serial) * F.sqrt(n)
    numbers = (LETTER_IN_NUMBER * n - F.col("letters")) / F.sqrt(LETTER_IN_NUMBER * (1 - LETTER_IN_NUMBER) * n)
    beyond = lambda x: F.sqrt(F.greatest(2 * x - F.log(4 * x), F.lit(0.0)))  # noqa: E731  about the deviation with a tail of exp(-x)
    words = -beyond(-n * F.log(F.lit(HEX_IN_WORD)))
    llr = F.aggregate("moves", F.lit(0.0), lambda s, m: s + F.get("odds", m))
    # a likelihood ratio of exp(x) has a chance of exp(-x) at most
    mixture = F.when(llr > 1, -beyond(llr)).otherwise(F.sqrt(2 * F.greatest(-llr, F.lit(0.0))))
    is_hex = F.col("encoding") == "hex"
    more = F.when(is_hex, F.greatest(words, numbers)).otherwise(F.coalesce(mixture, F.lit(0.0)))
    k = F.when(is_hex | F.col("moves").isNotNull(), 4.0).otherwise(3.0)
    return (z_chi + z_runs + z_serial + more) / F.sqrt(k + k * (k - 1) * TOGETHER)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to tokens (column token) their stratum (encoding, length class), whether a test rejects randomness, and log10 of p.

    Ordinary tokens are those that a test rejects as random and that don't look it
    by the priors alone: a corpus that is all secrets has some that a test rejects by chance.
    """
    priors = _mixtures(tokens.sparkSession).select("encoding", _odds(F.col("random"), lambda m: F.get("prior", m)).alias("odds"))
    rows = measured(tokens).join(F.broadcast(priors), "encoding", "left")  # a row for each encoding
    rows = rows.withColumn("plain", F.col("rejected") & F.coalesce(_z(F.col("same"), F.col("change"), F.col("serial")) > LOOKS, F.lit(True))).drop("odds")
    rows = common.stored(rows, "secret-figures")
    sums, odds = usual(rows.where("plain"))
    # a row for each stratum, and for each encoding
    t = rows.join(F.broadcast(sums), "stratum", "left").join(F.broadcast(odds), "encoding", "left")
    told = lambda name, prior: (F.coalesce(f"u_{name}", F.lit(0.0)) + PRIOR * F.col(prior)) / (F.coalesce("m", F.lit(0)) + PRIOR)
    t = t.select(*tokens.columns, "stratum", "rejected", "plain", _z(told("alike", "same"), told("varied", "change"), told("r", "serial")).alias("z"))
    # ordinary tokens are of several kinds, so the lower tail of their z is fitted, by two of its quantiles; z in hundredths, of which there are few
    low = F.percentile(F.round("z", 2), [TAIL[0], TAIL[1]])
    tails = t.where("plain and z is not null").groupBy("stratum").agg(F.count(F.lit(1)).alias("m"), low.alias("q"))
    spread = (F.get("q", 0) - F.get("q", 1)) / (TAIL_Z[0] - TAIL_Z[1])
    held = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    share = F.col("m") / (F.col("m") + PRIOR)
    spread = held(spread, 0.8, 2.0)
    tails = tails.select("stratum", (1 + share * (spread - 1)).alias("spread"), (share * held(F.get("q", 0) - TAIL_Z[0] * spread, -1.5, 0.0)).alias("centre"))
    t = t.join(F.broadcast(tails), "stratum", "left")
    z = (F.col("z") - F.coalesce("centre", F.lit(0.0))) / F.coalesce("spread", F.lit(1.0))
    log_p = F.log10(F.greatest(_phi(F.coalesce(z, F.lit(0.0))), F.lit(1e-300)))
    return t.select(*tokens.columns, "stratum", "rejected", log_p.alias("log_p"))


def discoveries(tested: DataFrame, rate: float = RATE) -> dict[str, float]:
    """Of each stratum, the largest log10 p that passes the Benjamini-Hochberg rule.

    The rule sees p-values in bins, by the upper edge of each: a table of a few
    strata times at most 300 * BINS bins, whatever the corpus.
    """
    bins = tested.groupBy("stratum", F.ceil(F.col("log_p") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("stratum")
    ranked = bins.select("stratum", "bin", F.sum("n").over(w.orderBy("bin")).alias("rank"), F.sum("n").over(w).alias("m"))
    passed = ranked.where(F.col("bin") / BINS <= F.log10(F.lit(rate) * F.col("rank") / F.col("m")))
    return {r["stratum"]: r["bin"] / BINS for r in passed.groupBy("stratum").agg(F.max("bin").alias("bin")).collect()}


def _base(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind as listed."""

    def named(i: int, kind: str):
        return lambda m: F.struct(m["s"].alias("s"), F.lit(i).alias("k"), m["e"].alias("e"), F.lit(kind).alias("kind"))

    each = [F.transform(find(text, p, g, n), named(i, k)) for i, (k, p, g, n) in enumerate(KINDS)]
    return F.transform(F.array_sort(F.concat(*each)), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["kind"].alias("kind")))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no span of ``base``; either are in one order by start, so neighbours tell."""
    places = F.concat(
        F.transform(tokens, lambda t, i: F.struct(t["s"].alias("s"), t["e"].alias("e"), i.alias("i"))),
        F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit(-1).alias("i"))),
    )
    far = F.lit(1 << 62)

    def told(every: Column) -> Column:
        # the furthest end of the fixed spans before each place, and the nearest start of those after it
        ends = F.transform(every, lambda x: F.when(x["i"] < 0, x["e"]).otherwise(0).cast("long"))
        starts = F.transform(F.reverse(every), lambda x: F.when(x["i"] < 0, x["s"].cast("long")).otherwise(far))
        near = F.struct(common.prefix(ends, F.lit(0).cast("long"), F.greatest).alias("before"), common.prefix(starts, far, F.least).alias("after"))
        free = lambda w: F.filter(every, lambda x, k: (x["i"] >= 0) & (F.get(w["before"], k) <= x["s"]) & (F.get(w["after"], F.size(every) - 1 - k) >= x["e"]))
        return common.let(near, free)

    kept = common.let(F.array_sort(places), told)
    return F.when(F.size(base) == 0, tokens).otherwise(F.transform(kept, lambda x: F.get(tokens, x["i"])))


def _tokens(text: Column, base: Column) -> Column:
    """(s, e, token) of the long tokens that no fixed pattern covers, in whole or in part."""
    return common.let(F.struct(find(text, TOKEN, 0, 20).alias("t"), base.alias("b")), lambda x: _apart(x["t"], x["b"]))


def _in_order(spans: Column) -> Column:
    """Fixed and added spans by start; added ones overlap no other, so fixed ones of one start stay in their order."""
    numbered = F.transform(spans, lambda m, i: F.struct(m["s"].alias("s"), i.alias("i"), m["e"].alias("e"), m["kind"].alias("kind")))
    return F.transform(F.array_sort(numbered), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["kind"].alias("kind")))


def random_tokens(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """The distinct tokens (column token) that the battery takes for secrets."""
    tested = common.stored(battery(tokens.select("token").distinct()), "secret-tests")
    passed = F.lit(False)
    for stratum, cut in discoveries(tested, rate).items():
        passed = passed | ((F.col("stratum") == stratum) & (F.col("log_p") <= cut))
    return tested.where(~F.col("rejected") & passed).select("token")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per input row: doc_id, base (spans of the fixed patterns), spans (those and the battery's).

    Spans are (s, e, kind), in code points, end exclusive, by s, then kind as
    listed; the battery's kind is "random", and its spans overlap no fixed one. A
    null text is the empty one, and has no spans. Rows that repeat repeat, a null
    id stays null; other columns are not read; an empty table gives an empty
    result.
    """
    rows = common.text_rows(docs, id_col, text_col).withColumn("base", _base(F.col("text")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", _tokens(F.col("text"), F.col("base")).alias("tokens"))
    rows = common.stored(rows, "secret-spans")  # the row numbers are part of the table now
    each = rows.where(F.size("tokens") > 0).select("row", F.inline("tokens"))
    added = each.join(random_tokens(each, rate), "token").groupBy("row").agg(F.collect_list(F.struct("s", "e", F.lit("random").alias("kind"))).alias("added"))
    out = rows.select("row", "doc_id", "base").join(added, "row", "left")
    return out.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(_in_order(F.concat("base", "added"))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    counts = [F.size(F.array_remove(F.transform("base", lambda m: m["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _blanked(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` in place of what spans cover; spans that overlap share one."""

    def masked(x: Column) -> Column:
        def gaps(ends: Column) -> Column:
            # a span opens a gap if it begins no sooner than the furthest end before it
            opened = F.filter(F.transform(x["s"], lambda m, i: F.struct(F.get(ends, i).alias("at"), (m["s"] - F.get(ends, i)).alias("len"))), lambda g: g["len"] >= 0)
            last = F.struct(F.get(ends, F.size(x["s"])).alias("at"), (F.length(x["t"]) - F.get(ends, F.size(x["s"]))).alias("len"))
            return F.array_join(common.cut(x["t"], F.concat(opened, F.array(last))), mask)

        return common.let(common.prefix(F.transform(x["s"], lambda m: m["e"].cast("long")), F.lit(0).cast("long"), F.greatest), gaps)

    return F.when(F.size(spans) > 0, common.let(F.struct(text.alias("t"), spans.alias("s")), masked)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """All rows and columns of ``docs``, with ``mask`` in place of every span that ``scan`` finds.

    Rows without a long token are settled where they lie; only the few others
    meet the battery's finds, by their text's hash. Null texts stay null.
    """

    def blanked(docs: DataFrame, text_col: str) -> DataFrame:
        text = F.col(text_col)
        base = docs.withColumn("__base", F.when(text.isNull(), F.expr(f"cast(null as {SPANS})")).otherwise(_base(text)))
        tried = F.coalesce(F.regexp_like(text, F.lit(TOKEN)), F.lit(False))
        plain, open_ = base.where(~tried), base.where(tried).withColumn("__key", F.sha2(text.cast("binary"), 256))
        each = docs.where(tried).select(F.sha2(text.cast("binary"), 256).alias("__key"), text.alias("__text")).dropDuplicates(["__key"])
        each = common.stored(each.select("__key", F.inline(_tokens(F.col("__text"), _base(F.col("__text"))))), "secret-tokens")
        added = each.join(random_tokens(each, rate), "token").groupBy("__key").agg(F.collect_list(F.struct("s", "e", F.lit("random").alias("kind"))).alias("__added"))
        joined = open_.join(added, "__key", "left").withColumn("__base", F.when(F.col("__added").isNull(), F.col("__base")).otherwise(_in_order(F.concat("__base", "__added"))))
        both = plain.unionByName(joined.select(*plain.columns))
        return both.withColumn(text_col, F.when(text.isNull(), text).otherwise(_blanked(text, F.col("__base"), mask))).select(*docs.columns)

    return common.plainly(docs, blanked, text_col=text_col)
