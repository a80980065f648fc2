"""URL filters: fixed host and path rules, then association rules mined from labels.

Everything is DataFrame or SQL work. FP-growth mines the URL tokens (host
labels, path segments, parameter names) of labelled pages together with their
label; tokens that always come together are one item. Spark's FP-growth makes sets of any length, so that pages of
many frequent tokens would be beyond it; where there are such pages, PrefixSpan
grows the same sets (tokens in one order for all pages) up to the length of a rule.
Rules of at most ``LONGEST`` tokens that conclude the label with enough support and confidence, and that
no rule of fewer of their tokens makes needless, go to an inverted index by their
rarest token. A page meets only rules filed under one of its tokens, and the most
confident one that fits decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Items that stand for a page's label.
BAD, GOOD = "=bad", "=good"
#: A rule's least confidence, which is taken at the lower end of its 95 % interval, so that few pages prove nothing: a
#: rule needs 16 pages that agree, whatever the size of the table. Its most tokens; frequent tokens of a page from which on PrefixSpan mines.
CONFIDENCE, LONGEST, WIDE = 0.8, 4, 12
Z = 1.96
RULE = "antecedent array<string>, verdict string, confidence double, support long, anchor string"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return common.lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def fixed_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null where none does."""
    found = verdict = None
    for v, h, p in sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, h + p) if found is None else found.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return found, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, sorted; numbers count as one token."""
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    named = F.concat(
        F.transform(F.split(host, "[.]"), lambda t: F.concat(F.lit("h:"), plain(t))),
        F.transform(F.split(path, "[/]"), lambda t: F.concat(F.lit("p:"), plain(t))),
        F.transform(F.split(query, "[&]"), lambda t: F.concat(F.lit("q:"), plain(F.substring_index(t, "=", 1)))),
    )
    return F.array_sort(F.array_distinct(F.filter(named, lambda t: F.length(t) > 2)))


def _proved(confidence: Column, pages: Column) -> Column:
    """The lower end of a share's 95 % interval (Wilson's), of a share measured on so many pages."""
    z2 = Z * Z
    return (confidence + z2 / (2 * pages) - Z * F.sqrt(confidence * (1 - confidence) / pages + z2 / (4 * pages * pages))) / (1 + z2 / pages)


def _least(confidence: float) -> int:
    """Fewer pages than these prove no such confidence, whatever they say."""
    return math.ceil(Z * Z * confidence / (1 - confidence))


def _items(labelled: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(each, counts): (row, bad, token) of the tokens that ``least`` pages have, and (token, n).

    Tokens that always come together, on the same pages, stand as one: the first of
    them by name. They are proposed by a sum of their rows' hashes, and
    merged if each page with one of them has all.
    """
    each = labelled.select("row", "bad", F.explode("items").alias("token"))
    mark = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("mark")
    counts = common.stored(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), mark).where(F.col("n") >= least), "url-tokens")
    proposed = counts.groupBy("n", "mark").agg(F.min("token").alias("first"), F.count(F.lit(1)).alias("size"))
    named = counts.join(proposed.where("size > 1"), ["n", "mark"]).select("token", "first", "size")
    whole = each.join(named, "token").groupBy("row", "first").agg(F.count(F.lit(1)).alias("held"), F.first("size").alias("size")).groupBy("first").agg(F.min(F.col("held") == F.col("size")).alias("all"))
    spare = named.join(whole.where("all"), "first").where("token <> first").select("token")
    kept = counts.join(spare, "token", "left_anti").select("token", "n")
    return each, common.stored(kept, "url-items")


def _grown(baskets: DataFrame, least: int, longest: int, wide: int) -> DataFrame:
    """(items, freq) of the sets of at most ``longest`` tokens that ``least`` pages have, with and without a label."""
    from pyspark.ml.fpm import FPGrowth, PrefixSpan  # only here, as other queries' drivers can do without

    held, most = baskets.agg(F.count(F.lit(1)), F.max(F.size("items"))).first()
    share = (least - 0.5) / held  # of which both make the next whole number of pages
    if most <= wide + 1:
        sets = FPGrowth(itemsCol="items", minSupport=share).fit(baskets).freqItemsets
    else:
        span = PrefixSpan(minSupport=share, maxPatternLength=longest + 1, sequenceCol="steps")
        found = span.findFrequentSequentialPatterns(baskets.select(F.transform("items", lambda x: F.array(x)).alias("steps")))
        sets = found.select(F.flatten("sequence").alias("items"), "freq")
    return sets.where(F.size(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD)))) <= longest)


def mine(labelled: DataFrame, confidence: float = CONFIDENCE, longest: int = LONGEST, least: int | None = None, wide: int = WIDE) -> DataFrame:
    """(antecedent, verdict, confidence, support, anchor) of the rules that conclude a label; support is a number of pages.

    ``labelled`` has items (array of distinct tokens) and bad (boolean). A rule has at
    most ``longest`` tokens, and ``least`` pages that have them and its label (by
    default as many as can prove ``confidence``). All frequent tokens of a page are mined. Confidence is the
    lower end of its 95 % interval. A rule is pruned if one of the same verdict
    with fewer tokens, all of them its own, is as confident. The anchor is the
    token that the fewest labelled pages have, the first by name on ties.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], RULE)
    labelled = common.stored(labelled.select(F.monotonically_increasing_id().alias("row"), "items", "bad"), "url-labels")
    least = _least(confidence) if least is None else least
    each, counts = _items(labelled, least)
    label = F.when(F.col("bad"), BAD).otherwise(GOOD)
    kept = each.join(counts, "token").groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    baskets = common.stored(kept.select(F.concat(F.transform("t", lambda x: x["token"]), F.array(label)).alias("items")), "url-baskets")
    if baskets.isEmpty():
        return empty
    sets = common.stored(_grown(baskets, least, longest, wide).select(F.array_sort(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD)))).alias("antecedent"), F.array_contains("items", BAD).alias("bad"), F.array_contains("items", GOOD).alias("good"), "freq"), "url-sets")
    sets = sets.where(F.size("antecedent") > 0)
    told = sets.where("bad or good").select("antecedent", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"), F.col("freq").alias("support"))
    share = F.col("support") / F.col("freq")
    rules = told.join(sets.where("not bad and not good").select("antecedent", "freq"), "antecedent").select("antecedent", "verdict", _proved(share, F.col("freq").cast("double")).alias("confidence"), "support")
    rules = common.stored(rules.where(F.col("confidence") >= confidence), "url-rules")
    rare = Window.partitionBy("antecedent", "verdict").orderBy("n", "token")
    filed = rules.withColumn("token", F.explode("antecedent")).join(counts, "token").withColumn("k", F.row_number().over(rare)).where("k = 1")
    filed = common.stored(filed.select("antecedent", "verdict", "confidence", "support", F.col("token").alias("anchor")), "url-index")
    # a rule's shorter ones, of which there are fewer than 2 ** longest
    shorter = filed.select(F.col("antecedent").alias("long"), "verdict", F.col("confidence").alias("own"), F.explode(_parts_of(F.col("antecedent"), longest)).alias("antecedent"))
    needless = shorter.join(filed.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"]).where(F.col("confidence") >= F.col("own")).select(F.col("long").alias("antecedent"), "verdict").distinct()
    return common.stored(filed.join(needless, ["antecedent", "verdict"], "left_anti"), "url-index")


def _parts_of(tokens: Column, longest: int) -> Column:
    """All proper parts of an array of at most ``longest`` tokens, in its order."""
    masks = F.sequence(F.lit(1), F.expr(f"cast(shiftleft(1, least(size(antecedent), {longest})) - 2 as int)"))
    part = lambda m: F.filter(tokens, lambda x, i: m.bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0)
    return F.when(F.size(tokens) > 1, F.transform(masks, part)).otherwise(F.expr("cast(array() as array<array<string>>)"))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, best) of the pages (row, items) that a rule fits: the most confident one, then of more tokens, then by name.

    Spark broadcasts the index where its size allows. Otherwise pages and rules
    meet by anchor, a rule's rarest token, and adaptive execution splits what a
    token has too much of; a page's finds meet by its row.
    """
    met = pages.select("row", "items", F.explode("items").alias("anchor")).join(rules, "anchor").where(F.size(F.array_except("antecedent", "items")) == 0)
    order = F.struct("confidence", F.size("antecedent").alias("size"), F.array_join("antecedent", " ").alias("rule"), "verdict")
    return met.select("row", order.alias("best")).groupBy("row").agg(F.max("best").alias("best"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(items, bad) of the pages (page_id, fixed, items) whose label is known: a fixed rule's verdict, else that of ``labels``.

    A label of an id that repeats is bad if one of them is.
    """
    bad = (F.coalesce(labels["toxic"] == 1, F.lit(False)) | F.coalesce(labels["quality"] == 0, F.lit(False))).alias("bad")
    marks = labels.select(labels["doc_id"].cast("long").alias("page"), bad).groupBy("page").agg(F.max("bad").alias("bad"))
    ruled = pages.where("fixed is not null").select("items", (F.col("fixed") == "block").alias("bad"))
    told = pages.where("fixed is null").join(marks, pages["page_id"].cast("long") == marks["page"]).select("items", "bad")
    return ruled.unionByName(told)


def judge(pages: DataFrame, labels: DataFrame, url_col: str = "url", id_col: str = "page_id", confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (the association rule that decided, its tokens spaced; else null).

    A fixed rule decides where one fits, the longest first; else the most
    confident mined rule that fits; all other pages are allowed. Mining learns
    from the pages that fixed rules judge (blocked ones are bad) and from
    ``labels`` (doc_id, quality, toxic), which label other pages of that id: bad
    is toxic or of quality 0, and a null label value counts as not bad. A page
    without a label teaches nothing, nor does a label without a page. A null url,
    or one without ``://``, has empty parts and no tokens, and is allowed.
    Repeated rows repeat and teach each by itself; other columns are not read;
    empty tables give an empty result or no mined rules.
    """
    host, path = parts(pages[url_col])
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    base = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    base = common.stored(base.withColumn("row", F.monotonically_increasing_id()), "url-pages")  # the row numbers are part of the table now
    rules = mine(labelled_pages(base, labels), confidence, longest)
    hits = matched(base.where("rule is null").select("row", "items"), rules)
    out = base.join(hits, "row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "best.verdict", F.lit("allow")).alias("verdict"), F.col("best.rule").alias("mined"))
