"""URL filtering by association rules.  DataFrame operations only.

Spark's FP-growth mines combinations of URL tokens from labelled URLs; rules kept by support and confidence are
matched through an inverted index from their rarest token.  A list of (host, path) rules comes first.

Tokens that occur in the same labelled URLs are one item for the miner, and tokens that settle a verdict by themselves take part in no combination, as every
rule with them would be pruned.  Both leave the rules as they are and keep a slug of many words from doubling the combinations with each word.
FP-growth, which takes every frequent combination, gets the most frequent items of a URL; a search that leaves out what can't become a rule takes every combination with another
item.  Together they give every rule.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut, drop

#: The list's rules as (verdict, host, path).
LIST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rows whose verdict the miner learns from, at most (expected); chosen by hash over the whole table.
TRAINING_URLS = 20_000
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
MIN_GAIN = 0.01
#: Most frequent items of a URL that FP-growth combines; combinations with an item that is beyond these in some labelled URL are searched by with_others. The rules don't depend on it.
COMBINED = 10
#: Rules that may be sent to every task, and characters of their tokens.
FEW_RULES, FEW_CHARS = 10_000, 2_000_000
#: Sets of one size that are all grown, without finding those that can lead to no rule.
FEW_SETS = 1_000
#: An item is the tokens that occur together, any of which stands for it.
RULES = "rule_id long, items array<array<string>>, mined string, confidence double, support double, n_items int, probe array<string>"


def url_parts(df: DataFrame) -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty for a null url or one without '://'."""
    host = F.translate(F.coalesce(F.regexp_extract("url", _URL, 1), F.lit("")), _UPPER, _LOWER)
    return df.withColumn("host", host).withColumn("path", F.coalesce(F.regexp_extract("url", _URL, 2), F.lit("")))


def list_rule(rules=LIST_RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest fitting rule of the list, null where none fits; of equal length, the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens() -> F.Column:
    """Distinct tokens of a URL: host labels, words inside labels, and words of the path."""
    labels = F.split("host", r"\.")
    words = F.split("host", r"[.\-_]")
    path = F.split("path", r"[/.\-_]+")
    part = lambda mark, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(F.concat(part("host:", labels), part("word:", words), part("path:", path)))


def contained(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """sets (with tokens) joined with every rule of whose every item they have a token; once for each token of the rule's rarest item.

    The inverted index: a rule is listed under the tokens of its rarest item alone, so a set looks up few rules, and the rest of the rule is
    compared in place. Rules are broadcast only while they are few.
    """
    chars = F.sum(F.aggregate(F.flatten("items"), F.lit(0), lambda n, x: n + F.length(x)))
    n, size = rules.agg(F.count("*"), F.coalesce(chars, F.lit(0))).first()
    listed = rules.withColumn("probe", F.explode("probe"))
    hit = sets.select("*", F.explode("tokens").alias("probe")).join(F.broadcast(listed) if n <= FEW_RULES and size <= FEW_CHARS else listed, "probe")
    return hit.where(F.forall("items", lambda item: F.arrays_overlap(item, "tokens")))


def _items(labelled: DataFrame, least: int) -> DataFrame:
    """(item, tokens, freq, mined, sure) of labelled (url, tokens, verdict): the tokens of at least so many URLs, those of the same URLs as one item, with its most frequent verdict.

    Sets of URLs are told apart by their number and two sums of independent 64-bit hashes.
    """
    each = labelled.select(F.xxhash64("url").alias("u1"), F.xxhash64(F.lit(29), "url").alias("u2"), "verdict", F.explode("tokens").alias("token"))
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    by = each.groupBy("token", "verdict").agg(F.count("*").alias("n"), total("u1"), total("u2"))
    top = F.max(F.struct("n", "verdict")).alias("top")
    by = by.groupBy("token").agg(F.sum("n").alias("freq"), F.sum("u1").alias("u1"), F.sum("u2").alias("u2"), top).where(F.col("freq") >= least)
    same = by.groupBy("freq", "u1", "u2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"), F.first("top").alias("top"))
    return same.select("item", "tokens", "freq", F.col("top.verdict").alias("mined"), F.col("top.n").alias("sure"))


def _with_counts(level: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of level (p, last, verdict, word, b) of the sets of live (p, last, verdict, n, f), with n and f; both null for a verdict that live lacks."""
    by = live.groupBy("p", "last").agg(F.map_from_entries(F.collect_list(F.struct("verdict", F.struct("n", "f")))).alias("by"))
    return level.join(by, ["p", "last"]).withColumn("by", F.col("by")[F.col("verdict")]).select("p", "last", "verdict", "word", "b", "by.n", "by.f")


def _promising(level: DataFrame, grown: DataFrame, min_confidence: float) -> DataFrame:
    """Rows of grown (p, last, verdict, n, f) but those from which no set can grow that has the confidence.

    Any such set keeps the URLs of other verdicts that have all later items of its siblings, and gains none of its verdict.
    """
    of, both = ["p", "last"], ["p", "last", "verdict"]
    nodes = grown.select(*of).distinct().withColumn("rank", F.count("*").over(Window.partitionBy("p").orderBy(F.desc("last"))))
    later = Window.partitionBy("p", "verdict", "word").orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, 0)
    left = level.select(*both, "word", "b").join(nodes, of).withColumns({"all": F.bit_and("b").over(later), "k": F.count("*").over(later)}).where("k = rank and rank > 1")
    left = cut(left.groupBy(*both).agg(F.sum(F.bit_count("all")).alias("h")))
    bound = grown.join(left.groupBy(*of).agg(F.sum("h").alias("hs")), of, "left").join(left, both, "left")
    others = F.coalesce("hs", F.lit(0)) - F.coalesce("h", F.lit(0))
    return bound.where(F.col("n") / (F.col("n") + others) >= min_confidence).select(*both, "n", "f")


def with_others(held: DataFrame, items: DataFrame, over: DataFrame, least: int, n: int, min_confidence: float, min_gain: float) -> DataFrame:
    """Rules (names, mined, confidence, support) with an item of over, from held (no, verdict, held) and items (item, freq); n URLs are labelled.

    Every set with an item of over is grown item by item, from over to the others and from rare to frequent, out of two sets that differ in their last item; sets of one size are counted
    at once, by ands of bits that stand for 64 URLs each. For a verdict, a set is left out, with all that hold it, if it has too few such URLs, if one of its last
    two items turns away no URL of another verdict, or if it holds a set that settles the verdict; see _promising for sets that don't grow. All that is left out is no rule, or is pruned by a
    smaller rule, which also prunes what that one would. The number of sets is not bounded: many frequent tokens in any combination have many.
    """
    both = ["p", "last", "verdict"]
    confidence = F.col("n") / F.col("f")
    unsettled = confidence < max(min_confidence, 1.0 - min_gain)
    order = items.join(over.withColumn("o", F.lit(True)), "item", "left").orderBy(F.col("o").isNull(), "freq", "item")
    order = cut(order.select("item", F.coalesce("o", F.lit(False)).alias("o"), F.monotonically_increasing_id().alias("last")))
    bit = held.select("verdict", F.explode("held").alias("item"), F.expr("no div 64").alias("word"), F.expr("shiftleft(1L, cast(no % 64 as int))").alias("b"))
    level = bit.join(order, "item").groupBy("last", "verdict", "word").agg(F.bit_or("b").alias("b"))
    level = cut(level.select(F.array().cast("array<bigint>").alias("p"), "*"))
    counted = level.groupBy(*both).agg(F.sum(F.bit_count("b")).alias("n")).withColumn("f", F.sum("n").over(Window.partitionBy("p", "last")))
    counted = cut(counted.where(F.col("n") >= least).join(order.select("last", "o"), "last"))
    rules = [counted.where(F.col("o") & (confidence >= min_confidence)).select(*both, "n", "f")]
    grown = counted.where(unsettled).select(*both, "n", "f")
    level = _with_counts(level, grown)
    starts = level.join(order.where("o").select("last"), "last", "left_semi")
    while size := grown.count():
        # Few sets are all grown, as finding those that lead to no rule takes longer.
        if size > FEW_SETS:
            starts = _with_counts(starts.select(*both, "word", "b"), _promising(level, grown, min_confidence))
        x = starts.select("p", "verdict", "word", F.col("last").alias("x"), F.col("b").alias("bx"), F.col("n").alias("nx"), F.col("f").alias("fx"))
        y = level.select("p", "verdict", "word", F.col("last").alias("y"), F.col("b").alias("by"), F.col("n").alias("ny"), F.col("f").alias("fy"))
        pairs = x.join(y, ["p", "verdict", "word"]).where("x < y and bx & by <> 0").withColumn("b", F.expr("bx & by"))
        counts = [F.sum(F.bit_count("b")).alias("n"), *(F.max(c).alias(c) for c in ("nx", "fx", "ny", "fy"))]
        counted = pairs.groupBy("p", "x", "y", "verdict").agg(*counts).withColumn("f", F.sum("n").over(Window.partitionBy("p", "x", "y")))
        # Counts are null where x or y is left out for the verdict.
        counted = counted.where((F.col("n") >= least) & F.expr("fx - nx > f - n and fy - ny > f - n"))
        before = F.greatest(F.col("nx") / F.col("fx"), F.col("ny") / F.col("fy"))
        rule = (confidence >= min_confidence) & ((before < min_confidence) | (before < confidence))
        named = [F.array_append("p", F.col("x")).alias("p"), F.col("y").alias("last"), "verdict"]
        counted = cut(counted.select(*named, "n", "f", rule.alias("rule")))
        rules.append(counted.where("rule").select(*both, "n", "f"))
        grown = counted.where(unsettled).select(*both, "n", "f")
        read, level = level, cut(_with_counts(pairs.select(*named, "word", "b"), grown))
        starts = level
        drop(read)
    found = reduce(DataFrame.union, rules).withColumn("at", F.array_append("p", F.col("last")))
    found = found.select("at", "verdict", "n", "f", F.explode("at").alias("last")).join(order, "last")
    found = found.groupBy("at", "verdict", "n", "f").agg(F.array_sort(F.collect_list("item")).alias("names"))
    return found.select("names", F.col("verdict").alias("mined"), confidence.alias("confidence"), (F.col("n") / n).alias("support"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_gain: float = MIN_GAIN, combined: int = COMBINED) -> DataFrame:
    """Rules (rule_id, items, mined, confidence, support, n_items, probe) from (url, tokens, verdict); probe is the rarest of items.

    A rule is pruned if a part of its items gives the same verdict with a confidence of min_gain less or better. An item of tokens a and b stands for rules with a and
    rules with b. Combinations of any items and length are found, whatever combined is. Without two labelled rows there are no rules.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("url", "tokens", "verdict").dropDuplicates(["url", "verdict"])
    n = labelled.count()
    if n < 2:
        return spark.createDataFrame([], RULES)
    # At least two URLs must carry a combination, however few are labelled.
    least = max(2, math.ceil(min_support * n - 1e-9))
    items = cut(_items(labelled, least))
    confidence, sure = F.col("sure") / F.col("freq"), F.col("sure")
    # Sure of one verdict, and seen with others too seldom for a rule: every rule with such an item and another is pruned or lacks support.
    settled = (confidence >= max(min_confidence, 1.0 - min_gain)) & (sure >= least) & (F.col("freq") - sure < least)
    # The items of each URL, the most frequent first; no more are gathered than a URL has. A frequent item so fills no task while items are few.
    mixed = items.where(~settled).select("item", "freq")
    sizes = items.agg(F.count("*"), F.coalesce(F.sum(F.length("item")), F.lit(0))).first()
    mixed = F.broadcast(mixed) if sizes[0] <= FEW_RULES and sizes[1] <= FEW_CHARS else mixed
    held = labelled.select("url", "verdict", F.explode("tokens").alias("item")).join(mixed, "item")
    held = held.groupBy("url", "verdict").agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "item"))).alias("held"))
    held = cut(held.select("url", "verdict", F.transform("held", lambda x: x["item"]).alias("held"), F.monotonically_increasing_id().alias("no")))
    over = held.select(F.explode(F.slice("held", combined + 1, F.greatest(F.size("held") - combined, F.lit(0)))).alias("item")).distinct()
    own = items.where(settled).where((confidence >= min_confidence) & (sure >= least)).select(F.array("item").alias("names"), "mined", confidence.alias("confidence"), (sure / n).alias("support"))
    kept = held.select("url", "verdict", F.explode("held").alias("item")).join(over, "item", "left_anti").groupBy("url", "verdict").agg(F.collect_list("item").alias("kept"))
    baskets = labelled.select("url", "verdict").join(kept, ["url", "verdict"], "left")
    baskets = baskets.select(F.array_append(F.coalesce("kept", F.array().cast("array<string>")), F.concat(F.lit("verdict:"), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(baskets)
    verdict = F.col("consequent")[0]
    joint = model.associationRules.where(verdict.startswith("verdict:")).select(F.array_sort("antecedent").alias("names"), F.substring_index(verdict, ":", -1).alias("mined"), "confidence", "support")
    found = own.union(joint)
    if not over.isEmpty():
        found = found.union(with_others(held, mixed, over, least, n, min_confidence, min_gain))
    found = found.withColumn("rule_id", F.xxhash64("names", "mined"))
    item = F.sort_array(F.collect_list(F.struct("freq", "tokens")))
    spelt = found.select("rule_id", F.explode("names").alias("item")).join(items.select("item", "freq", "tokens"), "item").groupBy("rule_id").agg(item.alias("spelt"))
    rules = found.join(spelt, "rule_id").withColumns({"items": F.transform("spelt", lambda x: x["tokens"]), "n_items": F.size("spelt"), "probe": F.col("spelt")[0]["tokens"]})
    rules = cut(rules.select(*[c.split()[0] for c in RULES.split(", ")]))
    outer = rules.select(F.col("rule_id").alias("o_"), F.transform("items", lambda x: x[0]).alias("tokens"), F.col("mined").alias("m_"), F.col("confidence").alias("c_"), F.col("n_items").alias("k_"))
    pruned = contained(outer, rules).where((F.col("mined") == F.col("m_")) & (F.col("n_items") < F.col("k_")) & (F.col("confidence") >= F.col("c_") - min_gain))
    return cut(rules.join(pruned.select(F.col("o_").alias("rule_id")).distinct(), "rule_id", "left_anti"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, confidence): the verdict of the surest mined rule of whose every item the URL has a token.  urls: distinct (url, tokens).

    Of equal confidence: larger support, more tokens, 'block', then the rule's number.
    """
    best = F.max(F.struct("confidence", "support", "n_items", (F.col("mined") == "block").alias("b"), "rule_id", "mined")).alias("best")
    return contained(urls, rules).groupBy("url").agg(best).select("url", F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame | None = None, training_urls: int = TRAINING_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row of pages (page_id, url); other columns are not read.

    The list's rule decides where one fits; the surest mined rule does elsewhere; 'allow' where no rule matches. Labels
    default to the URLs that the list decides, a bounded sample of training_urls chosen by hash. Verdicts are
    found once per distinct URL and joined back; of a URL that fills the table adaptive execution splits the pages. A null or malformed url has empty
    host and path, no rule, and is allowed; repeated rows get equal verdicts; an empty table gives no rows.
    """
    base = url_parts(pages.select("page_id", "url"))
    rule, verdict = list_rule()
    base = base.withColumn("rule", rule).withColumn("listed", verdict)
    distinct = base.where("url is not null").select("url", "host", "path", "listed").distinct().withColumn("tokens", tokens())
    if labelled is None:
        labelled = distinct.where("listed is not null").select("url", "tokens", F.col("listed").alias("verdict"))
        n = max(1, labelled.count())
        keep = F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(min(1.0, training_urls / n) * 1_000_000)
        labelled = labelled.where(keep)
    rules = mine_rules(labelled)
    mined = match_rules(distinct.where("listed is null").select("url", "tokens"), rules)
    out = base.join(mined, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence"))


def listed_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule of every row of pages (page_id, url): what judge() takes from the URL and the list alone."""
    return url_parts(pages.select("page_id", "url")).select("page_id", "host", "path", list_rule()[0].alias("rule"))


def _oracle() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(LIST_RULES, key=lambda r: -len(r[1] + r[2]))]
    return f"""
WITH found AS (SELECT page_id, url, strpos(url, '://') AS k FROM pages),
rest AS (SELECT page_id, CASE WHEN k > 0 THEN split_part(split_part(substr(url, k + 3), '#', 1), '?', 1) ELSE '' END AS r FROM found),
parts AS (SELECT page_id, translate(split_part(r, '/', 1), '{_UPPER}', '{_LOWER}') AS host, CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM rest)
SELECT page_id, host, path, CASE {" ".join(fits)} END AS rule FROM parts
"""


#: Of listed_parts.
ORACLE = _oracle()
