"""URL filter by association rules.

URLs that a host-and-path rule decides are the labelled ones: each becomes a transaction of its
tokens (host parts, host suffix, path parts, query names; numbers are one token) and its
verdict. Tokens that occur in the same labelled URLs are one item, since any of them stands for all;
a transaction has all its items. Item combinations are mined level by level; those that imply a
verdict with enough support and confidence are kept, unless a part of the combination implies the
same at no less confidence. That pruning decides which combinations grow at all: one whose rows
have one verdict only, or whose rows are those of a part of it, is in no further rule. So a URL
with very many parts that tell the same is mined in a step, and no item is left out.
The other URLs get the verdict of the best rule of which they hold all items, by any token of each:
an inverted index from token to item to rule counts the items met. URLs are reduced to the items
that occur in a rule first, so a host with any number of pages is matched once per item set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.common import at_most, written

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SUPPORT = 0.005
LEAST = 2              # labelled URLs that support a rule at least, however few there are
CONFIDENCE = 0.8
DEFAULT = "allow"
_VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "(?s)^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "(?s)^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (verdict, rule), null for none. A rule fits its host and the
    hosts below it if the path starts with the rule's. ``rules`` is a list the caller gives."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(by_length):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL (empty for an empty host and path)."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    parts = F.filter(F.split(path, "[/.]"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)\\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")

    def tag(prefix, values):
        return F.transform(values, lambda x: F.concat(F.lit(prefix), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))

    return F.array_distinct(F.concat(tag("h:", labels), tag("d:", F.filter(F.array(suffix), lambda x: x != "")),
                                     tag("p:", parts), tag("q:", names)))


def items_of(labelled: DataFrame) -> DataFrame:
    """(token, item) from (items, verdict): the item is the least of the tokens that occur in the same
    rows, by the sum of two hashes of them; one row a token, with its ``count`` and ``sure``, the
    greater share of a verdict among its rows."""
    kinds = labelled.groupBy("items", "verdict").agg(F.count("*").alias("n"))
    marks = [F.xxhash64("items", "verdict", F.lit(k)).cast("decimal(38,0)") for k in (1, 2)]
    of = kinds.select(F.explode("items").alias("token"), "n", "verdict", *[m.alias(f"m{k}") for k, m in enumerate(marks)])
    tokens = of.groupBy("token").agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1"), F.sum("n").alias("count"),
                                     F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("good"))
    same = tokens.groupBy("m0", "m1", "count").agg(F.min("token").alias("item"))
    share = F.col("good") / F.col("count")
    return tokens.join(same, ["m0", "m1", "count"]).select("token", "item", "count", F.greatest(share, 1 - share).alias("sure"))


def transactions(labelled: DataFrame, items: DataFrame) -> DataFrame:
    """(items, verdict, n): the rows with tokens replaced by their items, all of them, and how many
    rows there are of each."""
    kinds = written(labelled.groupBy("items", "verdict").agg(F.count("*").alias("n"))
                    .withColumn("kind", F.xxhash64("items", "verdict")), "url-kinds")
    told = kinds.select("kind", F.explode("items").alias("token")).join(items, "token")
    sets = told.groupBy("kind").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return kinds.select("kind", "verdict", "n").join(sets, "kind").groupBy("items", "verdict").agg(F.sum("n").alias("n"))


def mine(deals: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule_id, items, verdict, confidence, support) from (items, verdict, n), items sorted: the rules
    whose consequent is a verdict, held by at least ``least`` rows, that no rule on a part of their
    items matches at no less confidence. Empty without rows.

    A level extends the sets of the one before by an item behind their last. Only live sets are
    extended: rows enough for a rule, both verdicts among them (a rule on more items than those of
    a pure set is redundant or says the contrary of all its rows) and fewer rows than any part (a
    rule on a set with the rows of its part is redundant). Parts of a set that a rule may need are
    live, so that a set counts only if all its parts of one item less are. At most a bounded number of
    items reach ``support``, so the sets don't grow with the corpus."""
    rows = deals.agg(F.sum("n")).first()[0] or 1
    need = max(1, math.ceil(min(1.0, max(support, (least - 0.5) / rows)) * rows))
    counts = [F.sum("n").alias("count"), *[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in _VERDICTS]]
    enough = F.greatest(*_VERDICTS) >= need

    def judged(sets: DataFrame) -> DataFrame:
        """With the confidence of the set's own rules and, as best, with those of its parts."""
        own = {f"own_{v}": F.when((F.col(v) >= need) & (F.col(v) / F.col("count") >= confidence), F.col(v) / F.col("count"))
               .otherwise(0.0) for v in _VERDICTS}
        return sets.withColumns(own).withColumns({f"best_{v}": F.greatest(f"own_{v}", f"part_{v}") for v in _VERDICTS})

    single = deals.select("verdict", "n", F.explode("items").alias("item")).groupBy("item").agg(*counts).filter(enough)
    level = written(judged(single.select(F.array("item").alias("set"), "count", *_VERDICTS,
                                         *[F.lit(0.0).alias(f"part_{v}") for v in _VERDICTS])), "rules")
    levels, mixed = [level], F.least(*_VERDICTS) > 0
    live = level.filter(mixed)
    # what is left of a row: its live items, those behind the last of the set it is held for
    told = written(deals.withColumn("at", F.monotonically_increasing_id()), "url-deals")
    left = told.select("at", "verdict", "n", F.explode("items").alias("item")).join(
        at_most(live.select(F.get("set", F.lit(0)).alias("item"))), "item")
    left = left.groupBy("at", "verdict", "n").agg(F.sort_array(F.collect_list("item")).alias("rest"))
    size = 1
    held = left.groupBy("rest", "verdict").agg(F.sum("n").alias("n")).select(
        "verdict", "n", "rest", F.posexplode("rest").alias("i", "item")).select(
        F.array("item").alias("set"), F.expr("slice(rest, i + 2, size(rest))").alias("rest"), "verdict", "n")
    while live.limit(1).count():
        size += 1
        kept = held.filter("size(rest) > 0").join(at_most(live.select("set")), "set")
        held = written(kept.select("set", "verdict", "n", "rest", F.posexplode("rest").alias("i", "item")).select(
            F.concat("set", F.array("item")).alias("set"), F.expr("slice(rest, i + 2, size(rest))").alias("rest"), "verdict", "n")
            .groupBy("set", "rest", "verdict").agg(F.sum("n").alias("n")), "url-held")
        sets = held.groupBy("set").agg(*counts).filter(enough)
        part = F.explode(F.transform(F.sequence(F.lit(0), F.size("set") - 1), lambda i: F.filter("set", lambda x, k: k != i)))
        known = live.select(F.col("set").alias("part"), F.col("count").alias("whole"), *[f"best_{v}" for v in _VERDICTS])
        new = (sets.select("set", "count", *_VERDICTS, part.alias("part")).join(at_most(known), "part")
               .groupBy("set", "count", *_VERDICTS)
               .agg(F.count("*").alias("parts"), F.min("whole").alias("whole"), *[F.max(f"best_{v}").alias(f"part_{v}") for v in _VERDICTS])
               .filter((F.col("parts") == size) & (F.col("count") < F.col("whole"))).drop("parts", "whole"))
        level = written(judged(new), "rules")
        levels.append(level)
        live = level.filter(mixed)
    found = None
    for level in levels:
        for v in _VERDICTS:
            rules = level.filter(F.col(f"own_{v}") > F.col(f"part_{v}")).select(
                F.xxhash64("set", F.lit(v)).alias("rule_id"), F.col("set").alias("items"), F.lit(v).alias("verdict"),
                F.col(f"own_{v}").alias("confidence"), (F.col(v) / F.lit(rows)).alias("support"))
            found = rules if found is None else found.unionByName(rules)
    return written(found, "rules")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id",
          support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """(id_col, host, path, rule, verdict, by) for each row of ``pages`` (column url).

    ``rule`` is the longest fitting rule or null; ``verdict`` is its, else that of the mined rule
    with the greatest confidence (then support, then more items) of which the URL holds all tokens,
    else ``default``; ``by`` says which (rule, mined, default). Null URLs and URLs without :// have
    an empty host and path, fit no rule and hold no token. Repeated rows are answered each; extra
    columns are not read; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    base = pages.select(F.col(id_col).alias("id"), "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules)).withColumn(
        "items", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
            tokens(F.col("host"), F.col("path"), F.col("url"))))
    seen = written(base.select("id", "host", "path", "hit", "items"), "urls")
    labelled = seen.filter("hit is not null").select("items", F.col("hit.verdict").alias("verdict"))
    mined = None
    if labelled.limit(1).count():
        items = written(items_of(labelled), "url-items")
        mined = mine(written(transactions(labelled, items), "url-deals"), support, confidence)
        # tokens of the items in rules: bounded by the support, as the rules are
        used = items.join(mined.select(F.explode("items").alias("item")).distinct(), "item").select("token", "item").collect()
        names = F.create_map(*[F.lit(x) for r in used for x in (r["token"], r["item"])]) if used else None
        seen = seen.withColumn("items", F.sort_array(F.array_distinct(F.array_compact(
            F.transform("items", lambda t: F.try_element_at(names, t))))) if used else F.array().cast("array<string>"))
    if mined is not None:
        sets = seen.filter("hit is null and size(items) > 0").select("items").distinct()
        index = mined.select("rule_id", "verdict", "confidence", "support", F.size("items").alias("size"),
                             F.explode("items").alias("item"))
        best = Window.partitionBy("items").orderBy(F.desc("confidence"), F.desc("support"), F.desc("size"), "verdict", "rule_id")
        met = (sets.withColumn("item", F.explode("items")).join(index, "item")
               .groupBy("items", "rule_id", "verdict", "confidence", "support", "size").agg(F.count("*").alias("met"))
               .filter("met = size").withColumn("place", F.row_number().over(best)).filter("place = 1")
               .select("items", F.col("verdict").alias("mined")))
        seen = seen.join(met, "items", "left")
    else:
        seen = seen.withColumn("mined", F.lit(None).cast("string"))
    mined_col = F.when(F.col("hit").isNull(), F.col("mined"))
    return seen.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
                       F.coalesce("hit.verdict", mined_col, F.lit(default)).alias("verdict"),
                       F.when(F.col("hit").isNotNull(), "rule").when(mined_col.isNotNull(), "mined").otherwise("default").alias("by"))
