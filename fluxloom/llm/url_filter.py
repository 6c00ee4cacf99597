"""URL filtering by association rules.

Fixed rules name a host with its subdomains and the beginning of a path; the longest that
fits decides. For other urls FP-growth mines combinations of url tokens (labels of the host,
segments of the path, keys of the query) from labelled urls; combinations that lead to the
label `block` with enough support and confidence are rules too, matched by an inverted index:
each token of a url looks up the rules of which it is the rarest, and a rule fits if the url
holds all its tokens.

Only DataFrame and SQL functions are used. Different urls are matched once each.

Defined results: a null url or one without :// has an empty host and path, no tokens and no
rule, and is allowed; repeated rows each get a row; several labels of one id block if any
does; without labels nothing but the fixed rules blocks; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import guarded, materialize, restored

#: The least share and number of labelled urls of a combination, the least confidence, and the
#: most tokens of a combination.
SUPPORT, ROWS, CONFIDENCE, TOKENS = 0.001, 5, 0.5, 3
#: Tokens of a basket that FP-growth is given at most.
WIDE = 15


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The string and verdict of the longest of rules (verdict, host/path) that fits, or null."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Labels of the host, segments of the path and keys of the query, each kind marked."""
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("p:"), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    return F.array_distinct(F.filter(F.concat(labels, segments, keys), lambda x: F.length(x) > 2))


def _combinations(bad: DataFrame, least: int, most: int) -> DataFrame:
    """Sets of 2 to `most` tokens that `least` urls (id, items) hold at least, by FP-growth, and
    how many do: rule, bad.

    A url of many frequent tokens has far more sets than are asked for. So tokens are dealt to as
    many groups that `most` groups hold WIDE tokens of a url at most; a url gives a basket for
    each choice of up to `most` groups, marked by it, in which only sets that meet just these
    groups count. With one group (the usual case) that is a single basket."""
    widest = bad.agg(F.max(F.size("items"))).first()[0] or 0
    groups = 1 if widest <= WIDE else -(-most * widest // WIDE)
    while groups > 1 and (bad.agg(F.max(_fullest("items", groups))).first()[0] or 0) * most > WIDE and groups < 4 * widest:
        groups *= 2
    if groups == 1:
        baskets = bad.select(F.transform("items", lambda x: F.struct(F.lit("").alias("mark"), x.alias("token"))).alias("items"))
    else:
        rows = bad.withColumn("own", F.array_sort(F.array_distinct(F.transform("items", lambda x: _group(x, groups)))))
        chosen = F.transform("own", lambda g: F.array(g))
        for _ in range(most - 1):
            longer = F.flatten(F.transform(chosen, lambda c: F.transform(F.filter("own", lambda g: g > F.element_at(c, -1)), lambda g: F.concat(c, F.array(g)))))
            chosen = F.array_distinct(F.concat(chosen, longer))
        rows = rows.select("items", F.explode(chosen).alias("chosen"))
        inside = F.filter("items", lambda x: F.array_contains("chosen", _group(x, groups)))
        mark = F.array_join(F.transform("chosen", lambda g: g.cast("string")), "+")
        baskets = rows.select(F.transform(inside, lambda x: F.struct(mark.alias("mark"), x.alias("token"))).alias("items"))
    n = baskets.count()
    named = baskets.select(F.transform("items", lambda x: F.concat(x["mark"], F.lit(" "), x["token"])).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(named).freqItemsets if n else None
    if found is None:
        return bad.select(F.col("items").alias("rule"), F.lit(0).cast("long").alias("bad")).limit(0)
    found = found.where(F.size("items").between(2, most)).select(F.col("freq").alias("bad"), F.substring_index(F.col("items")[0], " ", 1).alias("mark"), F.array_sort(F.transform("items", lambda x: F.regexp_replace(x, "^[0-9+]* ", ""))).alias("rule"))
    if groups > 1:
        met = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("rule", lambda x: _group(x, groups)))), lambda g: g.cast("string")), "+")
        found = found.where(met == F.col("mark"))
    return found.select("rule", "bad")


def _group(token: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(groups)).cast("int")


def _fullest(items: str, groups: int) -> Column:
    """The most tokens of a url that are in one group."""
    own = F.transform(items, lambda x: _group(x, groups))
    return F.array_max(F.transform(own, lambda g: F.size(F.filter(own, lambda h: h == g))))


def classes(labelled: DataFrame, single: DataFrame) -> DataFrame:
    """Rows (token, n, name, members) of the tokens of `single` that stand in just the same labelled urls:
    in counts they are one token, which `name`, the least of them, stands for. Sets of urls are compared
    by their number and 128 bits of their ids' hashes."""
    urls = labelled.withColumn("id", F.monotonically_increasing_id()).select("id", F.explode("items").alias("token")).join(single.select("token", "n"), "token")
    same = urls.groupBy("token", "n").agg(F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("b"))
    groups = same.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select("n", F.col("members")[0].alias("name"), "members").withColumn("token", F.explode("members"))


def mine(labelled: DataFrame, support: float = SUPPORT, rows: int = ROWS, confidence: float = CONFIDENCE, most: int = TOKENS) -> DataFrame:
    """Rules (rule, token) from rows (url, block). A rule is a list of classes of tokens, of each of which
    a url must hold one; token is one of the rarest class, under which the inverted index has the rule.

    Tokens that block by themselves need no company, so FP-growth works on the blocked urls'
    other tokens, of those that enough of them hold; a set that holds such a token fits only
    where the token alone does. Tokens that all the same urls hold, such as the segments of one deep
    path, go through it as one. How many other labelled urls hold a set is counted by the index."""
    labelled = materialize(labelled.select("block", tokens(F.col("url")).alias("items")).where("size(items) > 0"))
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "rule array<array<string>>, token string")
    least = max(rows, math.ceil(support * n))
    single = labelled.select("block", F.explode("items").alias("token")).groupBy("token").agg(F.sum(F.col("block").cast("long")).alias("bad"), F.count("*").alias("n"))
    single = materialize(single.where(F.col("bad") >= least).withColumn("alone", F.col("bad") >= confidence * F.col("n")))
    rules = single.where("alone").select(F.array(F.array("token")).alias("rule"), "token")
    others = single.where("NOT alone").select("token", "n")
    if most == 1 or others.isEmpty():
        return rules
    others = materialize(classes(labelled, others))
    bad = labelled.where("block").withColumn("id", F.monotonically_increasing_id()).select("id", F.explode("items").alias("token")).join(others.where("token = name").select("token"), "token")
    bad = bad.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("items")).where("size(items) > 1").select("items")
    sets = _combinations(materialize(bad), least, most).withColumn("set", F.monotonically_increasing_id())
    order = sets.select("set", "bad", F.explode("rule").alias("token")).join(others, "token")
    key = F.struct("n", "token", "members")
    sets = materialize(order.groupBy("set").agg(F.first("bad").alias("bad"), F.array_sort(F.collect_list("members")).alias("rule"), F.min(key).alias("rarest")))
    # The tokens of a class stand in the same labelled urls, so there one of them finds all.
    good = held(labelled.where("NOT block").select("items"), sets.withColumn("token", F.col("rarest.token"))).groupBy("set").agg(F.count("*").alias("good"))
    sets = sets.join(good, "set", "left").where(F.col("bad") >= confidence * (F.col("bad") + F.coalesce("good", F.lit(0))))
    return rules.unionByName(sets.select("rule", F.explode("rarest.members").alias("token")))


def held(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (items, ...) with each of the rules (rule, token) of whose classes they all hold a token."""
    found = rows.withColumn("token", F.explode("items")).join(rules, "token")
    return found.where(F.forall("rule", lambda c: F.arrays_overlap(c, F.col("items"))))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The different urls (column url) that some rule fits."""
    words = urls.select("url").distinct().select("url", tokens(F.col("url")).alias("items"))
    return held(words, rules).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", id_col: str = "page_id", **options) -> DataFrame:
    """All columns of pages with _host, _path, _rule and _verdict."""
    pages, names = guarded(pages)
    u = F.col(names[url])
    bad = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg((F.min("quality") == 0).alias("block"))
    labelled = pages.select(F.col(names[id_col]).alias("id"), u.alias("url")).join(bad, F.col("id") == F.col("_id")).select("url", "block")
    hits = matched(pages.select(u.alias("url")), materialize(mine(labelled, **options))).select(F.col("url").alias("_hit"))
    pages = pages.withColumn("_host", host(u)).withColumn("_path", path(u))
    rule, verdict = longest_rule(F.col("_host"), F.col("_path"), rules)
    pages = pages.join(hits, u == F.col("_hit"), "left").withColumn("_rule", rule)
    learned = F.when(F.col("_hit").isNotNull(), "block").otherwise("allow")
    pages = pages.withColumn("_verdict", F.coalesce(verdict, learned))
    return restored(pages, names, _host="_host", _path="_path", _rule="_rule", _verdict="_verdict")
