"""URL filters: fixed host rules, and association rules mined from labelled URLs by FP-growth.

A URL becomes a set of tokens: host labels, registered-looking host tails, path segments with digits folded.
A rule is a set of at most ``MOST_ITEMS`` tokens that at least ``MIN_COUNT`` and a share of ``MIN_SUPPORT``
of the labelled URLs hold and that are blocked, where the blocked ones' share among the URLs that hold it
reaches ``MIN_CONFIDENCE`` and no smaller set already says so. FP-growth over the blocked URLs gives the
frequent sets, which are then counted over all labelled URLs, from each set's rarest token. Rules are matched
by an inverted index from token to rule. Everything runs as DataFrame operations.

FP-growth lists all subsets of a frequent set, so it gets only what rules of several tokens can need:
tokens that are frequent among blocked URLs and not confident alone (those are rules already, and no rule
of several tokens holds them), and of tokens that the same URLs hold only one, which stands for all of
them. Where more than ``AT_ONCE`` such tokens are left of a URL, it goes in as several sets, one for each
choice of ``MOST_ITEMS`` of the groups that its tokens are dealt into: every set of ``MOST_ITEMS`` tokens
is in one of them, and the count afterwards is of URLs. A rule is a list of classes of tokens, and fits
where each class has one.

Defined results: a null url, or one without ``://``, has an empty host and path and no tokens, so no
rule fits and it is allowed; equal urls get equal verdicts; URLs are judged by all their tokens, however
long; without labelled URLs no rule is mined; an empty table
gives no rows; other columns are kept, but for those named host, path, rule or verdict.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import stored, table

#: What the host rules say, as host/path and verdict.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT, MOST_ITEMS, AT_ONCE = 0.002, 0.8, 5, 3, 12
#: Rules and URLs are joined by broadcasting the rules up to so many bytes of their tokens; beyond it, by
#: shuffling with the URLs' tokens salted ``SALTS`` ways.
MOST_BROADCAST, SALTS = 32 << 20, 32


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    text = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = HOST_RULES) -> Column:
    """The longest rule that fits a host or one of its parents and begins the path; null if none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """The token set of a URL: h:label, t:last-two-labels, p:segment with digits as #."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    tail = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("t:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), tail, F.transform(segments, lambda x: F.concat(F.lit("p:"), x))))


def choices(items: Column) -> Column:
    """The items as one set, or as sets of at most ``AT_ONCE`` in which every ``MOST_ITEMS`` of them meet."""
    size = AT_ONCE // MOST_ITEMS
    last = F.ceil(F.size(items) / F.lit(size)).cast("int") - 1
    group = lambda i: F.slice(items, i * size + 1, F.lit(size))
    until = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def chosen(low: Column, left: int, held: Column | None) -> Column:
        each = lambda i: group(i) if held is None else F.concat(held, group(i))
        found = F.transform(until(low, last), each)
        return found if left == 1 else F.flatten(F.transform(until(low, last), lambda i: chosen(i + 1, left - 1, each(i))))

    return F.when(F.size(items) <= AT_ONCE, F.array(items)).otherwise(chosen(F.lit(0), MOST_ITEMS, None))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """The minimal rules of rows (tokens, blocked): antecedent, n_items, n_blocked, n, confidence.

    An antecedent is a list of classes of tokens; it fits a URL that has a token of each."""
    rows = stored(labelled.select(F.array_distinct("tokens").alias("tokens"), "blocked").filter(F.size("tokens") > 0), "url-tokens")
    least = max(min_count, math.ceil(min_support * rows.count()))
    n_blocked = F.sum(F.col("blocked").cast("long")).alias("n_blocked")
    # tokens of the same URLs have the same counts and the same sum of the URLs' hashes
    held = rows.select(F.xxhash64("tokens").cast("decimal(38,0)").alias("mark"), "blocked", F.explode("tokens").alias("token"))
    single = held.groupBy("token").agg(F.count("*").alias("n"), n_blocked, F.sum("mark").alias("mark")).filter(F.col("n_blocked") >= least)
    same = single.groupBy("n", "n_blocked", "mark").agg(F.sort_array(F.collect_list("token")).alias("same"))  # tokens of one URL
    same = stored(same.withColumn("confidence", F.col("n_blocked") / F.col("n")).drop("mark"), "url-classes")
    alone = same.filter(F.col("confidence") >= min_confidence).select(F.array("same").alias("antecedent"), F.lit(1).alias("n_items"), "n_blocked", "n", "confidence")
    open_classes = same.filter(F.col("confidence") < min_confidence).select(F.element_at("same", 1).alias("item"), "same", F.col("n").alias("item_n"))
    items = open_classes.select("item", F.explode("same").alias("token"))
    numbered = rows.withColumn("id", F.monotonically_increasing_id()).select("id", "blocked", F.explode("tokens").alias("token")).join(items, "token")
    sets = numbered.groupBy("id", "blocked").agg(F.sort_array(F.collect_set("item")).alias("items")).filter(F.size("items") > 1)
    sets = stored(sets.select("blocked", "items"), "url-sets")
    chosen = stored(sets.filter("blocked").select(F.explode(choices(F.col("items"))).alias("items")), "url-choices")
    n_sets = chosen.count()
    if n_sets == 0:
        return alone
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n_sets)).fit(chosen).freqItemsets
    several = found.filter(F.size("items").between(2, MOST_ITEMS)).select(F.sort_array("items").alias("rule"))
    several = counted(sets, several, open_classes).filter(F.col("n_blocked") >= least).withColumn("confidence", F.col("n_blocked") / F.col("n"))
    several = stored(minimal(several.filter(F.col("confidence") >= min_confidence)), "url-rules")
    classes = several.select("items", "n_blocked", "n", "confidence", F.explode("items").alias("item")).join(open_classes, "item")
    several = classes.groupBy("items", "n_blocked", "n", "confidence").agg(F.sort_array(F.collect_list("same")).alias("antecedent"))
    return alone.union(several.select("antecedent", F.size("antecedent").alias("n_items"), "n_blocked", "n", "confidence"))


def counted(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(items, n, n_blocked) of rules over all sets, each looked up where its rarest item is."""
    rarest = rules.select("rule", F.explode("rule").alias("item")).join(classes.select("item", "item_n"), "item").groupBy("rule").agg(F.min_by("item", F.struct("item_n", "item")).alias("item"))
    held = sets.select("blocked", "items", F.explode("items").alias("item")).join(rarest, "item")
    fits = held.filter(F.size(F.array_except("rule", "items")) == 0)
    return fits.groupBy(F.col("rule").alias("items")).agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("n_blocked"))


def minimal(sets: DataFrame) -> DataFrame:
    """Rows with ``items``, of ``MOST_ITEMS`` at most, of which no other row's items are a part."""
    parts = F.expr("explode(transform(sequence(1, shiftleft(1, size(items)) - 2), m -> filter(items, (x, i) -> shiftright(m, i) & 1 = 1)))")
    parts = sets.select("items", parts.alias("part"))
    known = sets.select(F.col("items").alias("part"))
    return sets.join(parts.join(known, "part", "left_semi").select("items").distinct(), "items", "left_anti")


def match(sets: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """The distinct keys of rows (key, tokens) that a rule fits."""
    named = rules.select(F.xxhash64(F.to_json(F.struct("antecedent"))).alias("rule_id"), "n_items", F.posexplode("antecedent").alias("part", "same"))
    items = named.select("rule_id", "n_items", "part", F.explode("same").alias("token"))
    held = sets.select(key, F.explode("tokens").alias("token"))
    if (items.agg(F.sum(F.octet_length("token") + 32)).first()[0] or 0) <= MOST_BROADCAST:
        joined = held.join(F.broadcast(items), "token")
    else:
        salts = F.array(*map(F.lit, range(SALTS)))
        joined = held.withColumn("salt", F.pmod(F.hash(key), F.lit(SALTS))).join(items.withColumn("salt", F.explode(salts)), ["token", "salt"])
    fits = joined.groupBy(key, "rule_id", "n_items").agg(F.count_distinct("part").alias("parts"))
    return fits.filter(F.col("parts") == F.col("n_items")).select(key).distinct()


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to rows with a url; ``rules`` as ``mine`` gives them."""
    parts = urls.select(F.struct("*").alias("row"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    parts = parts.withColumn("rule", host_rule(F.col("host"), F.col("path"))).withColumn("place", F.concat_ws("/", "host", "path"))
    open_places = parts.filter(F.col("rule").isNull() & (F.col("host") != ""))
    sets = open_places.select("place", tokens(F.col("host"), F.col("path")).alias("tokens")).distinct()
    hits = match(sets, "place", rules).withColumn("mined", F.lit("block"))
    fixed = F.lit(None).cast("string")
    for rule, verdict in HOST_RULES:
        fixed = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(fixed)
    kept = [F.col("row").getField(c).alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    verdict = F.coalesce(fixed, F.col("mined"), F.lit("allow"))
    return parts.join(hits, "place", "left").select(*kept, "host", "path", "rule", verdict.alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (tokens, blocked) of the pages with a label, the worst of several."""
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    joined = pages.select("page_id", "url").join(marks, "page_id")
    return joined.select(tokens(host(F.col("url")), path(F.col("url"))).alias("tokens"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_filter(string_split(host, '.'), lambda x: x <> '') AS labels,
    list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS segs
  FROM p),
t AS (
  SELECT page_id, host, path, rule, list_filter(x, lambda v, i: list_position(x, v) = i) AS tokens
  FROM (SELECT *, list_concat(list_concat(list_transform(labels, lambda x: 'h:' || x),
    CASE WHEN len(labels) >= 2 THEN ['t:' || labels[-2] || '.' || labels[-1]] ELSE [] END), list_transform(segs, lambda x: 'p:' || x)) AS x FROM r)),
lab AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS blocked FROM labels GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS id, tokens, coalesce(blocked, false) AS blocked FROM t JOIN lab ON doc_id = page_id WHERE len(tokens) > 0),
n AS (SELECT greatest(5, ceil(0.002 * count(*))) AS least FROM l),
e AS (SELECT id, blocked, unnest(tokens) AS x FROM l),
subsets AS (
  SELECT id, blocked, [x] AS items FROM e
  UNION ALL SELECT a.id, a.blocked, [a.x, b.x] FROM e a JOIN e b ON a.id = b.id AND a.x < b.x
  UNION ALL SELECT a.id, a.blocked, [a.x, b.x, c.x] FROM e a JOIN e b ON a.id = b.id AND a.x < b.x JOIN e c ON a.id = c.id AND b.x < c.x),
counted AS (
  SELECT items, count(*) AS n, count(*) FILTER (WHERE blocked) AS b FROM subsets GROUP BY items),
rules AS (SELECT items FROM counted, n WHERE b >= least AND b::DOUBLE / counted.n >= 0.8),
hit AS (SELECT DISTINCT page_id FROM t JOIN rules ON list_has_all(t.tokens, rules.items))
SELECT t.page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM t LEFT JOIN hit USING (page_id)
"""
