"""URL filters (2), native: a temporal join of captures against dated lists.

List entries are events: on a day a key (a host, or a host with a path prefix) is put on a list or
taken off. Events of one (list, key) become validity intervals; a capture is held against the
intervals that are open at its fetch time. Intervals and captures meet by (key, period) in an equi-join:
an interval is copied to each period it touches, a capture lies in one period, so even a hot
host is spread over periods and adaptive execution can split what is left. No page text is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, own, table, written

#: Intervals are cut at the horizon of days so that the number of periods is bounded.
PERIOD_DAYS, FIRST_DAY, LAST_DAY = 90, 0, 7300


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, day) to (list, key, valid_from, valid_to): half-open, null valid_to if still open.

    ``action`` is 'add' or 'remove'. Several events of a day: 'remove' wins. A repeated 'add' prolongs
    nothing, it is merged. Rows with a null in any of the four columns are left out.
    """
    events = entries.select("list", "key", "action", "day").where("list IS NOT NULL AND key IS NOT NULL AND action IN ('add', 'remove') AND day IS NOT NULL")
    days = events.groupBy("list", "key", "day").agg(F.max(F.col("action") == "remove").alias("off"))
    w = Window.partitionBy("list", "key").orderBy("day")
    changes = days.withColumn("before", F.lag("off").over(w)).where("before IS NULL OR before <> off")
    return changes.withColumn("valid_to", F.lead("day").over(w)).where("NOT off").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


#: Scheme, user and host of a URL; a host in brackets is an IPv6 address.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"


def host_of(url):
    """Host in lower case, without user, port and a final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url):
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host, path, labels: int, depth: int):
    """Distinct keys that a list may hold for a URL: its host, each parent domain, and the host with each path prefix.

    Parent domains have two labels or more, prefixes end in a part that is not empty. Keys of more than
    ``labels`` labels or ``depth`` parts are left out (the host itself is not), so a long URL makes few.
    """
    none = F.array().cast("array<string>")
    names = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    most = F.least(F.size(names), F.lit(labels))
    parents = F.transform(F.sequence(F.lit(2), F.greatest(most, F.lit(2))), lambda k: F.when(k <= most, F.array_join(F.slice(names, F.size(names) - k + 1, k), ".")))
    if not depth:
        prefixes = none
    else:
        parts = F.slice(F.split(path, "/", depth + 2), 2, depth)
        prefixes = F.transform(parts, lambda part, k: F.when(part != "", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k + 1), "/"))))
    return F.when(host.isNull(), none).otherwise(F.array_distinct(F.array_compact(F.concat(F.array(host), parents, prefixes))))


def matches(captures: DataFrame, entries: DataFrame, id_: str = "page_id", url: str = "url", day: str = "day", period: int = PERIOD_DAYS) -> DataFrame:
    """(id, list, key, valid_from, valid_to, day) for each capture and interval that was open on its day.

    Captures with a null URL, host or day match nothing; repeated captures match once each; days
    outside of the horizon [FIRST_DAY, LAST_DAY] count to its first or last period.
    """
    number = lambda d: F.floor((F.least(F.greatest(d, F.lit(FIRST_DAY)), F.lit(LAST_DAY)) - FIRST_DAY) / period).cast("int")
    spans = intervals(entries)
    parts = F.split("key", "/")
    size = entries.agg(F.max(F.size(F.split(parts[0], r"\."))).alias("labels"), F.max(F.size(parts) - 1).alias("depth")).first()  # two numbers
    spans = spans.withColumn("period", F.explode(F.sequence(number(F.col("valid_from")), number(F.coalesce("valid_to", F.lit(LAST_DAY))))))
    seen = captures.select(own(captures, id_).alias("id"), own(captures, url).alias("url"), own(captures, day).alias("day")).where("url IS NOT NULL AND day IS NOT NULL")
    seen = seen.select("id", "day", number(F.col("day")).alias("period"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.select("id", "day", "period", F.explode(keys_of(F.col("host"), F.col("path"), size.labels or 0, size.depth or 0)).alias("key"))
    return seen.join(spans, ["key", "period"]).where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)").select("id", "list", "key", "valid_from", "valid_to", "day")


def filter_urls(captures: DataFrame, entries: DataFrame, id_: str = "page_id", url: str = "url", day: str = "day", blocking: tuple[str, ...] = ("block",), excepting: tuple[str, ...] = ("allow",)) -> DataFrame:
    """``captures`` with lists (sorted, comma-joined), n_matches, match_key (longest, then least key) and blocked.

    Blocked: a match on a ``blocking`` list and none on an ``excepting`` list with a key as long or
    longer. Captures that match nothing have '', 0, null and false. Repeated ids share their matches
    (those of all their rows); a null id matches nothing. Added columns get underscores where a name is
    taken. Of a very long URL only as many labels and path parts are read as the longest entry has.
    """
    names = [free_name(captures, n) for n in ("lists", "n_matches", "match_key", "blocked")]
    mine = [free_name(captures, n) for n in ("hw_id", "hw_0", "hw_1", "hw_2", "hw_3")]
    length = lambda which: F.max(F.when(F.col("list").isin(*which), F.length("key")))
    found = matches(captures, entries, id_, url, day).where("id IS NOT NULL").distinct().groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("n_matches"),
        F.min(F.struct((-F.length("key")).alias("n"), F.col("key").alias("key")))["key"].alias("match_key"),
        F.coalesce(length(blocking) > F.coalesce(length(excepting), F.lit(0)), F.lit(False)).alias("blocked"),
    ).toDF(*mine)
    out = captures.join(found, own(captures, id_) == F.col(mine[0]), "left")
    values = (F.coalesce(mine[1], F.lit("")), F.coalesce(mine[2], F.lit(0)), F.col(mine[3]), F.coalesce(mine[4], F.lit(False)))
    return out.select(*[own(captures, c) for c in captures.columns], *[v.alias(n) for v, n in zip(values, names)])


def _day(of, salt: str, span: int):
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), of)), 1, 8), 16, 10).cast("long"), F.lit(span)).cast("int")


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, by fixed rules (days 0 to 3650), as the driver's tables hold none.

    Each host is added to 'block' and later taken off again; hosts of some hashes come back. Parent
    domains are blocked from a day on, and each host's path part '/en' and '/fr' is on 'allow' for a time.
    """
    hosts = written(pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct(), "hosts")
    event = lambda name, key, action, day: F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), day.alias("day"))
    host, no_event = F.col("host"), F.lit(None)
    on, off = _day(host, "on:", 1800), _day(host, "off:", 1800)
    some = [event("block", host, "add", on), event("block", host, "remove", on + 1 + off), F.when(_day(host, "again:", 3) == 0, event("block", host, "add", on + 100 + off)).otherwise(no_event)]
    for part in ("/en", "/fr"):
        key = F.concat(host, F.lit(part))
        some += [event("allow", key, "add", _day(key, "on:", 1800)), event("allow", key, "remove", 1800 + _day(key, "off:", 1800))]
    parents = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("host")).where("host <> ''").distinct()
    parents = parents.where(_day(host, "parent:", 2) == 0).select(event("block", host, "add", _day(host, "pon:", 3650)).alias("e"))
    return hosts.select(F.explode(F.array_compact(F.array(*some))).alias("e")).unionByName(parents).select("e.*")


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", _day(F.concat(F.col("page_id").cast("string"), F.col("url")), "fetch:", 3650))
    return filter_urls(captures, sample_entries(pages))


_SQL_DAY = "(('0x' || substr(md5('{0}' || {1}), 1, 8))::BIGINT % {2})::INTEGER"
SQL = f"""
WITH pages_ AS (
  SELECT page_id, url, {_SQL_DAY.format("fetch:", "(page_id::VARCHAR || url)", 3650)} AS day,
   nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)', 1)), '\\.$', ''), '') AS host,
   regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '^(/[^/]+)', 1) AS part FROM pages),
 hosts AS (SELECT DISTINCT host FROM pages_ WHERE host IS NOT NULL),
 parents AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS host FROM hosts WHERE regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) <> ''),
 days AS (SELECT host, {_SQL_DAY.format("on:", "host", 1800)} AS d1, {_SQL_DAY.format("off:", "host", 1800)} AS d2 FROM hosts),
 parts AS (SELECT host || p AS key FROM hosts, (VALUES ('/en'), ('/fr')) v(p)),
 events_ AS (
  SELECT 'block' AS list, host AS key, 'add' AS action, d1 AS day FROM days
  UNION ALL SELECT 'block', host, 'remove', d1 + 1 + d2 FROM days
  UNION ALL SELECT 'block', host, 'add', d1 + 100 + d2 FROM days WHERE {_SQL_DAY.format("again:", "host", 3)} = 0
  UNION ALL SELECT 'block', host, 'add', {_SQL_DAY.format("pon:", "host", 3650)} FROM parents WHERE {_SQL_DAY.format("parent:", "host", 2)} = 0
  UNION ALL SELECT 'allow', key, 'add', {_SQL_DAY.format("on:", "key", 1800)} FROM parts
  UNION ALL SELECT 'allow', key, 'remove', 1800 + {_SQL_DAY.format("off:", "key", 1800)} FROM parts),
 per_day AS (SELECT list, key, day, bool_or(action = 'remove') AS off FROM events_ GROUP BY ALL),
 spans AS (SELECT list, key, day AS a, lead(day) OVER w AS b, off FROM (
   SELECT *, lag(off) OVER (PARTITION BY list, key ORDER BY day) AS before FROM per_day) WHERE before IS NULL OR before <> off
   WINDOW w AS (PARTITION BY list, key ORDER BY day)),
 keys AS (
  SELECT DISTINCT page_id, day, unnest(list_concat(
    [array_to_string(string_split(host, '.')[k:], '.') for k in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)],
    CASE WHEN part <> '' THEN [host || part] ELSE [] END)) AS key FROM pages_ WHERE host IS NOT NULL),
 found AS (
  SELECT page_id, list, key, a FROM keys JOIN spans USING (key) WHERE NOT off AND a <= day AND (b IS NULL OR day < b)),
 said AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n, (arg_min(key, (-length(key), key))) AS match_key,
   coalesce(max(length(key)) FILTER (list = 'block') > coalesce(max(length(key)) FILTER (list = 'allow'), 0), false) AS blocked FROM found GROUP BY page_id)
SELECT p.page_id, p.url, p.day, coalesce(lists, '') AS lists, coalesce(n, 0) AS n_matches, match_key, coalesce(blocked, false) AS blocked
FROM pages_ p LEFT JOIN said s USING (page_id)
"""
