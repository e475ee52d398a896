"""Crawl frontier: flags, priorities, scope, robots, and the accept or reject decision.

Links are rows source_uri, target_uri, target_ip, can_be_discarded; every step adds columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Settings
from ..functions.hashing import HashRange
from ..functions.scalars import private_address
from ..functions.urls import SCHEMES, host, path

#: Top-level domains whose pages aren't wanted.
BLOCKED_DOMAINS = (
    ".cn", ".jp", ".de", ".ru", ".it", ".eg", ".ez", ".iq", ".sa", ".hk", ".dz", ".vi", ".id",
    ".fr", ".pl", ".es", ".mx", ".my", ".kr", ".in", ".ch", ".ro", ".be", ".se", ".br",
)
#: Path endings of media files.
MEDIA_ENDINGS = (".jpg", ".jpeg", ".gif", ".png", ".ico", ".svg", ".avi", ".mp4", ".mp3", ".wav")
#: Priorities; smaller is sooner.
NO_PRIORITY = 2**32 - 1
UNSUPPORTED, VISITED, DOMAIN_BLOCKED, PROBABLY_BLOCKED = 750_000_000, 750_000_000, 1_000_000_000, 1_000_000_000
SAME_HOST, BASE = (10_000_000, 200_000_000), (0, 5_000_000)
#: A letter for each flag, in the order of the state code.
STATE_CODES = (
    ("malformed", "M"), ("priority_too_low", "H"), ("blocked_by_robots", "R"), ("unsupported", "U"), ("probably_blocked", "P"), ("blocked_domain", "L"),
    ("bad_network", "N"), ("visited_recently", "V"), ("ip_seen_recently", "I"), ("chunk_too_high", "C"), ("out_of_scope", "S"),
)
#: Relative accuracy of percentiles is one part in this many.
PERCENTILE_ACCURACY = 10_000
ISSUES = ("unsupported", "blocked_domain", "probably_blocked", "malformed", "bad_ip", "out_of_scope", "ip_seen_recently")


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def early_flags(links: DataFrame, scope: HashRange = HashRange()) -> DataFrame:
    """unsupported, blocked_domain, probably_blocked, malformed, out_of_scope, bad_ip, target_hash."""
    uri = F.col("target_uri")
    h, p = host(uri), F.coalesce(path(uri), F.lit(""))
    digest = F.md5(uri.cast("binary"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return links.select(
        "*", digest.alias("target_hash"),
        (~F.coalesce(F.lower(F.try_parse_url(uri, F.lit("PROTOCOL"))).isin(*SCHEMES), F.lit(False))).alias("unsupported"),
        flag(_any(F.endswith(h, F.lit(d)) for d in BLOCKED_DOMAINS)).alias("blocked_domain"),
        _any(F.endswith(p, F.lit(e)) for e in MEDIA_ENDINGS).alias("probably_blocked"),
        (h.isNull() | F.startswith(h, F.lit("0."))).alias("malformed"),
        (~scope.contains(digest)).alias("out_of_scope"),
        private_address(F.col("target_ip")).alias("bad_ip"),
    )


def needs_visiting(links: DataFrame, visited: DataFrame, now: Column, hash_col: str = "target_hash", also: Sequence[str] = ()) -> DataFrame:
    """Links without those whose next fetch is still to come; unknown links need visiting.

    also: columns of both that must agree besides the hash, where one address has several rows.
    """
    waiting = visited.where(F.col("next_fetch") > now).select(F.col("uri_hash").alias(hash_col), *also)
    return links.join(waiting, [hash_col, *also], "left_anti")


def with_visited(links: DataFrame, visited: DataFrame, now: Column) -> DataFrame:
    waiting = visited.where(F.col("next_fetch") > now).select(F.col("uri_hash").alias("target_hash"), F.lit(True).alias("_w")).dropDuplicates(["target_hash"])
    return links.join(waiting, "target_hash", "left").withColumn("visited_recently", F.coalesce("_w", F.lit(False))).drop("_w")


def assign_servers(links: DataFrame, servers: DataFrame, hash_col: str = "target_hash") -> DataFrame:
    """links with the server whose [min_hash, max_hash] holds the hash; null where none does.

    Ranges are cut by their first two hex digits, at most 256 of them, so that the join is an
    equality with a bound check instead of a nested loop.
    """
    start, end = (F.conv(F.substring(c, 1, 2), 16, 10).cast("int") for c in ("min_hash", "max_hash"))
    s = servers.select("server_id", F.lower("min_hash").alias("_min"), F.lower("max_hash").alias("_max"), F.explode(F.sequence(start, end)).alias("_cell"))
    cells = links.withColumn("_cell", F.conv(F.substring(hash_col, 1, 2), 16, 10).cast("int"))
    on = (cells["_cell"] == s["_cell"]) & cells[hash_col].between(s["_min"], s["_max"])
    return cells.join(s, on, "left").drop("_cell", "_min", "_max")


def _draw(seed: int, low: int, high: int, *by: str) -> Column:
    return F.lit(low) + F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(high - low))


def with_priority(links: DataFrame, seed: int = 0) -> DataFrame:
    """priority by the first rule that fits; random parts repeat for one seed.

    Ordinary links of an address count up from a base that the address draws; they are
    numbered by a window over the address, whose chunks are bounded by the buffer in use. Other
    links, those without an address among them, need no number and spread over all tasks.
    """
    plain = ~F.col("unsupported") & ~same_host() & ~F.col("blocked_domain") & ~F.col("probably_blocked") & ~F.col("visited_recently") & F.col("target_ip").isNotNull()
    own = F.when(~plain, F.monotonically_increasing_id())
    rank = F.row_number().over(Window.partitionBy("_ip", "_own").orderBy("target_uri", "source_uri")) - 1
    return links.withColumns({"_own": own, "_ip": F.when(plain, F.col("target_ip"))}).withColumn(
        "priority",
        F.when(F.col("unsupported"), F.lit(UNSUPPORTED))
        .when(same_host(), _draw(seed, *SAME_HOST, "source_uri", "target_uri"))
        .when(F.col("blocked_domain"), F.lit(DOMAIN_BLOCKED))
        .when(F.col("probably_blocked"), F.lit(PROBABLY_BLOCKED))
        .when(F.col("visited_recently"), F.lit(VISITED))
        .when(F.col("target_ip").isNull(), F.lit(NO_PRIORITY))
        .otherwise(_draw(seed, *BASE, "target_ip") + rank)
        .cast("bigint"),
    ).drop("_own", "_ip")


def same_host() -> Column:
    return F.col("source_uri").isNull() | host(F.col("source_uri")).eqNullSafe(host(F.col("target_uri")))


def with_chunk_sequence(links: DataFrame, carried: DataFrame | None = None, chunk: str | None = None) -> DataFrame:
    """chunk_sequence: rank within the address by priority, from where the last chunk ended.

    carried: target_ip, chunk_sequence of the address that was served last. chunk: a column that
    tells an address's chunks apart (``windows.chunks``); without it all its links are one chunk.
    """
    rank = F.row_number().over(Window.partitionBy("target_ip", *([chunk] if chunk else [])).orderBy("priority", "target_uri")) - 1
    if carried is None:
        return links.withColumn("chunk_sequence", rank)
    start = F.broadcast(carried.limit(1).select("target_ip", F.col("chunk_sequence").alias("_start")))
    return links.join(start, "target_ip", "left").withColumn("chunk_sequence", rank + F.coalesce("_start", F.lit(0))).drop("_start")


def robots_rules(files: DataFrame) -> DataFrame:
    """host, seq, agent, directive, pattern of robots files (host, text).

    An agent line that follows a rule starts a new group; neighbouring ones share their rules.
    """
    line = F.trim(F.regexp_replace(F.col("line"), "#.*$", ""))
    rows = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("seq", "line")).select("host", "seq", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"), F.trim(F.regexp_replace(line, "^[^:]*:?", "")).alias("value"))
    rows = rows.where(F.col("name").isin("user-agent", "disallow", "allow", "sitemap"))
    order = Window.partitionBy("host").orderBy("seq")
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("_start", starts.cast("int")).withColumn("_group", F.sum("_start").over(order)).drop("_start")
    agents = rows.where("name = 'user-agent'").select("host", "_group", F.lower("value").alias("agent"))
    rules = rows.where(F.col("name").isin("disallow", "allow") & (F.col("value") != "")).select("host", "_group", "seq", F.col("name").alias("directive"), F.col("value").alias("pattern"))
    own = rules.join(agents, ["host", "_group"]).select("host", "seq", "agent", "directive", "pattern")
    maps = rows.where("name = 'sitemap'").select("host", "seq", F.lit("*").alias("agent"), F.lit("sitemap").alias("directive"), F.col("value").alias("pattern"))
    return own.unionByName(maps)


def sitemaps(rules: DataFrame) -> DataFrame:
    return rules.where("directive = 'sitemap'").select("host", F.col("pattern").alias("uri"))


def rule_regex(pattern: str) -> str:
    """An anchored expression for a rule: a prefix, with * for anything and $ at the end."""
    end = pattern.endswith("$")
    return "^" + ".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + ("$" if end else "")


def rule_regex_column(pattern: Column) -> Column:
    """rule_regex inside a plan; each character with a meaning of its own is escaped."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\\[\](){}.+?^$|])", r"\\$1")
    body = F.regexp_replace(body, r"\*", ".*")
    return F.concat(F.lit("^"), body, F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))


def blocked_by_robots(links: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """links with blocked_by_robots: a Disallow of the agent, or else of ``*``, fits.

    The rules of a host meet in one expression, bounded by its robots file, so links join once
    by host, and neighbouring links of a host share its compiled form.
    """
    mine = rules.where((F.col("directive") == "disallow") & F.col("agent").isin(agent.lower(), "*"))
    best = mine.groupBy("host").agg(F.max((F.col("agent") == agent.lower()).cast("int")).alias("_named"))
    used = mine.join(best, "host").where((F.col("agent") == agent.lower()).cast("int") == F.col("_named"))
    lists = used.groupBy("host").agg(F.concat_ws("|", F.sort_array(F.collect_set(rule_regex_column(F.col("pattern"))))).alias("_rules")).withColumnRenamed("host", "_host")
    query = F.try_parse_url(F.col("target_uri"), F.lit("QUERY"))
    target = F.concat(F.coalesce(F.nullif(path(F.col("target_uri")), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    joined = links.withColumn("_host", host(F.col("target_uri"))).join(lists, "_host", "left").withColumn("_target", target)
    hit = F.regexp_like(F.col("_target"), F.col("_rules"))
    return joined.withColumn("blocked_by_robots", F.coalesce(hit, F.lit(False))).drop("_host", "_rules", "_target")


def nth_link(links: DataFrame, n: int) -> Row | None:
    """priority and target_uri of the n-th link by both, null priorities last; None if there are fewer.

    Approximate percentiles close in on its priority, an exact count says how many links come
    before, and only links between them are put in order.
    """
    known = links.where("priority is not null").select("priority", "target_uri")
    total = known.count()
    if n > total:
        return None
    share, slack = n / total, 2 / PERCENTILE_ACCURACY
    low, high = known.agg(F.percentile_approx("priority", [max(0.0, share - slack), min(1.0, share + slack)], PERCENTILE_ACCURACY)).first()[0]
    before, upto = known.agg(F.count_if(F.col("priority") < low), F.count_if(F.col("priority") <= high)).first()
    if not before < n <= upto:
        low, high, before = None, None, 0
    near = known if low is None else known.where(F.col("priority").between(low, high))
    return near.orderBy("priority", "target_uri").offset(n - before - 1).limit(1).first()


def decide(links: DataFrame, settings: Settings = Settings(), *, quota_left: int | None = None) -> DataFrame:
    """status accepted or discarded, and the reason, by the first rule that fits.

    Expects the flags, priority, chunk_sequence, host_issues (null: none), ip_seen_recently
    and blocked_by_robots; what is missing counts as false. With quota_left, links after that
    many by priority and address are discarded; equal ones share a verdict.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in links.columns else F.lit(False)
    loose = F.coalesce("can_be_discarded", F.lit(True))
    h = host(F.col("target_uri"))
    issues = F.coalesce("host_issues", F.lit(0)) if "host_issues" in links.columns else F.lit(0)
    reason = (
        F.when(h.isNull() | (F.trim(h) == ""), "malformed")
        .when(loose & _any(flag(c) for c in ISSUES), "early")
        .when(loose & (F.col("priority") > settings.max_link_priority), "priority")
        .when(loose & (F.col("chunk_sequence") > settings.max_chunk_sequence), "chunk")
        .when(loose & flag("ip_seen_recently"), "ip")
        .when(issues > settings.max_host_issues, "network")
        .when(flag("blocked_by_robots"), "robots")
    )
    if quota_left is not None:
        last = nth_link(links, quota_left) if quota_left > 0 else None
        over = F.lit(quota_left <= 0)
        if last is not None and quota_left > 0:
            over = (F.col("priority") > last.priority) | ((F.col("priority") == last.priority) & (F.col("target_uri") > last.target_uri))
        reason = F.when(over, "quota").otherwise(reason)
    return links.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("discarded"))


def state_code(df: DataFrame) -> Column:
    """Letters of the set flags; B first for a link without a priority."""
    have = [F.when(F.coalesce(F.col(c), F.lit(False)), letter).otherwise("") for c, letter in STATE_CODES if c in df.columns]
    return F.concat(F.when(F.col("priority") == NO_PRIORITY, "B").otherwise(""), *have)


def encode_links(df: DataFrame) -> DataFrame:
    """One tab-separated line per link: state, priority, target, source, address, sequence."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat_ws("\t", state_code(df), text("priority"), text("target_uri"), text("source_uri"), F.coalesce(F.col("target_ip"), F.lit("255.255.255.255")), text("chunk_sequence")).alias("value"))


def write_outbox(links: DataFrame, path: str, *, mode: str = "error") -> None:
    """Links outside this server's range, as lines that other servers read with decode_links."""
    encode_links(links.where("out_of_scope")).write.mode(mode).text(path)


def decode_links(lines: DataFrame) -> DataFrame:
    """Links of such lines; lines with too few fields or no numeric priority are left out."""
    p = F.split("value", "\t")
    flags = [F.contains(F.get(p, F.lit(0)), F.lit(letter)).alias(name) for name, letter in STATE_CODES]
    ip = F.get(p, F.lit(4))
    return lines.where(F.size(p) >= 5).select(
        F.get(p, F.lit(1)).try_cast("bigint").alias("priority"), F.get(p, F.lit(2)).alias("target_uri"), F.nullif(F.get(p, F.lit(3)), F.lit("")).alias("source_uri"),
        F.nullif(ip, F.lit("255.255.255.255")).alias("target_ip"), F.coalesce(F.get(p, F.lit(5)).try_cast("int"), F.lit(0)).alias("chunk_sequence"), *flags,
    ).where("priority is not null and target_uri <> ''")


def sample_links(links_col: str = "links", settings: Settings = Settings(), seed: int = 0) -> Column:
    """Up to links_per_page links of the first links_considered, the same ones each time for one seed."""
    first = F.slice(F.col(links_col), 1, settings.links_considered)
    drawn = F.array_sort(F.transform(first, lambda x, i: F.struct(F.xxhash64(F.lit(seed), x, i).alias("draw"), x.alias("link"))))
    return F.transform(F.slice(drawn, 1, settings.links_per_page), lambda x: x["link"])
