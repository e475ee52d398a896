"""Result sets of workspaces: upsert, listing, sampling and bulk changes.

A result set is a DataFrame with workspace_id, uri_hash and the page's metadata; every change
returns the new set, to be written over the old one partition-wise (``save``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..plans.compiler import Context, compile_query
from ..plans.registry import STREAM, TEXT

KEY = ["workspace_id", "uri_hash"]
ORDERS = ("sequence", "updated")
OWNER, MANAGE, READ, WRITE = 1, 2, 4, 8


def upsert(store: DataFrame, incoming: DataFrame, now: Column | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """Incoming rows replace those of their key or are added.

    created stays; updated becomes now for new rows and for those whose data hash changed. now
    is the time of the call unless given, and stays so however often the result is read.
    Equal keys in the store and in incoming are expected to be unique.
    """
    stamp = now if now is not None else F.lit(datetime.now(timezone.utc))
    old, new = store.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    fresh, known = F.col(f"n.{key[-1]}").isNotNull(), F.col(f"o.{key[-1]}").isNotNull()
    changed = ~F.col("o.data_hash").eqNullSafe(F.col("n.data_hash"))
    cols = []
    for c in store.columns:
        given = F.col(f"n.{c}") if c in incoming.columns else F.col(f"o.{c}")
        if c == "created":
            value = F.coalesce(F.col("o.created"), F.col("n.created") if c in incoming.columns else stamp, stamp)
        elif c == "updated":
            value = F.when(fresh & (~known | changed), stamp).otherwise(F.col("o.updated"))
        else:
            value = F.when(fresh, given).otherwise(F.col(f"o.{c}"))
        cols.append(value.alias(c))
    return old.join(new, on, "full_outer").select(*cols)


def upsert_visited(visited: DataFrame, fetched: DataFrame, now: Column, days: int = 28, key: str = "uri_hash") -> DataFrame:
    """uri_hash, next_fetch: fetched pages (uri_hash) are due again after some days. A key that tells pages of one address apart is returned too."""
    cols = list(dict.fromkeys((key, "uri_hash")))
    due = fetched.select(*cols).distinct().withColumn("next_fetch", F.date_add(now, days).cast("timestamp"))
    return visited.join(due.select(key), key, "left_anti").select(*cols, "next_fetch").unionByName(due)


def upsert_by(store: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Sites, server nodes and the like: incoming rows win over stored ones of their key."""
    return store.join(incoming.select(*key), list(key), "left_anti").unionByName(incoming, allowMissingColumns=True)


@dataclass(frozen=True)
class Listing:
    """A page of results, and where it stands."""

    results: DataFrame
    total: int
    subset: int
    page: int
    page_size: int


def order_columns(order: str) -> list[Column]:
    """``sequence``, ``updated:desc`` and the like, comma-separated."""
    out = []
    for part in filter(None, (p.strip().lower() for p in order.split(","))):
        name, _, way = part.replace(" ", ":").partition(":")
        if name not in ORDERS or way not in ("", "asc", "desc"):
            raise InvalidRequest(f"can't order by {part!r}")
        out.append(F.col(name).desc() if way == "desc" else F.col(name).asc())
    return out or [F.col("sequence").asc()]


def list_results(store: DataFrame, workspace_id: str, *, order: str = "sequence", offset: int = 0, count: int = 100, query: str = "", ctx: Context | None = None, most: int = 1000) -> Listing:
    """A page of a workspace's results, all or those that a query keeps."""
    if offset < 0 or not 1 <= count <= most:
        raise InvalidRequest(f"offset must be 0 or more and count from 1 to {most}")
    own = store.where(F.col("workspace_id") == workspace_id)
    total = own.count()
    kept, subset = own, total
    if query.strip():
        kept = select_by(own, query, ctx)
        subset = kept.count()
    return Listing(kept.orderBy(*order_columns(order)).offset(offset).limit(count), total, subset, offset // count, count)


def random_results(store: DataFrame, workspace_id: str, above: float, count: int) -> DataFrame:
    """Rows whose stored random number exceeds a value, in its order and that of their sequence; there may be too few."""
    if not 1 <= count <= 1000:
        raise InvalidRequest("count must be from 1 to 1000")
    return store.where((F.col("workspace_id") == workspace_id) & (F.col("random") > above)).orderBy("random", "sequence").limit(count)


def _query_condition(query: str, ctx: Context | None) -> Column:
    compiled = compile_query(query, ctx)
    if compiled.inputs & {TEXT, STREAM}:
        raise InvalidRequest("stored results have neither text nor bytes to look at")
    return compiled.condition()


def select_by(store: DataFrame, query: str, ctx: Context | None = None) -> DataFrame:
    return store.where(_query_condition(query, ctx))


@dataclass(frozen=True)
class Pick:
    """Which rows of a workspace a change is for: all, those of some keys, or of a query.

    key is the column that tells a workspace's rows apart; the address unless it may repeat.
    """

    workspace_id: str
    hashes: DataFrame | None = None
    query: str | None = None
    ctx: Context | None = None
    key: str = "uri_hash"

    def mark(self, store: DataFrame) -> DataFrame:
        """store with a boolean column _picked."""
        own = F.col("workspace_id") == self.workspace_id
        if self.query is not None:
            return store.withColumn("_picked", own & F.coalesce(_query_condition(self.query, self.ctx), F.lit(False)))
        if self.hashes is not None:
            keys = self.hashes.select(self.key).distinct().withColumn("_key", F.lit(True))
            return store.join(keys, self.key, "left").withColumn("_picked", own & F.coalesce("_key", F.lit(False))).select(*store.columns, "_picked")
        return store.withColumn("_picked", own)


def delete(store: DataFrame, pick: Pick) -> DataFrame:
    return pick.mark(store).where("not _picked").select(*store.columns)


def copy(store: DataFrame, pick: Pick, target: str) -> DataFrame:
    """Picked rows also appear in the target, unless it has their page already."""
    taken = pick.mark(store).where("_picked").select(*store.columns).withColumn("workspace_id", F.lit(target))
    new = taken.join(store.where(F.col("workspace_id") == target).select(pick.key), pick.key, "left_anti")
    return store.unionByName(new.select(*store.columns))


def move(store: DataFrame, pick: Pick, target: str) -> DataFrame:
    """Picked rows go to the target; where it has their page already, its own row stays."""
    if target == pick.workspace_id:
        return store
    marked = pick.mark(store)
    there = store.where(F.col("workspace_id") == target).select(pick.key)
    kept = marked.where("not _picked").select(*store.columns)
    moved = marked.where("_picked").join(there, pick.key, "left_anti").withColumn("workspace_id", F.lit(target)).select(*store.columns)
    return kept.unionByName(moved)


def tag(store: DataFrame, pick: Pick, name: str) -> DataFrame:
    new = F.when(F.col("_picked"), F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(name)))).otherwise(F.col("tags"))
    return pick.mark(store).withColumn("tags", new).select(*store.columns)


def untag(store: DataFrame, pick: Pick, name: str) -> DataFrame:
    return pick.mark(store).withColumn("tags", F.when(F.col("_picked"), F.array_remove("tags", name)).otherwise(F.col("tags"))).select(*store.columns)


@dataclass(frozen=True)
class Transform:
    """A change as clients ask for it: an action of ``ACTIONS`` and what it needs."""

    action: str
    workspace_id: str
    hashes: DataFrame | None = None
    query: str | None = None
    target: str | None = None
    tag: str | None = None
    key: str = "uri_hash"

    def validate(self) -> None:
        if self.action not in ACTIONS:
            raise InvalidRequest(f"no action is called {self.action!r}")
        verb, scope = ACTIONS[self.action]
        if scope == "specific" and self.hashes is None:
            raise InvalidRequest("results are missing")
        if scope == "query" and not (self.query or "").strip():
            raise InvalidRequest("a query is missing")
        if verb in ("move", "copy") and not self.target:
            raise InvalidRequest("a target is missing")
        if verb in ("tag", "untag") and not (self.tag or "").strip():
            raise InvalidRequest("a tag is missing")


#: What each action does, and to which rows.
ACTIONS = {f"{verb}_{scope}": (verb, scope) for verb in ("delete", "move", "copy", "tag", "untag") for scope in ("all", "specific", "query")}


def transform(store: DataFrame, t: Transform, ctx: Context | None = None) -> tuple[DataFrame, int]:
    """The changed store, and how many rows the change picked."""
    t.validate()
    verb, scope = ACTIONS[t.action]
    pick = Pick(t.workspace_id, t.hashes if scope == "specific" else None, t.query if scope == "query" else None, ctx, t.key)
    affected = pick.mark(store).where("_picked").count()
    if verb == "delete":
        return delete(store, pick), affected
    if verb in ("move", "copy"):
        return {"move": move, "copy": copy}[verb](store, pick, t.target), affected
    return {"tag": tag, "untag": untag}[verb](store, pick, t.tag), affected


def result_counts(workspaces: DataFrame, store: DataFrame) -> DataFrame:
    """workspace_id, result_count; 0 where there are none."""
    n = store.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))
    return workspaces.select("workspace_id").join(n, "workspace_id", "left").select("workspace_id", F.coalesce("n", F.lit(0)).alias("result_count"))


def account_stats(stats: DataFrame, keys: DataFrame, account: str, *, offset: int = 0, limit: int = 100) -> DataFrame:
    """Query statistics of the workspaces that an account has keys for, newest first."""
    if offset < 0 or not 1 <= limit <= 250:
        raise InvalidRequest("offset must be 0 or more and limit from 1 to 250")
    own = keys.where(F.col("account") == account).select("workspace_id").distinct()
    return stats.join(own, "workspace_id").orderBy(F.col("sequence").desc()).offset(offset).limit(limit)


def permitted(permissions: Column, *flags: int) -> Column:
    """Whether any of the flags is set."""
    return permissions.bitwiseAND(F.lit(sum(flags))) != 0


def social(results: DataFrame, blobs: DataFrame) -> DataFrame:
    """Results with author, image, type and site name from their stored page, if there is one."""
    from ..functions.html import html_view

    seen = blobs.join(results.select("data_hash").distinct(), "data_hash", "left_semi").select("data_hash", html_view("data")["props"].alias("_p"))
    og = lambda k: F.try_element_at("_p", F.lit(k))
    return results.join(seen, "data_hash", "left").select(
        "uri_hash", "uri", "title", "description", "tags", "created", "updated",
        F.coalesce(og("og_author"), og("article_author")).alias("author"), og("og_image").alias("image_url"), og("og_type").alias("result_type"), og("og_site_name").alias("site_name"),
    )


def save(store: DataFrame, path: str) -> None:
    """Write a store by workspace, replacing only the workspaces it holds."""
    store.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id").parquet(path)
