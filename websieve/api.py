"""The engine's services in one process: accounts, keys, workspaces, results, blobs, parsing.

Small records live in the driver; results and blobs are DataFrames.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidRequest, NotFound, PermissionDenied, RevisionConflict
from .functions.hashing import HashRange
from .operators import store as results
from .operators.standing import Standing
from .plans.compiler import Context
from .plans.explain import Explanation, explain, supported_filters
from .scratch import written
from .sources import blobs

MIN_ACCOUNT = 12
WELL_KNOWN = "wellknown"


@dataclass(frozen=True)
class Account:
    name: str
    created: datetime
    active: bool = True


@dataclass(frozen=True)
class Workspace:
    workspace_id: str
    name: str
    query_text: str = ""
    description: str = ""
    active: bool = True
    well_known: bool = False
    revision: int = 0


@dataclass(frozen=True)
class AccessKey:
    key_id: str
    workspace_id: str
    account: str
    permissions: int
    expiry: datetime | None = None
    revision: int = 0


@dataclass(frozen=True)
class Server:
    server_id: str
    name: str
    scope: HashRange = HashRange()
    approved: bool = False


@dataclass
class Engine:
    """All services over one result store and one blob store.

    Each change is written to the shared folder and read back, so plans stay short and a result
    stays what it was when it was posted.
    """

    spark: SparkSession
    store: DataFrame
    blob_store: DataFrame
    accounts: dict[str, Account] = field(default_factory=dict)
    properties: dict[tuple[str, str], str] = field(default_factory=dict)
    workspaces: dict[str, Workspace] = field(default_factory=dict)
    keys: dict[str, AccessKey] = field(default_factory=dict)
    servers: dict[str, Server] = field(default_factory=dict)
    stats: DataFrame | None = None

    # accounts
    def create_account(self, name: str) -> Account:
        if len(name) < MIN_ACCOUNT or name == WELL_KNOWN:
            raise InvalidRequest(f"an account's name has at least {MIN_ACCOUNT} characters and isn't {WELL_KNOWN}")
        return self.accounts.setdefault(name, Account(name, datetime.now(timezone.utc)))

    def account(self, name: str) -> Account:
        return _found(self.accounts, name)

    def delete_account(self, name: str) -> None:
        self.account(name)
        del self.accounts[name]

    def set_property(self, account: str, key: str, value: str) -> None:
        self.account(account)
        self.properties[account, key] = value

    def account_properties(self, account: str) -> dict[str, str]:
        return {k: v for (a, k), v in self.properties.items() if a == account}

    def delete_property(self, account: str, key: str) -> None:
        _found(self.properties, (account, key))
        del self.properties[account, key]

    # keys and workspaces
    def create_key(self, account: str, name: str, query_text: str = "", permissions: int = results.OWNER | results.MANAGE | results.READ | results.WRITE) -> AccessKey:
        """A key to a new workspace."""
        self.account(account)
        w = Workspace(str(uuid.uuid4()), name, query_text)
        self.workspaces[w.workspace_id] = w
        key = AccessKey(str(uuid.uuid4()), w.workspace_id, account, permissions)
        self.keys[key.key_id] = key
        return key

    def share_key(self, key_id: str, account: str, permissions: int) -> AccessKey:
        key = AccessKey(str(uuid.uuid4()), self.allowed(key_id, results.OWNER, results.MANAGE).workspace_id, account, permissions)
        self.keys[key.key_id] = key
        return key

    def delete_key(self, key_id: str) -> None:
        _found(self.keys, key_id)
        del self.keys[key_id]

    def allowed(self, key_id: str, *flags: int) -> AccessKey:
        key = _found(self.keys, key_id)
        if not any(key.permissions & f for f in flags) or (key.expiry and key.expiry < datetime.now(timezone.utc)):
            raise PermissionDenied(key_id)
        return key

    def update_workspace(self, key_id: str, revision: int, **changes) -> Workspace:
        """Change name, query_text, description, active or well_known, based on a revision."""
        w = self.workspaces[self.allowed(key_id, results.OWNER, results.MANAGE).workspace_id]
        if w.revision != revision:
            raise RevisionConflict(f"revision {w.revision} is current")
        if unknown := set(changes) - {"name", "query_text", "description", "active", "well_known"}:
            raise InvalidRequest(f"can't change {', '.join(sorted(unknown))}")
        self.workspaces[w.workspace_id] = replace(w, **changes, revision=w.revision + 1)
        return self.workspaces[w.workspace_id]

    def well_known(self) -> list[Workspace]:
        return [w for w in self.workspaces.values() if w.well_known]

    def context(self, **more) -> Context:
        """Queries of all keys, for query(key) filters."""
        return Context(workspaces={k.key_id: self.workspaces[k.workspace_id].query_text for k in self.keys.values()}, **more)

    def standing(self, **more) -> Standing:
        return Standing({w.workspace_id: w.query_text for w in self.workspaces.values() if w.active}, self.context(**more))

    # results
    def list_results(self, key_id: str, **how) -> results.Listing:
        return results.list_results(self.store, self.allowed(key_id, results.OWNER, results.READ, results.MANAGE).workspace_id, ctx=self.context(), **how)

    def social_results(self, key_id: str, **how) -> DataFrame:
        return results.social(self.list_results(key_id, **how).results, self.blob_store)

    def random_results(self, key_id: str, count: int, above: float = 0.5) -> DataFrame:
        return results.random_results(self.store, self.allowed(key_id, results.OWNER, results.READ).workspace_id, above, count)

    def post_results(self, key_id: str, rows: DataFrame) -> None:
        workspace_id = self.allowed(key_id, results.OWNER, results.WRITE).workspace_id
        self.store = written(results.upsert(self.store, rows.withColumn("workspace_id", F.lit(workspace_id))), "store")

    def transform(self, key_id: str, action: str, *, target_key: str | None = None, **what) -> int:
        """Change results; returns how many rows were picked."""
        own = self.allowed(key_id, results.OWNER, results.MANAGE, results.WRITE).workspace_id
        target = self.allowed(target_key, results.OWNER, results.WRITE).workspace_id if target_key else None
        changed, affected = results.transform(self.store, results.Transform(action, own, target=target, **what), self.context())
        self.store = written(changed, "store")
        return affected

    def account_stats(self, account: str, offset: int = 0, limit: int = 100) -> DataFrame:
        if self.stats is None:
            raise NotFound("no statistics yet")
        rows = [(k.workspace_id, k.account) for k in self.keys.values()]
        return results.account_stats(self.stats, self.spark.createDataFrame(rows, "workspace_id string, account string"), account, offset=offset, limit=limit)

    def post_stats(self, rows: DataFrame) -> None:
        self.stats = written(rows if self.stats is None else self.stats.unionByName(rows), "stats")

    # blobs
    def put_blobs(self, data: DataFrame) -> None:
        new = written(blobs.missing_blobs(self.blob_store, blobs.blob_rows(data)), "blobs")
        self.blob_store = self.blob_store.unionByName(new)

    def blob(self, data_hash: str) -> bytes:
        row = blobs.get_blob(self.blob_store, data_hash).first()
        if row is None:
            raise NotFound(data_hash)
        return bytes(row.data)

    def blob_text(self, data_hash: str, **how) -> DataFrame:
        return blobs.page_text(self.blob_store, data_hash, **how)

    # parsing and servers
    def parse(self, text: str) -> Explanation:
        return explain(text, self.context())

    def supported_filters(self) -> list[tuple[str, str, str, float]]:
        return supported_filters()

    def register_server(self, name: str, scope: HashRange = HashRange()) -> Server:
        """A server node; registering a name again changes nothing."""
        return self.servers.setdefault(name, Server(str(uuid.uuid4()), name, scope))

    def server(self, name: str) -> Server:
        return _found(self.servers, name)


def _found(table: dict, key):
    if key not in table:
        raise NotFound(key)
    return table[key]
