"""The commit log: typed Parquet files for each commit and type, and one manifest for each commit.

    engine.json               the engine's version
    manifests/<commit>.json   id, created_at, metadata, and for each type its folder, rows and files with their SHA-256;
                              creating it publishes
    data/<kind>/<type>/...    Parquet: identity, commit_id, schema_version_id, seq, fields
    schemas/<kind>/<type>/<version>.json, layouts.json, dropped.json
    index/<kind>/<type>.json  which files hold which commits, older entries in files beside it; advisory, as manifests say it too
    lock.json                 the write lease

Nothing of a commit is visible before its manifest is, and a manifest is created by one step of the store: a link on
a local disk, a conditional create on an object store, a rename that refuses an existing target elsewhere. So writers
that race cannot both publish a commit. A writer also says which head its rows were made against; if the head has
moved since, it publishes nothing, however its lease on the lock stands. Reads take their files from the index, or from the manifests where it
lags, so only files of the wanted commits are opened.
"""

from __future__ import annotations

import atexit
import datetime as dt
import json
import math
import os
import shutil
import tempfile
import threading
import time
import uuid
from bisect import bisect_right
from itertools import accumulate
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConcurrentWriteError, HeadMismatchError, LockContentionError, SchemaOutdatedError, StorageBackendError, UninitializedStorageError
from ..model import Entity, schema_hash
from ..operators import temporal
from ..plans.query import Layout, QueryBuilder
from ..types import FieldType, struct_of
from .files import Files

ENGINE = "v2"
#: Entries of a type's index file; older ones are sealed in files of as many.
INDEX_ENTRIES = 256
#: Manifests that the driver reads one by one; executors read more.
MANIFESTS_AT_ONCE = 64
#: Identities that are broadcast at most, some 10 MB.
BROADCAST_KEYS = 100_000


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def keys_of(kind: str) -> tuple[str, ...]:
    return temporal.ENTITY_KEY if kind == "entity" else temporal.RELATION_KEY


def history_schema(kind: str, payload: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(k, T.StringType()) for k in keys_of(kind)]
        + [T.StructField("commit_id", T.LongType()), T.StructField("schema_version_id", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("fields", payload)]
    )


def payload_of(schema: dict[str, Any]) -> T.StructType:
    """The Spark struct of a stored schema."""
    return struct_of({n: FieldType.from_spec(s) for n, s in schema["fields"].items()})


def parse_uri(uri: str, shared: str | None = None) -> str:
    """The folder of a datastore: a path, or a URI of any store that Spark reads.

    ':memory:' is a new temporary one, below the folder that executors share if there is one.
    """
    if uri == ":memory:":
        if shared:
            return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"
        own = tempfile.mkdtemp(prefix="store-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}"
    if "://" in uri:
        scheme, _, rest = uri.partition("://")
        if scheme == "s3":
            return f"s3a://{rest}"
        if scheme == "sqlite":
            raise StorageBackendError("open", "this engine stores Parquet folders; give a path or a store's URI")
        return uri
    return uri if uri.startswith("file:") else "file://" + os.path.abspath(uri)


class LeaseKeeper(threading.Thread):
    """Renews a lock while what it protects runs."""

    def __init__(self, store: Store, owner: str, lease_ms: int):
        super().__init__(daemon=True)
        self.store, self.owner, self.lease_ms = store, owner, lease_ms
        self.done = threading.Event()

    def run(self) -> None:
        while not self.done.wait(self.lease_ms / 3000):
            self.store.renew_lock(self.owner, self.lease_ms)


class Store:
    """One datastore. Also a provider of histories for queries."""

    def __init__(self, spark: SparkSession, uri: str, create: bool = True):
        self.spark, self.uri = spark, uri
        if uri == ":memory:" and not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise StorageBackendError("open", "a cluster needs a shared folder (spark.checkpoint.dir) for a temporary store")
        self.files = Files(spark, parse_uri(uri, spark.conf.get("spark.checkpoint.dir", None)))
        self._engine = self.files.read_json("engine.json")
        if self._engine is None:
            if not create:
                raise UninitializedStorageError(uri)
            self.initialise()
        if self._engine.get("engine") != ENGINE:
            raise StorageBackendError("open", f"{uri} was written by engine {self._engine.get('engine')!r}, and this is {ENGINE!r}")
        self._manifests: dict[int, dict[str, Any]] = {}

    # --- set up ------------------------------------------------------------------------------------------------

    def initialise(self, force: bool = False) -> dict[str, Any]:
        """An empty datastore; with force what was there goes."""
        if force:
            for name in self.files.names(""):
                self.files.delete(name)
        if not self.files.create_json("engine.json", {"engine": ENGINE, "created_at": now().isoformat()}) and not force:
            raise StorageBackendError("init", f"{self.uri} is initialised already")
        self._engine = self.files.read_json("engine.json")
        return self._engine

    def info(self) -> dict[str, Any]:
        layouts = self.layouts()
        return {
            "backend": "parquet",
            "uri": self.uri,
            "engine_version": self._engine["engine"],
            "head_commit_id": self.head(),
            "current_layouts": [x for x in layouts if x["is_current"]],
            "historical_layouts": [x for x in layouts if not x["is_current"]],
        }

    # --- the lock ----------------------------------------------------------------------------------------------

    def acquire_lock(self, owner: str, timeout_ms: int = 5000, lease_ms: int = 30_000) -> bool:
        end = time.monotonic() + timeout_ms / 1000
        while True:
            lease = {"owner": owner, "until": (now() + dt.timedelta(milliseconds=lease_ms)).isoformat()}
            held = self.files.read_json("lock.json")
            if held is not None and (held["owner"] == owner or dt.datetime.fromisoformat(held["until"]) < now()):
                self.files.take("lock.json", held)  # mine, or ended
                held = None
            if held is None and self.files.claim("lock.json", lease):
                return True
            if time.monotonic() >= end:
                return False
            time.sleep(0.05)

    def renew_lock(self, owner: str, lease_ms: int = 30_000) -> bool:
        held = self.files.read_json("lock.json")
        if held is None or held["owner"] != owner:
            return False
        self.files.write_json("lock.json", {"owner": owner, "until": (now() + dt.timedelta(milliseconds=lease_ms)).isoformat()})
        return True

    def release_lock(self, owner: str) -> None:
        held = self.files.read_json("lock.json")
        if held is not None and held["owner"] == owner:
            self.files.take("lock.json", held)

    def locked(self, owner: str, timeout_ms: int = 5000, lease_ms: int = 30_000):
        """A context in which the lock is held, and its lease renewed."""
        store = self

        class Held:
            def __enter__(self):
                if not store.acquire_lock(owner, timeout_ms, lease_ms):
                    raise LockContentionError(timeout_ms)
                self.keeper = LeaseKeeper(store, owner, lease_ms)
                self.keeper.start()

            def __exit__(self, *_):
                self.keeper.done.set()
                self.keeper.join()
                store.release_lock(owner)

        return Held()

    # --- commits -----------------------------------------------------------------------------------------------

    def commit_ids(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json")]

    def head(self) -> int | None:
        ids = self.commit_ids()
        return ids[-1] if ids else None

    def manifest(self, commit_id: int) -> dict[str, Any] | None:
        if commit_id not in self._manifests:
            found = self.files.read_json(f"manifests/{commit_id:012d}.json")
            if found is None:
                return None
            self._manifests[commit_id] = found  # manifests never change
        return self._manifests[commit_id]

    def publish(self, rows: dict[tuple[str, str], tuple[DataFrame, int]], metadata: dict[str, Any], made_at: int | None = None) -> int:
        """Appends one commit: for each (kind, type name) its rows (identity, seq, fields) and schema version.

        made_at: the head (0: none) that the rows were made against; an error if it is not the head any more.
        """
        head = self.head() or 0
        if made_at is not None and made_at != head:
            raise HeadMismatchError
        commit_id = head + 1
        written = []
        for (kind, name), (df, version) in sorted(rows.items()):
            path = f"data/{kind}/{name}/c{commit_id:012d}-{uuid.uuid4().hex[:8]}"
            whole = df.select(*keys_of(kind), F.lit(commit_id).cast("long").alias("commit_id"), F.lit(version).cast("int").alias("schema_version_id"), F.col("seq").cast("long"), "fields")
            whole.write.parquet(f"{self.files.root}/{path}")
            written.append({"kind": kind, "type_name": name, "schema_version_id": version, "path": path} | self._described(path))
        manifest = {"id": commit_id, "created_at": now().isoformat(), "metadata": metadata, "types": written}
        if not self.files.create_json(f"manifests/{commit_id:012d}.json", manifest):
            for w in written:
                self.files.delete(w["path"])
            raise HeadMismatchError
        for w in written:
            self._activate(w["kind"], w["type_name"], w["schema_version_id"], commit_id)
            self._index(w["kind"], w["type_name"], commit_id, w["path"])
        return commit_id

    def _described(self, path: str) -> dict[str, Any]:
        """The rows of a written folder and its files' lengths and SHA-256, which executors compute."""
        whole = f"{self.files.root}/{path}"
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(whole)
        named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        return {"rows": self.spark.read.parquet(whole).count(), "files": [r.asDict() for r in named.orderBy("name").collect()]}

    def verify_files(self, commit_id: int) -> list[str]:
        """The folders of a commit whose files are not as its manifest says."""
        return [t["path"] for t in (self.manifest(commit_id) or {"types": []})["types"] if {k: t.get(k) for k in ("rows", "files")} != self._described(t["path"])]

    def commits_df(self) -> DataFrame:
        """id, created_at, metadata (JSON text) of all commits."""
        rows = [(m["id"], m["created_at"], json.dumps(m["metadata"], sort_keys=True)) for m in map(self.manifest, self.commit_ids())]
        return self.spark.createDataFrame(rows, "id long, created_at string, metadata string")

    def list_commits(self, limit: int = 10, since_commit_id: int | None = None) -> list[dict[str, Any]]:
        """Newest first."""
        ids = [i for i in self.commit_ids() if since_commit_id is None or i > since_commit_id]
        return [{k: self.manifest(i)[k] for k in ("id", "created_at", "metadata")} for i in ids[::-1][:limit]]

    def get_commit(self, commit_id: int) -> dict[str, Any] | None:
        m = self.manifest(commit_id)
        return None if m is None else {k: m[k] for k in ("id", "created_at", "metadata")}

    def changes_df(self, commit_id: int) -> DataFrame | None:
        """type_kind, type_name, key / left_key, right_key, instance_key, operation of a commit; entities first."""
        out = None
        for t in sorted((self.manifest(commit_id) or {"types": []})["types"], key=lambda t: (t["kind"], t["type_name"])):
            key = keys_of(t["kind"])
            found = temporal.changes(self.raw_history(t["kind"], t["type_name"], upper=commit_id, identity_only=True), commit_id, key)
            found = found.select(F.lit(t["kind"]).alias("type_kind"), F.lit(t["type_name"]).alias("type_name"), *key, "operation").distinct()
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
        return out

    def list_commit_changes(self, commit_id: int) -> list[dict[str, Any]]:
        df = self.changes_df(commit_id)
        return [] if df is None else [{k: v for k, v in r.asDict().items() if v is not None} for r in df.orderBy(*df.columns).collect()]

    def count_commit_operations(self, commit_id: int) -> int:
        df = self.changes_df(commit_id)
        return 0 if df is None else df.count()

    # --- which files hold which commits --------------------------------------------------------------------------

    def _index_name(self, kind: str, name: str) -> str:
        return f"index/{kind}/{name}.json"

    def _read_index(self, kind: str, name: str) -> dict[str, Any]:
        """The newest entries, and the files in which each INDEX_ENTRIES older ones are sealed."""
        return {"sealed": [], "entries": [], "max_indexed_commit": 0} | (self.files.read_json(self._index_name(kind, name)) or {})

    def _index(self, kind: str, name: str, commit_id: int, path: str) -> None:
        """Best effort: a reader that finds the index behind the head takes the manifests."""
        found = self._read_index(kind, name)
        if found["max_indexed_commit"] < commit_id - 1:  # repairs what is missing below
            found["entries"] += self._entries(kind, name, found["max_indexed_commit"], commit_id - 1)
        found["entries"].append({"min_commit_id": commit_id, "max_commit_id": commit_id, "path": path})
        found["max_indexed_commit"] = commit_id
        self._write_index(kind, name, found)

    def _write_index(self, kind: str, name: str, index: dict[str, Any]) -> None:
        """A commit writes at most INDEX_ENTRIES entries, however many there are."""
        while len(index["entries"]) > INDEX_ENTRIES:
            full, index["entries"] = index["entries"][:INDEX_ENTRIES], index["entries"][INDEX_ENTRIES:]
            part = {"min_commit_id": min(e["min_commit_id"] for e in full), "max_commit_id": max(e["max_commit_id"] for e in full), "file": f"index/{kind}/{name}/{uuid.uuid4().hex}.json"}
            self.files.write_json(part["file"], full)
            index["sealed"].append(part)
        self.files.write_json(self._index_name(kind, name), index)

    def _sealed(self, index: dict[str, Any], lower: int | None = None, upper: int | None = None) -> list[tuple[dict[str, Any], list[dict[str, Any]] | None]]:
        """The sealed files that touch commits of (lower, upper], each with its entries; None if it is lost."""
        parts = [p for p in index["sealed"] if (lower is None or p["max_commit_id"] > lower) and (upper is None or p["min_commit_id"] <= upper)]
        return [(p, self.files.read_json(p["file"])) for p in parts]

    def _entries(self, kind: str, name: str, lower: int = 0, upper: int | None = None) -> list[dict[str, Any]]:
        """From the manifests of (lower, upper]; very many are read by executors."""
        ids = [i for i in self.commit_ids() if i > lower and (upper is None or i <= upper)]
        if sum(i not in self._manifests for i in ids) <= MANIFESTS_AT_ONCE:
            found = [(i, t["path"]) for i in ids for t in self.manifest(i)["types"] if (t["kind"], t["type_name"]) == (kind, name)]
        else:
            texts = self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.files.root}/manifests")
            read = texts.select(F.from_json("value", "id long, types array<struct<kind: string, type_name: string, path: string>>").alias("m"))
            read = read.where((F.col("m.id") > lower) & (F.col("m.id") <= ids[-1])).select("m.id", F.explode("m.types").alias("t"))
            found = sorted((r["id"], r["path"]) for r in read.where((F.col("t.kind") == kind) & (F.col("t.type_name") == name)).select("id", "t.path").collect())
        return [{"min_commit_id": i, "max_commit_id": i, "path": path} for i, path in found]

    def entries(self, kind: str, name: str, lower: int | None = None, upper: int | None = None) -> list[dict[str, Any]]:
        """The files that hold commits of (lower, upper]."""
        index = self._read_index(kind, name)
        out = []
        for part, held in self._sealed(index, lower, upper):
            out += self._entries(kind, name, part["min_commit_id"] - 1, part["max_commit_id"]) if held is None else held
        out += index["entries"]
        if (self.head() or 0) > index["max_indexed_commit"]:
            out += self._entries(kind, name, index["max_indexed_commit"], upper)
        purged = (self.files.read_json("dropped.json") or {}).get(f"{kind}/{name}", {})
        return [e for e in out if (lower is None or e["max_commit_id"] > lower) and (upper is None or e["min_commit_id"] <= upper) and e["max_commit_id"] > purged.get("purged_to", 0)]

    def verify_index(self, kind: str | None = None, name: str | None = None) -> list[dict[str, Any]]:
        """For each type whether its index says what the manifests say."""
        out = []
        for k, n in self.types():
            if (kind and k != kind) or (name and n != name):
                continue
            index = self._read_index(k, n)
            parts = self._sealed(index)
            held = [e for _, entries in parts for e in entries or []] + index["entries"]
            spans = sorted((e["min_commit_id"], e["max_commit_id"]) for e in held)
            # The furthest end of the spans that begin up to a commit says whether one covers it.
            ends = list(accumulate((end for _, end in spans), max))
            missing = [i for i in sorted({e["min_commit_id"] for e in self._entries(k, n)}) if not (at := bisect_right(spans, (i, math.inf))) or ends[at - 1] < i]
            lost = [p["file"] for p, entries in parts if entries is None] + [e["path"] for e in held if not self.files.exists(e["path"])]
            out.append({"kind": k, "type_name": n, "ok": not missing and not lost, "missing_commits": missing, "missing_files": lost})
        return out

    def repair_index(self, apply: bool = True) -> list[dict[str, Any]]:
        """Rebuilds from the manifests the indexes that verify_index finds wrong."""
        wrong = [x for x in self.verify_index() if not x["ok"]]
        if apply:
            for x in wrong:
                entries = self._entries(x["kind"], x["type_name"])
                self._write_index(x["kind"], x["type_name"], {"sealed": [], "entries": entries, "max_indexed_commit": max((e["max_commit_id"] for e in entries), default=0)})
        return wrong

    def compact(self, type_name: str | None = None, apply: bool = False, target_rows: int = 5_000_000) -> list[dict[str, Any]]:
        """Merges the files of many commits into one snapshot for each type and schema; all versions stay."""
        out = []
        for kind, name in self.types():
            if type_name and name != type_name:
                continue
            head = self.head() or 0  # commits that come meanwhile are behind the new index, so readers find them in the manifests
            entries = self.entries(kind, name, upper=head)
            plan = {"kind": kind, "type_name": name, "files": len(entries), "applied": False}
            out.append(plan)
            if not apply or len(entries) < 2:
                continue
            low, high = min(e["min_commit_id"] for e in entries), max(e["max_commit_id"] for e in entries)
            payload = payload_of(self.current_schema(kind, name)["schema"])
            versions = sorted({self.manifest(i)["types"][j]["schema_version_id"] for i in self.commit_ids() for j, t in enumerate(self.manifest(i)["types"]) if t["type_name"] == name and t["kind"] == kind})
            merged = []
            for version in versions:  # versions differ in their fields, so each has its own snapshot
                stored = self.schema_version(kind, name, version)
                shape = payload_of(stored["schema"]) if stored else payload
                part = self.raw_history(kind, name, upper=high, payload=shape).where(F.col("schema_version_id") == version)
                path = f"data/{kind}/{name}/snapshot-{high:012d}-{version}-{uuid.uuid4().hex[:8]}"
                rows = part.count()
                part.repartitionByRange(max(1, rows // target_rows), *keys_of(kind)).sortWithinPartitions(*keys_of(kind), "commit_id").write.parquet(f"{self.files.root}/{path}")
                merged.append({"min_commit_id": low, "max_commit_id": high, "path": path})
            self._write_index(kind, name, {"sealed": [], "entries": merged, "max_indexed_commit": head})
            plan["applied"] = True
        return out

    # --- histories -----------------------------------------------------------------------------------------------

    def raw_history(self, kind: str, name: str, lower: int | None = None, upper: int | None = None, payload: T.StructType | None = None, identity_only: bool = False) -> DataFrame:
        """All versions, of every schema version; fields that a file lacks are null."""
        if payload is None:
            payload = struct_of({}) if identity_only else payload_of(self.current_schema(kind, name)["schema"])
        schema = history_schema(kind, payload)
        if identity_only:
            schema = T.StructType([f for f in schema.fields if f.name != "fields"])
        paths = [f"{self.files.root}/{e['path']}" for e in self.entries(kind, name, lower, upper)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*paths)
        if lower is not None:
            df = df.where(F.col("commit_id") > lower)
        return df if upper is None else df.where(F.col("commit_id") <= upper)

    def history(self, cls: type, lower: int | None = None, upper: int | None = None) -> DataFrame:
        return self.raw_history(cls.kind, cls.type_name, lower, upper, cls.payload())

    def latest_rows(self, cls: type, only: DataFrame | None = None, n_only: int | None = None, upper: int | None = None) -> DataFrame:
        """The newest version of each identity, of any schema version, up to a commit; with `only` of its identities.

        n_only: how many rows `only` has, if that is known. A few go to the scan by broadcast, so that the rest of
        the history is not shuffled.
        """
        rows, key = self.history(cls, upper=upper), keys_of(cls.kind)
        if only is not None:
            keys = only.select(*key)
            if n_only is not None and n_only <= BROADCAST_KEYS:
                keys = F.broadcast(keys)
            rows = rows.join(keys, list(key), "left_semi")
        return temporal.latest(rows, key)

    def point(self, cls: type, *key: str) -> dict[str, Any] | None:
        """The newest version of one identity: the key is pushed to the scan."""
        df = self.history(cls)
        for name, value in zip(keys_of(cls.kind), (*key, "")[: len(keys_of(cls.kind))], strict=True):
            df = df.where(F.col(name) == value)
        row = df.orderBy(F.desc("commit_id"), F.desc("seq")).first()
        return None if row is None else row.asDict(recursive=True)

    def latest_batches(self, cls: type, batch_size: int = 1000):
        """The latest rows in order of identity, in lists of batch_size; never more than a partition at once."""
        held = []
        for row in self.latest_rows(cls).orderBy(*keys_of(cls.kind)).toLocalIterator():
            held.append(row.asDict(recursive=True))
            if len(held) == batch_size:
                yield held
                held = []
        if held:
            yield held

    def count_latest(self, cls: type) -> int:
        return temporal.distinct_identities(self.history(cls), keys_of(cls.kind)).first()[0]

    def query(self) -> QueryBuilder:
        return QueryBuilder(self)

    # --- schemas ---------------------------------------------------------------------------------------------------

    def types(self) -> list[tuple[str, str]]:
        return [(k, n) for k in ("entity", "relation") for n in self.files.names(f"schemas/{k}") if not self._is_dropped(k, n)]

    def _is_dropped(self, kind: str, name: str) -> bool:
        return (self.files.read_json("dropped.json") or {}).get(f"{kind}/{name}", {}).get("dropped", False)

    def list_schemas(self, kind: str | None = None) -> list[dict[str, Any]]:
        return [self.current_schema(k, n) for k, n in self.types() if kind in (None, k)]

    def schema_versions(self, kind: str, name: str) -> list[dict[str, Any]]:
        return [self.files.read_json(f"schemas/{kind}/{name}/{n}") for n in self.files.names(f"schemas/{kind}/{name}") if n.endswith(".json")]

    def schema_version(self, kind: str, name: str, version: int) -> dict[str, Any] | None:
        return self.files.read_json(f"schemas/{kind}/{name}/{version:06d}.json")

    def current_schema(self, kind: str, name: str) -> dict[str, Any] | None:
        if self._is_dropped(kind, name):
            return None
        found = self.schema_versions(kind, name)
        return found[-1] if found else None

    def add_schema(self, cls: type) -> int:
        version = len(self.schema_versions(cls.kind, cls.type_name)) + 1
        value = {"kind": cls.kind, "type_name": cls.type_name, "schema_version_id": version, "schema": cls.schema(), "hash": schema_hash(cls.schema()), "created_at": now().isoformat()}
        if not self.files.create_json(f"schemas/{cls.kind}/{cls.type_name}/{version:06d}.json", value):
            raise ConcurrentWriteError
        dropped = self.files.read_json("dropped.json") or {}
        if dropped.get(f"{cls.kind}/{cls.type_name}", {}).get("dropped"):
            dropped[f"{cls.kind}/{cls.type_name}"]["dropped"] = False
            self.files.write_json("dropped.json", dropped)
        return version

    def layouts(self) -> list[dict[str, Any]]:
        return self.files.read_json("layouts.json") or []

    def _activate(self, kind: str, name: str, version: int, commit_id: int) -> None:
        """A schema version holds from its first commit on."""
        all_ = self.layouts()
        mine = [x for x in all_ if (x["kind"], x["type_name"]) == (kind, name)]
        if any(x["schema_version_id"] == version for x in mine):
            return
        for x in mine:
            x["is_current"] = False
        all_.append({"kind": kind, "type_name": name, "schema_version_id": version, "activation_commit_id": commit_id, "is_current": True})
        self.files.write_json("layouts.json", all_)

    def layout(self, cls: type) -> Layout | None:
        """The version that reads of the class see; None if the type is not registered."""
        current = self.current_schema(cls.kind, cls.type_name)
        if current is None:
            return None
        mine = [x for x in self.layouts() if (x["kind"], x["type_name"]) == (cls.kind, cls.type_name)]
        active = next((x for x in mine if x["is_current"]), None)
        # A commit holds an identity once, so what one commit wrote has one version of each.
        entries = self.entries(cls.kind, cls.type_name)
        single = len(entries) <= 1 and all(e["min_commit_id"] == e["max_commit_id"] for e in entries)
        if active is None:
            return Layout(current["schema_version_id"], 0, single)
        return Layout(active["schema_version_id"], active["activation_commit_id"], single)

    def assert_current(self, cls: type, version: int) -> None:
        """An error if the stored schema moved on since it was validated."""
        current = self.current_schema(cls.kind, cls.type_name)
        if current is None or current["schema_version_id"] != version or current["hash"] != cls.schema_hash():
            from ..schema import diff

            raise SchemaOutdatedError([diff(cls, current)])

    def dependents(self, name: str) -> list[str]:
        """The relation types that an entity type is an endpoint of."""
        return [s["type_name"] for s in self.list_schemas("relation") if name in (s["schema"]["left"], s["schema"]["right"])]

    def drop_type(self, kind: str, name: str, purge_history: bool = False) -> int:
        """Removes a type's schema, and with purge_history its versions, in a commit of its own."""
        commit_id = self.publish({}, {"operation": "schema_drop", "type_kind": kind, "type_name": name, "purge_history": purge_history})
        dropped = self.files.read_json("dropped.json") or {}
        entry = dropped.setdefault(f"{kind}/{name}", {})
        entry["dropped"] = True
        if purge_history:
            entry["purged_to"] = commit_id
            self.files.delete(f"data/{kind}/{name}")
            self.files.delete(self._index_name(kind, name))
            self.files.delete(f"index/{kind}/{name}")
        self.files.write_json("dropped.json", dropped)
        self.files.write_json("layouts.json", [x for x in self.layouts() if (x["kind"], x["type_name"]) != (kind, name)])
        return commit_id


def expected_rows(spark: SparkSession, cls: type, objects: list[Any]) -> DataFrame:
    """Objects as expected state: identity, seq, fields."""
    fields = cls.data_fields()
    rows = []
    for seq, obj in enumerate(objects):
        payload = tuple(f.type.to_row(obj.__dict__[n]) for n, f in fields.items()) or (None,)
        key = (obj.key,) if issubclass(cls, Entity) else (str(obj.left_key), str(obj.right_key), obj.instance_key)
        rows.append((*key, seq, payload))
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys_of(cls.kind)], T.StructField("seq", T.LongType()), T.StructField("fields", cls.payload())])
    return spark.createDataFrame(rows, schema)
