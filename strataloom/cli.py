"""Command line: python -m strataloom.cli --store URI --models MODULE COMMAND ...

Exit codes: 0 done, 1 failed, 2 usage, 3 nothing stored there, 4 schema outdated, 5 conflict or contention,
6 token, 7 not found.
"""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import importlib
import importlib.util
import json
import os
import re
import sys
import tomllib
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession

from . import errors, schema
from .config import Config
from .expressions import Comparison, Filter, reference
from .model import Entity, Relation
from .session import Session
from .sources import jsonl
from .sources.store import Store, now, parse_uri

_OPS = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in", "is_null": "is_null"}


class Usage(Exception):
    pass


class NotFound(Exception):
    pass


def load_models(name: str | None) -> dict[str, type]:
    """The entity and relation classes of a module, or of a Python file."""
    if not name:
        return {}
    if name.endswith(".py"):
        spec = importlib.util.spec_from_file_location("strataloom_models_" + hashlib.sha256(name.encode()).hexdigest()[:8], name)
        module = sys.modules[spec.name] = importlib.util.module_from_spec(spec)  # annotations resolve there
        spec.loader.exec_module(module)
    else:
        module = importlib.import_module(name)
    return {c.type_name: c for c in vars(module).values() if isinstance(c, type) and issubclass(c, Entity | Relation) and c not in (Entity, Relation)}


def filters(triples: list[list[str]]) -> Filter | None:
    """PATH OP JSON triples, all of which must hold."""
    out = None
    for path, op, text in triples:
        ref = reference(path, endpoints=True)
        if op not in _OPS:
            raise Usage(f"unknown operator {op!r}; one of {', '.join(_OPS)}")
        value = json.loads(text)
        if op == "is_null":
            part = Comparison(ref, "is_null" if value else "is_not_null")
        else:
            part = Comparison(ref, _OPS[op], value)
        out = part if out is None else out & part
    return out


def shown(rows: list[dict[str, Any]], as_json: bool) -> str:
    """A table with aligned columns, or JSON."""
    if as_json:
        return json.dumps(rows, default=str)
    if not rows:
        return "(none)"
    names = list(dict.fromkeys(k for r in rows for k in r))
    cells = [names, *[["" if r.get(n) is None else str(r[n]) for n in names] for r in rows]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells)


def age(text: str) -> dt.datetime:
    """The time that 7d, 24h or 30m ago was."""
    m = re.fullmatch(r"(\d+)([dhm])", text)
    if not m:
        raise Usage(f"an age is a number with d, h or m, not {text!r}")
    return now() - dt.timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataloom")
    p.add_argument("--store", "--storage-uri", help="path or URI of the datastore; else STRATALOOM_STORE")
    p.add_argument("--db", help="path of the datastore; else STRATALOOM_DB")
    p.add_argument("--config", default=os.environ.get("STRATALOOM_CONFIG"), help="TOML or JSON file with settings of config.Config; else STRATALOOM_CONFIG")
    p.add_argument("--models", default=os.environ.get("STRATALOOM_MODELS"), help="module or .py file with entity and relation classes")
    p.add_argument("--namespace")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for flags, options in arguments:
            s.add_argument(*flags, **options)
        return s

    page = [(("--filter",), {"nargs": 3, "action": "append", "default": [], "metavar": ("PATH", "OP", "JSON")}), (("--as-of",), {"type": int}), (("--history-since",), {"type": int}), (("--with-history",), {"action": "store_true"}), (("--order-by",), {}), (("--desc",), {"action": "store_true"}), (("--limit",), {"type": int}), (("--offset",), {"type": int, "default": 0})]
    add("init", (("--force",), {"action": "store_true"}), (("--token",), {}))
    add("info")
    add("verify")
    add("entities", (("type",), {}), *page)
    add("relations", (("type",), {}), *page)
    add("traverse", (("type",), {}), (("--via",), {"action": "append", "required": True}), (("--filter",), page[0][1]), (("--without-relations",), {"action": "store_true"}))
    add("commits", (("--limit",), {"type": int, "default": 10}), (("--since",), {"type": int}), (("--meta",), {"action": "append", "default": []}))
    add("examine", (("commit_id",), {"type": int}))
    add("export", (("--output",), {"required": True}), (("--type",), {"action": "append"}), (("--as-of",), {"type": int}), (("--history-since",), {"type": int}), (("--with-metadata",), {"action": "store_true"}))
    add("import", (("input",), {}), (("--apply",), {"action": "store_true"}), (("--on-conflict",), {"choices": ["abort", "skip", "upsert"], "default": "abort"}), (("--precondition",), {}), (("--meta",), {"action": "append", "default": []}))
    add("schema-export", (("--from-store",), {"action": "store_true"}), (("--kind",), {"choices": ["entity", "relation"]}), (("--type",), {}), (("--version",), {"type": int}), (("--with-hash",), {"action": "store_true"}), (("--format",), {"choices": ["json", "yaml"], "default": "json"}), (("--output",), {}))
    add("schema-history", (("type",), {}))
    add("schema-drop", (("type",), {}), (("--purge-history",), {"action": "store_true"}), (("--with-dependents",), {"action": "store_true"}), (("--apply",), {"action": "store_true"}), (("--token",), {}))
    add("migrate", (("--apply",), {"action": "store_true"}), (("--token",), {}), (("--force",), {"action": "store_true"}), (("--upgraders",), {}))
    add("index-verify", (("--type",), {}))
    add("index-repair", (("--apply",), {"action": "store_true"}))
    add("compact", (("--type",), {}), (("--apply",), {"action": "store_true"}))
    add("namespaces")
    add("events", (("--status",), {}), (("--limit",), {"type": int, "default": 100}))
    add("sessions")
    add("dead-letters", (("--limit",), {"type": int, "default": 100}))
    add("event", (("event_id",), {}))
    add("replay", (("event_id",), {}))
    add("cleanup", (("--before",), {"default": "7d"}))
    return p


def _pairs(texts: list[str]) -> dict[str, str]:
    for t in texts:
        if "=" not in t:
            raise Usage(f"metadata is given as KEY=VALUE, not {t!r}")
    return dict(t.split("=", 1) for t in texts)


def drop_token(store: Store, types: list[tuple[str, str]], purge: bool) -> str:
    """Names one drop at one head."""
    return hashlib.sha256(f"{sorted(types)}/{purge}@{store.head()}".encode()).hexdigest()[:16]


def place(args: argparse.Namespace) -> str:
    """The datastore: what the command line names goes before the environment, and a URI there before a path."""
    if args.store and args.db and parse_uri(args.store) != parse_uri(args.db):
        raise Usage(f"--store and --db name different datastores: {args.store}, {args.db}")
    found = args.store or args.db or os.environ.get("STRATALOOM_STORE") or os.environ.get("STRATALOOM_DB")
    if not found:
        raise Usage("no datastore: give --store or --db, or set STRATALOOM_STORE")
    return found


def settings(path: str | None) -> Config:
    """Settings from a file of names and values."""
    if not path:
        return Config()
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        found = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    except OSError as e:
        raise Usage(f"the settings cannot be read: {e}") from e
    except ValueError as e:
        raise Usage(f"{path} is neither TOML nor JSON: {e}") from e
    if not isinstance(found, dict) or (unknown := found.keys() - {f.name for f in fields(Config)}):
        raise Usage(f"{path} has no settings" if not isinstance(found, dict) else f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**found)


def yaml(value: Any, indent: int = 0) -> str:
    """Nested dicts and lists as block YAML; scalars and empty ones as JSON, which YAML reads."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(k)}:" + (f"\n{yaml(v, indent + 1)}" if isinstance(v, dict | list) and v else f" {yaml(v)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{yaml(v, indent + 1)}" if isinstance(v, dict | list) and v else f" {yaml(v)}\n") for v in value)
    return json.dumps(value, default=str, ensure_ascii=False)


def exported_schemas(args: argparse.Namespace, store: Store, models: dict[str, type]) -> list[dict[str, Any]]:
    """The schemas of the models, or stored ones: the latest of all types, or a version of one."""
    if not args.from_store:
        if args.version is not None:
            raise Usage("--version is for stored schemas: give --from-store too")
        found = [{"kind": c.kind, "type_name": c.type_name, "schema": c.schema(), "hash": c.schema_hash()} for c in models.values()]
        found = [x for x in found if args.kind in (None, x["kind"]) and args.type in (None, x["type_name"])]
    else:
        types = [(k, n) for k, n in store.types() if args.kind in (None, k) and args.type in (None, n)]
        if args.version is not None and len(types) > 1:
            raise Usage("--version is that of one type: give --type")
        found = []
        for kind, name in types:
            versions = [v for v in store.schema_versions(kind, name) if args.version in (None, v["schema_version_id"])]
            found += [{"kind": kind, "type_name": name, "version": v["schema_version_id"], "schema": v["schema"], "hash": v["hash"]} for v in versions[-1:]]
    if not found and (args.type or args.version is not None):
        raise NotFound("no such schema")
    return found if args.with_hash else [{k: v for k, v in x.items() if k != "hash"} for x in found]


def run(args: argparse.Namespace, spark: SparkSession) -> Any:
    """The command's result: rows, an object, or a text."""
    args.store, config = place(args), settings(args.config)
    if args.command == "init":
        store = Store.__new__(Store)
        token = hashlib.sha256(args.store.encode()).hexdigest()[:16]
        if args.force and args.token != token:
            raise errors.MigrationTokenError(f"all stored data would go; repeat with --token {token}")
        Store.__init__(store, spark, args.store)
        return [store.initialise(force=True) if args.force else store.info()]
    store = Store(spark, args.store, create=False)
    models = load_models(args.models)

    def model(name: str, kind: type) -> type:
        if name not in models or not issubclass(models[name], kind):
            raise NotFound(f"no {kind.__name__.lower()} class {name!r} in the models")
        return models[name]

    def session(validate: bool = True) -> Session:
        s = Session(args.store, args.namespace, entity_types=[c for c in models.values() if issubclass(c, Entity)], relation_types=[c for c in models.values() if issubclass(c, Relation)], config=config, spark=spark)
        if validate:
            s.validate()
        return s

    name = args.command
    if name == "info":
        info = store.info()
        counts = [{"type_kind": k, "type_name": n, "rows": store.raw_history(k, n, identity_only=True).select(*(("key",) if k == "entity" else ("left_key", "right_key", "instance_key"))).distinct().count()} for k, n in store.types()]
        return info | {"types": counts} if args.json else counts
    if name == "verify":
        session()
        return [{"types": len(models), "schemas": "as declared"}]
    if name in ("entities", "relations"):
        cls = model(args.type, Entity if name == "entities" else Relation)
        q = getattr(session().query(), name)(cls)
        if (f := filters(args.filter)) is not None:
            q = q.where(f)
        if args.as_of is not None:
            q = q.as_of(args.as_of)
        if args.with_history:
            q = q.with_history()
        if args.history_since is not None:
            q = q.history_since(args.history_since)
        if args.order_by:
            q = q.order_by(args.order_by, args.desc)
        if args.limit is not None:
            q = q.limit(args.limit)
        if args.offset:
            q = q.offset(args.offset)
        return [r.asDict(recursive=True) for r in q.to_df().collect()]
    if name == "traverse":
        q = session().query().entities(model(args.type, Entity))
        if (f := filters(args.filter)) is not None:
            q = q.where(f)
        t = None
        for step in args.via:
            t = (q if t is None else t).via(model(step, Relation))
        if args.without_relations:
            return [{"type_name": type(e).type_name} | e.model_dump() for e in t.without_relations() if e is not None]
        return [{"source": p.source.meta().key, "relations": [f"{type(r).type_name}({r.left_key}->{r.right_key})" for r in p.relations]} for p in t.collect()]
    if name == "commits":
        want = _pairs(args.meta)
        return [c for c in store.list_commits(args.limit, args.since) if all(str(c["metadata"].get(k)) == v for k, v in want.items())]
    if name == "examine":
        commit = store.get_commit(args.commit_id)
        if commit is None:
            raise NotFound(f"no commit {args.commit_id}")
        changes = store.list_commit_changes(args.commit_id)
        return commit | {"changes": changes} if args.json else changes
    if name == "export":
        types = [model(t, Entity | Relation) for t in args.type] if args.type else list(models.values())
        done = jsonl.export(session(), types, args.output, as_of=args.as_of, history_since=args.history_since, with_metadata=args.with_metadata)
        return [{"type_name": k, "path": v} for k, v in done.items()]
    if name == "import":
        r = jsonl.load(session(), args.input, list(models.values()), args.apply, args.on_conflict, args.precondition, _pairs(args.meta))
        return [{"inserts": r.inserts, "updates": r.updates, "skips": r.skips, "conflicts": r.conflict_count, "commit_id": r.commit_id}]
    if name == "schema-export":
        found = exported_schemas(args, store, models)
        text = yaml(found) if args.format == "yaml" else json.dumps(found, default=str) + "\n"
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
            return [{"schemas": len(found), "output": args.output}]
        return text.rstrip("\n") if args.format == "yaml" or args.json else found
    if name in ("schema-history", "schema-drop"):
        kind = next((k for k, n in store.types() if n == args.type), None)
        if kind is None:
            raise NotFound(f"no stored type {args.type!r}")
        if name == "schema-history":
            return [{"version": v["schema_version_id"], "created_at": v["created_at"], "hash": v["hash"]} for v in store.schema_versions(kind, args.type)]
        doomed = [(kind, args.type)]
        if users := (store.dependents(args.type) if kind == "entity" else []):
            if not args.with_dependents:
                raise Usage(f"{args.type} is an endpoint of {', '.join(users)}; drop these first, or repeat with --with-dependents")
            doomed = [("relation", u) for u in users] + doomed
        rows = {n: store.raw_history(k, n, identity_only=True).count() for k, n in doomed}
        token = drop_token(store, doomed, args.purge_history)
        if not args.apply:
            return [{"type_kind": k, "type_name": n, "versions": rows[n], "purge_history": args.purge_history, "token": token} for k, n in doomed]
        if any(rows.values()) and not args.purge_history:
            raise Usage(f"{args.type} has stored versions; purge them with --purge-history")
        if args.token != token:
            raise errors.MigrationTokenError("the token is not that of the preview")
        with store.locked("schema-drop"):
            return [{"type_name": n, "commit_id": store.drop_type(k, n, args.purge_history)} for k, n in doomed]
    if name == "migrate":
        upgraders = schema.load_upgraders(args.upgraders) if args.upgraders else None
        found = session(validate=False).migrate(dry_run=not args.apply, **({"token": args.token, "force": args.force} if args.apply else {}), upgraders=upgraders)
        return [{k: v for k, v in vars(found).items() if k != "diffs"} | ({"diffs": [vars(d) for d in found.diffs]} if hasattr(found, "diffs") else {})]
    if name == "index-verify":
        return store.verify_index(name=args.type)
    if name == "index-repair":
        return store.repair_index(args.apply)
    if name == "compact":
        return store.compact(args.type, args.apply)
    s = session(validate=False)
    ns = s.namespace
    if name == "namespaces":
        return s.bus.list_namespaces()
    if name == "events":
        return s.bus.list_events(ns, args.limit, args.status)
    if name == "sessions":
        return s.bus.list_sessions(ns)
    if name == "dead-letters":
        return s.bus.list_dead_letters(ns, args.limit)
    if name == "event":
        found = s.bus.inspect_event(ns, args.event_id)
        if found is None:
            raise NotFound(f"no event {args.event_id}")
        return [found]
    if name == "replay":
        new = s.bus.replay(ns, args.event_id)
        if new is None:
            raise NotFound(f"no event {args.event_id}")
        return [{"event_id": new}]
    return [{"deleted": s.bus.cleanup(ns, age(args.before))}]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strataloom").getOrCreate()
    codes = [(Usage, 2), (errors.UninitializedStorageError, 3), (errors.SchemaOutdatedError, 4), (jsonl.ImportConflictError, 5), (errors.LockContentionError, 5), (errors.ConcurrentWriteError, 5), (errors.MigrationTokenError, 6), (NotFound, 7), (errors.StoreError, 1), (ValueError, 2)]
    try:
        found = run(args, spark)
    except tuple(c for c, _ in codes) as e:
        print(e, file=sys.stderr)
        return next(n for c, n in codes if isinstance(e, c))
    if not isinstance(found, str):
        found = json.dumps(found, default=str) if args.json else shown(found if isinstance(found, list) else [found], False)
    print(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
