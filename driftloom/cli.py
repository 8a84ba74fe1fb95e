"""Command lines: migrate a store, patch schema source, soak a store with the identity migration.

    python -m driftloom.cli migrate SCRIPT SOURCE [TARGET] [--plan] [--dry-run] [--verify] [--force] [-v]
    python -m driftloom.cli source SCRIPT SOURCE_DIR OUT_DIR [--no-verify] [--force]
    python -m driftloom.cli soak SOURCE TARGET

SCRIPT is a Python file with a function ``directives(catalog)`` that gives the edit script.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys
import time
from collections.abc import Callable

from driftloom.catalog.catalog import Catalog
from driftloom.functions.nodes import Refused
from driftloom.plans.directives import Directives


def load_script(path: str) -> Callable[[Catalog], Directives]:
    spec = importlib.util.spec_from_file_location("_driftloom_script", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not callable(getattr(module, "directives", None)):
        raise Refused(f"{path} has no function directives(catalog)")
    return module.directives


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("driftloom").config("spark.sql.caseSensitive", "true").getOrCreate()


def migrate(args: argparse.Namespace) -> int:
    from driftloom import commitstore
    from driftloom import migrate as M
    from driftloom.operators.diagnostics import format_report
    from driftloom.plans.build import build
    from driftloom.plans.report import format_plan, plan
    from driftloom.sources.store import Files, Store

    spark = session()
    source = Store.open(spark, args.source)
    script = load_script(args.script)(source.catalog)
    if args.plan:
        print(format_plan(plan(source.catalog, script)))
        return 0
    log = source.kind == "commits"
    if args.dry_run:
        if log:
            print(commitstore.dry_run(source, script))
            return 0
        report = M.dry_run(source, build(source.catalog, script))
        print(f"{report.documents} documents, {report.dropped} dropped, {report.referenced_blobs} blobs referenced, {report.orphans} orphans")
        print(format_report(report.findings))
        return 0
    if not args.target:
        raise Refused("a target is needed, or --plan or --dry-run")
    if args.force:
        Files(spark, args.target).delete()
    shown = (lambda p: print(f"{p.attachment_index}/{p.attachment_count} {p.attachment}: {p.documents} documents, {p.blobs} blobs")) if args.verbose else None
    run = commitstore.run if log else M.run
    print(run(spark, args.source, script, args.target, check=args.verify, on_progress=shown))
    return 0


def source(args: argparse.Namespace) -> int:
    from pathlib import Path

    from driftloom.schema_source.codemod import Tree, rewrite_folder

    files = {str(p): p.read_text(encoding="utf-8") for p in Path(args.source).rglob("*.dsm")}
    script = load_script(args.script)(Tree(files).catalog())
    for name in rewrite_folder(args.source, script, args.target, check=not args.no_verify, force=args.force, on_note=lambda n: print(f"note: {n}")):
        print(name)
    return 0


def soak(args: argparse.Namespace) -> int:
    """The identity migration with verification, timed."""
    from driftloom import commitstore
    from driftloom import migrate as M
    from driftloom.plans.build import build
    from driftloom.sources.store import Store

    spark = session()
    store = Store.open(spark, args.source)
    run = commitstore.run if store.kind == "commits" else M.run
    began = time.perf_counter()
    out = run(spark, args.source, Directives(), args.target)
    moved = time.perf_counter()
    target = Store.open(spark, args.target)
    m = build(store.catalog, Directives())
    commitstore.verify(store, m, target) if store.kind == "commits" else M.verify(store, m, target)
    rate = {"mb_per_s": round(out["bytes"] / 1e6 / (moved - began), 2)} if "bytes" in out else {}
    print({**out, "migrate_s": round(moved - began, 2), "verify_s": round(time.perf_counter() - moved, 2), **rate})
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="driftloom")
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("migrate")
    p.add_argument("script")
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    for flag in ("--plan", "--dry-run", "--verify", "--force"):
        p.add_argument(flag, action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.set_defaults(run=migrate)
    p = sub.add_parser("source")
    for name in ("script", "source", "target"):
        p.add_argument(name)
    p.add_argument("--no-verify", action="store_true")
    p.add_argument("--force", action="store_true")
    p.set_defaults(run=source)
    p = sub.add_parser("soak")
    for name in ("source", "target"):
        p.add_argument(name)
    p.set_defaults(run=soak)
    args = top.parse_args(argv)
    try:
        return args.run(args)
    except (Refused, FileExistsError, FileNotFoundError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
