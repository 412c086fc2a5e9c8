"""Commands over stores: python -m keyforge COMMAND --source FOLDER --target FOLDER [...]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.rekey import Strategy
from .plans import migrate
from .schema import TableSpec
from .sources.store import Store

COMMANDS = ("init", "copy", "sync", "resume", "replicate", "validate", "rollback", "status", "generate", "totals", "logs", "truncate", "backup", "restore", "backups", "delete-backup", "full-cycle", "config-init")


def specs(path: str | None) -> tuple[TableSpec, ...]:
    """From a JSON file: [{"name", "columns", "key", "parents", "indexes": [[name, columns, unique, predicate]]}]; the synthetic tables without one."""
    if not path:
        return migrate.synthetic_specs()
    with open(path) as f:
        return tuple(TableSpec(t["name"], t["columns"], tuple(t.get("key", ())), t.get("parents", {}), tuple((n, tuple(c), u, w) for n, c, u, w in t.get("indexes", ()))) for t in json.load(f))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="keyforge")
    p.add_argument("command", choices=COMMANDS)
    for name in ("source", "target", "specs", "table", "name", "feed", "checkpoint", "config"):
        p.add_argument(f"--{name}")
    p.add_argument("--run", default="run")
    p.add_argument("--slices", type=int, default=1)
    p.add_argument("--raw", action="store_true", help="the feed holds raw messages")
    p.add_argument("--continuous", action="store_true", help="go on replicating until stopped")
    p.add_argument("--count", type=int, default=30_000)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--strategy", default="HYBRID", choices=[s.name for s in Strategy])
    p.add_argument("--on-missing", default="null", choices=["null", "reject"])
    args = p.parse_args(argv)
    if args.command == "config-init":
        print(migrate.SAMPLE_CONFIG, end="")
        return
    if args.config:
        with open(args.config) as f:
            for key, value in migrate.config(f.read()).items():
                setattr(args, key, value)
    spark = spark or SparkSession.builder.appName("keyforge").getOrCreate()
    source, target = Store(spark, args.source or ""), Store(spark, args.target or "")
    if args.command == "generate":
        print(migrate.generate(spark, source, args.count, args.seed))
        return
    if args.command == "full-cycle":
        migrate.suite(spark, args.target, args.count, args.seed).show(truncate=False)
        return
    m = migrate.Migration(spark, source, target, specs(args.specs), args.run, Strategy[args.strategy], args.on_missing, int(args.slices))
    if args.command in ("init", "validate", "status"):
        getattr(m, args.command)().orderBy("table_name").show(1000, truncate=False)
    elif args.command in ("copy", "sync", "resume"):
        print(getattr(m, args.command)())
    elif args.command == "rollback":
        print(m.rollback_to(args.table) if args.table else m.rollback_all())
    elif args.command == "replicate":
        m.replicate(args.feed, args.checkpoint, raw=args.raw, once=not args.continuous).awaitTermination()
    elif args.command == "totals":
        m.totals().orderBy("table_name").show(1000, truncate=False)
    elif args.command == "logs":
        print(m.write_logs(args.name))
    elif args.command == "truncate":
        print(target.truncate_all())
    elif args.command == "backups":
        print(target.backups())
    else:
        {"backup": m.backup, "restore": m.restore, "delete-backup": target.delete_backup}[args.command](args.name)


if __name__ == "__main__":
    main()
