"""Command line: mask a dump, check a policy, draft a policy.

Exit codes: 0 done; 1 error, changes under --check, or policy violations; 2 uncovered columns; 3 findings of the scan.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

from veilwork.functions.stream import TAG
from veilwork.operators import coverage, report, scaffold, scan, seal
from veilwork.operators.masking import Masking
from veilwork.plans import lint, policy
from veilwork.sources import detect, sqldump, sqltext


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilwork", description=__doc__.splitlines()[0])
    _input(top)
    top.add_argument("-o", "--output")
    top.add_argument("-c", "--config")
    for flag in ("--allow-noop", "--in-place", "--check", "--stats", "--strict-coverage", "--scan-output", "--fail-on-findings"):
        top.add_argument(flag, action="store_true")
    top.add_argument("--report")
    top.add_argument("--seed", type=int, default=int(os.environ["VEILWORK_SEED"]) if os.environ.get("VEILWORK_SEED", "").isdigit() else None)
    top.add_argument("--security-profile", choices=("standard", "hardened"), default="standard")
    top.add_argument("--domain-tag", type=os.fsencode, default=TAG, help="goes before what is hashed for a domain; that of another engine gives its values")
    commands = top.add_subparsers(dest="command")
    one = commands.add_parser("lint-policy", help="check a policy without data")
    one.add_argument("-c", "--config")
    one.add_argument("--allow-noop", action="store_true")
    two = commands.add_parser("scaffold-config", help="draft a policy from a dump")
    _input(two)
    two.add_argument("-o", "--output")
    two.add_argument("--infer-json-paths", action="store_true")
    two.add_argument("--max-json-depth", type=int, default=scaffold.MAX_DEPTH)
    return top


def _input(to: argparse.ArgumentParser) -> None:
    to.add_argument("-i", "--input")
    to.add_argument("--format", default="postgres", type=str.lower, choices=sorted(sqltext.DIALECTS))
    to.add_argument("--allow-ext", action="append", default=[])
    to.add_argument("--keep-original", action="store_true")
    to.add_argument("--remove-original", action="store_true", help="remove an archive after it has been masked")
    to.add_argument("--pg-restore-path")
    to.add_argument("--pg-restore-arg", action="append", default=[])


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("veilwork").getOrCreate()


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "lint-policy":
            found = lint.lint(policy.load(args.config, allow_none=args.allow_noop))
            for v in found:
                print(v, file=sys.stderr)
            return int(bool(found))
        if args.command == "scaffold-config":
            return _scaffold(args, spark or _session())
        return _mask(args, spark)
    except (policy.PolicyError, detect.InputError, sqltext.DumpError, ValueError, OSError) as bad:
        print(f"error: {bad}", file=sys.stderr)
        return 1


def _resolved(args, spark, own: policy.Policy | None = None) -> detect.Input:
    spool = sqldump.spool_folder(spark)
    if args.input in (None, "-"):
        os.makedirs(spool, exist_ok=True)
        handle, name = tempfile.mkstemp(suffix=".sql", dir=spool)
        with os.fdopen(handle, "wb") as file:
            shutil.copyfileobj(sys.stdin.buffer, file)
        return detect.Input(Path(name), made=[Path(name)])
    detect.check_extension(args.input, args.allow_ext)
    tool = args.pg_restore_path or (own.pg_restore_path if own else None)
    more = args.pg_restore_arg or (own.pg_restore_args if own else ())
    return detect.resolve(args.input, dialect=sqltext.DIALECTS[args.format], spool=spool, pg_restore=tool, pg_restore_args=more)


def _scaffold(args, spark) -> int:
    source = _resolved(args, spark)
    try:
        dialect = sqltext.DIALECTS[args.format]
        columns = sqldump.tables(sqldump.index(str(source.path), dialect))
        if args.infer_json_paths:
            frames = {t: sqldump.read_table(spark, str(source.path), t, dialect=dialect) for t in columns}
            rules = scaffold.draft(frames, infer_json=True, max_depth=args.max_json_depth)
        else:
            rules = scaffold.by_names(columns)
        text = scaffold.to_toml(rules)
        if args.output:
            Path(args.output).write_text(text, encoding="utf-8")
        else:
            print(text)
        return 0
    finally:
        source.close()


def _mask(args, spark) -> int:
    if args.in_place and (args.output or args.input in (None, "-")):
        raise ValueError("--in-place needs --input and no --output")
    if args.in_place and args.keep_original:
        raise ValueError("--keep-original can't be used with --in-place")
    if args.fail_on_findings and not args.scan_output:
        raise ValueError("--fail-on-findings needs --scan-output")
    own = policy.load(args.config, allow_none=args.allow_noop)
    hardened = args.security_profile == "hardened"
    m = Masking.of(own, hardened=hardened, seed=args.seed, tag=args.domain_tag)
    begun = time.monotonic()
    spark = spark or _session()
    source = _resolved(args, spark, own)
    staged = None
    try:
        if args.in_place and not source.is_original:
            raise ValueError("--in-place can't be used with compressed or archived input")
        current = seal.make(own, m.profile, {"format": sqltext.DIALECTS[args.format]})
        with source.path.open("rb") as file:
            first = file.readline(1 << 16).decode("utf-8", "replace")
        verdict = seal.verdict(first, current)
        folder = Path(args.output or args.input).parent if args.output or args.in_place else Path(sqldump.spool_folder(spark))
        folder.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(suffix=".sql.part", dir=folder)
        staged = Path(name)
        if verdict == "trusted":  # made by this very policy: it passes through
            with os.fdopen(handle, "wb") as out, source.path.open("rb") as file:
                shutil.copyfileobj(file, out, 1 << 18)
            return _publish(args, staged, source)
        if verdict == "stale":
            source = _without_first_line(source, spark)
        with os.fdopen(handle, "wb") as out:
            out.write(current.line().encode())
            found = sqldump.index(str(source.path), sqltext.DIALECTS[args.format])
            sqldump.rewrite(spark, str(source.path), out, m, dialect=args.format, found=found)
        return _finish(args, spark, source, found, staged, m, own, hardened, begun)
    finally:
        if staged is not None:
            staged.unlink(missing_ok=True)
        source.close()


def _without_first_line(source: detect.Input, spark) -> detect.Input:
    handle, name = tempfile.mkstemp(suffix=".sql", dir=_made(sqldump.spool_folder(spark)))
    with os.fdopen(handle, "wb") as out, source.path.open("rb") as file:
        file.readline()
        shutil.copyfileobj(file, out, 1 << 18)
    return detect.Input(Path(name), source.archive, [*source.made, Path(name)])


def _made(folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return folder


def _finish(args, spark, source, found, staged, m, own, hardened, begun) -> int:
    dialect = sqltext.DIALECTS[args.format]
    columns = sqldump.tables(found)
    covered = coverage.coverage(own, columns)
    scanned = scan.report(spark.read.text(str(staged)), ["value"], own.output_scan) if args.scan_output else None
    counted, happened = [], []
    wanted = columns if args.report or args.stats or args.check else {}
    saved = sqldump.save_index(spark, found) if wanted else None
    for t in wanted:
        rows = sqldump.with_columns(sqldump.read(spark, str(source.path), dialect=dialect, table=t, saved=saved), columns[t]).select(*(f"`{c}`" for c in columns[t]))
        counted += report.counts(m, rows, t).collect()
        if args.report:
            happened += list(report.events(m, rows, t).toLocalIterator())
    whole = report.summary(counted, hardened=hardened, coverage=covered, usage=report.domain_usage(m, columns), scan=scanned, event_rows=happened)
    if args.report:
        Path(args.report).write_text(report.to_json(whole), encoding="utf-8")
    if args.stats:
        print(f"rows={whole['total_rows_processed']} dropped={whole['total_rows_dropped']} cells={whole['total_cells_changed']} wall_ms={int((time.monotonic() - begun) * 1000)}", file=sys.stderr)
    if args.strict_coverage and covered["uncovered"]:
        print("uncovered sensitive columns: " + ", ".join(covered["uncovered"]), file=sys.stderr)
        return 2
    if args.fail_on_findings and scanned["failed"]:
        print("the output scan failed: " + ", ".join(scanned["failed_categories"]), file=sys.stderr)
        return 3
    if args.check:
        return int(bool(whole["total_rows_dropped"] or whole["total_cells_changed"]))
    return _publish(args, staged, source)


def _publish(args, staged: Path, source: detect.Input) -> int:
    """Only what has passed its gates appears under the output's name."""
    if args.check:
        return 0
    if args.output or args.in_place:
        os.replace(staged, args.output or args.input)
    else:
        with staged.open("rb") as file:
            shutil.copyfileobj(file, sys.stdout.buffer, 1 << 18)
    if args.remove_original and not args.keep_original and source.archive is not None:
        shutil.rmtree(source.archive) if source.archive.is_dir() else source.archive.unlink()
    return 0


if __name__ == "__main__":
    sys.exit(main())
