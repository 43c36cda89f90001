"""Command line: plan, run and audit a contract; verify a published folder.

Exit codes: 0 fine, 1 a gate or a strict audit failed, 2 something is missing.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from cohortlens.operators.integrity import GateError, roll_up
from cohortlens.plans import study
from cohortlens.session import build_session
from cohortlens.sources import artifacts, commits


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortlens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("plan", "run", "audit", "verify"):
        sub = commands.add_parser(name)
        sub.add_argument("config")
        sub.add_argument("--output-dir")
        if name == "run":
            sub.add_argument("--subjects-limit", type=int)
            sub.add_argument("--log", action="store_true", help="publish by a log of commits, which needs no rename")
        if name == "audit":
            sub.add_argument("--strict", action="store_true")
    given = parser.parse_args(args)
    if not Path(given.config).exists():
        print(f"missing: {given.config}", file=sys.stderr)
        return 2
    contract = study.check_contract(artifacts.load_contract(given.config))
    if given.command == "plan":
        print(study.plan_text(contract))
        return 0
    out = given.output_dir or artifacts.project_path(contract, contract["paths"]["output_dir"])
    spark = build_session()
    there = lambda path: artifacts.Folder(spark, path).exists()
    if given.command == "run":
        for what in ("participants", "recordings", *(["annotations"] if contract["paths"].get("annotations") else [])):
            if not there(artifacts.project_path(contract, contract["paths"][what])):
                print(f"missing: {what}", file=sys.stderr)
                return 2
        try:
            print(study.run_study(spark, contract, given.subjects_limit, out, given.log))
        except GateError as e:
            print(f"refused: {e}", file=sys.stderr)
            return 1
        return 0
    if not there(out):
        print(f"missing: {out}", file=sys.stderr)
        return 2
    out = commits.published(spark, out)
    if given.command == "verify":
        wrong = study.verify_manifest(spark, out).collect()
        print("\n".join(f"{r['path']}: {r['problem']}" for r in wrong) or "all files as in the manifest")
        return 1 if wrong else 0
    checks = study.audit_folder(spark, out)
    print(artifacts.markdown_table(checks, 200))
    return 1 if given.strict and roll_up(checks).first()["status"] == "fail" else 0


if __name__ == "__main__":
    sys.exit(main())
