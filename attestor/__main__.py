"""Command line: init, scan, validate, compile, recompile, report, export, delta. Output is JSON."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .plans import compile as C
    from .sources.workspace import Workspace

    parser = argparse.ArgumentParser(prog="attestor")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"init": ["workspace"], "scan": ["workspace", "source"], "validate": ["intent"], "compile": ["workspace", "intent", "output"], "recompile": ["build", "intent", "output"], "report": ["build"], "export": ["build", "output"], "delta": ["base", "target", "output"]}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name == "scan":
            p.add_argument("--include", action="append")
            p.add_argument("--exclude", action="append")
            p.add_argument("--max-bytes", type=int)
        if name in ("compile", "recompile"):
            p.add_argument("--max-errors", type=int)
            p.add_argument("--max-warnings", type=int)
    a = parser.parse_args(argv)
    intent = lambda: C.load_intent(a.intent)  # noqa: E731  unknown keys are a TypeError
    if a.command == "init":
        out: dict = {"workspace": str(Workspace.init(a.workspace).control)}
    elif a.command == "validate":
        out = {"problems": intent().validate()}
    else:
        spark = SparkSession.builder.appName("attestor").getOrCreate()
        if a.command == "scan":
            ws = Workspace.open(a.workspace)
            C.scan(spark, a.source, ws, a.include, a.exclude, a.max_bytes)
            out = json.loads((ws.control / "manifest.json").read_text())
        elif a.command == "compile":
            out = C.compile_build(spark, Workspace.open(a.workspace), intent(), a.output)
        elif a.command == "recompile":
            out = C.recompile(spark, a.build, intent(), a.output)
        elif a.command == "report":
            out = C.report(spark, a.build)
        elif a.command == "export":
            out = {"records": C.export_jsonl(spark, a.build, a.output)}
        else:
            out = C.export_delta(spark, a.base, a.target, a.output)
    print(json.dumps(out, default=str))
    failed = out.get("status") == "failed" or bool(out.get("problems"))
    over = getattr(a, "max_errors", None) is not None and out["errors"] > a.max_errors or getattr(a, "max_warnings", None) is not None and out["warnings"] > a.max_warnings
    return int(failed or over)


if __name__ == "__main__":
    sys.exit(main())
