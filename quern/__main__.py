"""Command line: ``python -m quern -c SCHEMA [-b BASE_URI] [-l spark|c] [-d STAGE] [-r [FILE]] [--compat]``.

Compiles a schema; with ``-r`` validates one document (a file, or standard input) and exits 0 if it is valid, else 1. A bad
schema or a target language that isn't supported exits 2.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from quern.operators.validate import STAGES, compile_schema
from quern.plans.schema import SchemaError


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quern", description="Validate JSON against JSON Schema (draft-06).")
    p.add_argument("-c", "--compile", metavar="SCHEMA", required=True)
    p.add_argument("-r", "--run", metavar="FILE", nargs="?", const="-")
    p.add_argument("-b", "--base-uri", metavar="URI")
    p.add_argument("-l", "--language", default="spark")
    p.add_argument("-d", "--debug", metavar="STAGE", action="append", choices=STAGES, default=[])
    p.add_argument("--compat", action="store_true", help="reproduce documented deviations")
    a = p.parse_args(args)
    if a.language != "spark":
        print(f"language {a.language} needs to be implemented", file=sys.stderr)
        return 2
    try:
        path = Path(a.compile)
        schema = compile_schema(path.read_text(), base_uri=a.base_uri or path.resolve().as_uri(), mode="compat" if a.compat else "spec")
    except (OSError, SchemaError) as e:
        print(e, file=sys.stderr)
        return 2
    for stage in a.debug:
        print(schema.explain(stage))
    if a.run is None:
        return 0
    found = schema.python.check(sys.stdin.read() if a.run == "-" else Path(a.run).read_text())
    for path_, keyword, code in found:
        print(f"{path_ or '/'}: {keyword} (0x{code:02X})", file=sys.stderr)
    return int(bool(found))


if __name__ == "__main__":
    sys.exit(main())
