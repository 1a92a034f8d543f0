"""python -m larkspur sql FOLDER STATEMENTS (- reads them from stdin) | create FOLDER | info FOLDER"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import EngineError


def shown(v) -> str:
    if isinstance(v, bytes | bytearray):
        return f"<{len(v)} bytes>"
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def printed(columns: list[str], rows: list[tuple]) -> str:
    """A table as wide as its widest cells, and the number of rows."""
    cells = [[shown(v) for v in r] for r in rows]
    width = [max(map(len, col)) for col in zip(columns, *cells, strict=True)]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width, strict=True))
    return "\n".join([line(columns), "  ".join("-" * w for w in width), *map(line, cells), f"({len(rows)} rows)"])


def main(args: list[str]) -> int:
    if not (len(args) == 3 and args[0] == "sql" or len(args) == 2 and args[0] in ("create", "info")):
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        engine = Engine(spark, args[1])
        if args[0] == "info":
            print(json.dumps(engine.recovery_report() | {"tables": engine.tables()}))
        elif args[0] == "sql":
            for out in engine.execute(sys.stdin.read() if args[2] == "-" else args[2]):
                print({"rows": lambda o: printed(o.columns, o.rows()), "affected": lambda o: f"{o.affected} row(s)", "plan": lambda o: o.plan.rstrip("\n"), "ack": lambda o: "ok"}[out.kind](out))
    except EngineError as e:
        print(f"larkspur: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
