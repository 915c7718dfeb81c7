"""python -m fathomwire validate|format|types|changes FILE...: schema files on the driver."""

from __future__ import annotations

import sys

from fathomwire.plans import schema_language as L


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("validate", "format", "types", "changes"):
        print(__doc__, file=sys.stderr)
        return 64
    command, *paths = args
    loaded = [L.load(p) for p in paths]
    if command == "changes":
        from pyspark.sql import SparkSession

        from fathomwire.operators.evolution import schema_changes, schema_table

        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        old, new = (schema_table(spark, s, found) for s, found in loaded[:2])
        rows = schema_changes(old, new).orderBy("kind", "record", "number").collect()
        for r in rows:
            print(r.record, r.number, r.change, "breaking" if r.breaking else "compatible", r.detail, sep="\t")
        return int(any(r.breaking for r in rows))
    worst = 0
    for path, (s, found) in zip(paths, loaded, strict=True):
        if command == "format":
            print(L.write(s), end="")
        elif command == "types":
            for name, struct in L.struct_types(s, found).items():
                print(name, struct.simpleString(), sep="\t")
        else:
            for line, severity, message in L.check(s, found):
                print(f"{path}:{line}: {severity}: {message}")
                worst = max(worst, 1 if severity == "error" else 0)
    return worst


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
