"""python -m quernstone SF_DIR NAME...: runs queries of the registry and shows them; without names, lists these."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from .plans import registry

    if len(args) < 2:
        print("\n".join(registry.QUERIES))
        return 0 if not args else 2
    unknown = [n for n in args[1:] if n not in registry.QUERIES]
    if unknown:
        print(f"no query {', '.join(unknown)}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quernstone").getOrCreate()
    for name in args[1:]:
        registry.QUERIES[name][0](spark, args[0]).show(truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
