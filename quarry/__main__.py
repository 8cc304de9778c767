"""``python -m quarry <file> [out_dir]``: ingest a delimited file, profile it, recommend a
plan, answer it, and print the profile, the KPIs and the panel sizes. With ``out_dir``
(shared storage on a cluster) the clean table, metadata, profile, summary and plan are
written there."""

from __future__ import annotations

import json
import sys

from quarry.plans.auto import analyse_file
from quarry.session import get_spark


def main(argv: list[str]) -> int:
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if argv else 2
    path = argv[0]
    out_dir = argv[1] if len(argv) > 1 else None
    spark = get_spark(app="quarry-cli")
    try:
        ing, res = analyse_file(spark, path, out_dir=out_dir)
    except FileNotFoundError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"loaded {path}: delimiter {ing.metadata['delimiter']!r}, encoding {ing.metadata['encoding_used']}")
    res.profile.df.show(truncate=40)
    print(json.dumps(res.plan, indent=2))
    res.dashboard.kpis.show(truncate=60)
    res.dashboard.panels().groupBy("rank", "panel", "kind").count().orderBy("rank").show(truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
