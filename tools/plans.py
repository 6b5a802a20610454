"""Write the formatted physical plans of the headline queries to PLANS.md.

    python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticksmith.plans import catalog  # noqa: E402
from ticksmith.session import build_session  # noqa: E402

SHOWN = ["indicator_frame", "ema_200", "sma_20", "chart_macd", "chart_bands", "sliding_bands",
         "latest_n_per_symbol", "snapshot", "normalize_bars", "flatten_history"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` on `{os.path.basename(sf_dir)}` "
           "(adaptive plans before execution; `isFinalPlan=false`).", ""]
    for name in SHOWN:
        df = catalog.QUERIES[name](spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0]
        out += [f"## {name}", "", "```", tree.strip(), "```", ""]
        details = [line for line in text.splitlines()
                   if line.startswith(("ReadSchema", "PushedFilters", "Arguments: rangepartitioning",
                                       "Arguments: hashpartitioning", "Arguments: SinglePartition",
                                       "Arguments: HashedRelationBroadcastMode"))]
        if details:
            out += ["Key details:", "", "```", *details, "```", ""]
    # The eager first step of the row indicators: range-sorted, numbered rows written once.
    from pyspark.sql import functions as F
    from ticksmith.plans import fixtures
    t = fixtures.ticks(spark, sf_dir)
    cols = ["symbol", "ts", "seq"]
    numbered = (t.repartitionByRange(8, *cols).sortWithinPartitions(*cols)
                .withColumn("_rid", F.monotonically_increasing_id()))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        numbered.explain("formatted")
    text = buf.getvalue()
    out += ["## series positions (write job before every row-indicator query)", "", "```",
            text.split("\n\n")[0].strip(), "```", "", "Key details:", "", "```",
            *[line for line in text.splitlines() if line.startswith(("ReadSchema", "Arguments: range"))],
            "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
