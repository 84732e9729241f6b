"""Wall time of the headline queries; prints one JSON line.

``train`` is the one-off training of the built-in models; the queries after it share its tables, and
``search_space`` is likewise paid once by the attacks that follow.
"""

from __future__ import annotations

import json
import os
import time

from nameshift import build_session
from nameshift.session import drop_stages
from nameshift.plans.queries import QUERIES, prepared

HEADLINE = [
    "tokens",
    "identifiers",
    "variants_unk",
    "predict",
    "importance_unk",
    "search_space",
    "attack_greedy",
    "attack_mask_greedy",
    "attack_mhm",
    "attack_ga",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {"train": timed(lambda: prepared(spark, folder).fills)}
    for name in HEADLINE:
        df = []
        seconds[name] = timed(lambda: (df.append(QUERIES[name](spark, folder)), df[0].write.format("noop").mode("overwrite").save()))
    occurrences = QUERIES["query_count"](spark, folder).selectExpr("sum(query_count)").first()[0]
    candidates = prepared(spark, folder).space().count()
    drop_stages(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "importance_variants_per_sec": round(occurrences / seconds["importance_unk"]),
                "unbounded_greedy_candidates_per_sec": round(candidates / seconds["attack_mask_greedy"]),
            }
        )
    )


if __name__ == "__main__":
    main()
