"""Times the headline queries; prints one JSON line.

Input: $BENCH_SF_DIR (default sf0.1), on local[$BENCH_CPUS]. The graph is
compiled first and reported as its own entry; the queries then read it, as
they would between two releases of a map. Rates are per second of the named
query, over all rows it answered.
"""

from __future__ import annotations

import json
import os
import threading
import time

from curbline import session
from curbline.plans import catalog, compiled, derive

HEADLINE = ("vehicle_edge_costs", "edge_durations", "access_masks", "bikeway_match", "elevation_sample", "reverse_geocode", "park_near", "geocode_search", "place_search",
            "moto_sites", "places_dedupe", "ride_progress")
ROUTES = ("batch_routes", "route_warnings", "route_steps")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local_session("curbline-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    session.ship()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    unfinished: list[str] = []
    # A run that hangs still reports: past the limit the running jobs are ended and named.
    stop = threading.Timer(float(os.environ.get("BENCH_LIMIT_S", "1200")), spark.sparkContext.cancelAllJobs)
    stop.daemon = True
    stop.start()

    def timed(name, run):
        t = time.time()
        try:
            run()
        except Exception:
            if stop.is_alive():
                raise
            unfinished.append(name)
        else:
            times[name] = round(time.time() - t, 3)

    timed("compile_graph", lambda: [f(spark, sf).count() for f in (compiled.edges, compiled.bans, compiled.turns, compiled.strong, compiled.joined)])
    for name in (*HEADLINE, *ROUTES):
        if unfinished:
            unfinished.append(name)
            continue
        # a full write-out of every row, without the cost of a sink
        timed(name, lambda: catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    counts = {"batch_routes": derive.table(spark, sf, "orders").count(), "reverse_geocode": derive.table(spark, sf, "orders").count(), "ride_progress": derive.table(spark, sf, "events").count()}
    rates = {f"{k}_per_s": round(n / times[k], 1) for k, n in counts.items() if k in times}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates, "unfinished": unfinished,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
