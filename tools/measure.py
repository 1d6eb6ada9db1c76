"""

Usage: python tools/measure.py [sf_dir] [cores] [scratch folder]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import functions as F

    from quire.operators.anomaly import detect_anomalies, profile
    from quire.operators.extract import extract_fields, extract_line_items
    from quire.operators.validate import validate
    from quire.functions.stage import materialize
    from quire.session import local_session
    from quire.sinks.writers import write_invoices
    from quire.sources.fixtures import rendered_invoices

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cores = sys.argv[2] if len(sys.argv) > 2 else "8"
    spark = local_session(cores)
    scratch = tempfile.mkdtemp(prefix="quire-measure-", dir=sys.argv[3] if len(sys.argv) > 3 else None)
    src = os.path.join(scratch, "rendered")
    rendered_invoices(spark, sf_dir).write.parquet(src)
    docs = spark.read.parquet(src)
    n_docs = docs.count()

    def timed(fn, runs=3):
        fn()  # warm-up
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn()
            ts.append(time.perf_counter() - t0)
        return statistics.median(ts)

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    t_extract = timed(lambda: noop(extract_fields(docs)))
    items = extract_line_items(extract_fields(docs))
    n_items = items.count()
    t_items = timed(lambda: noop(items))
    inv = materialize(extract_fields(docs))
    prof = materialize(profile(inv))
    t_vd = timed(lambda: noop(detect_anomalies(validate(inv, as_of="2005-06-30"), prof)))
    t_prof = timed(lambda: profile(inv).collect())
    res = materialize(detect_anomalies(validate(inv, as_of="2005-06-30"), prof))
    k = [0]

    def sink():
        k[0] += 1
        write_invoices(res, os.path.join(scratch, f"out{k[0]}"), ["json", "csv"], pretty_json=False)

    t_sink = timed(sink)

    print(json.dumps({
        "sf_dir": sf_dir, "spark": spark.version, "master": f"local[{cores}]", "invoices": n_docs,
        "line_items": n_items,
        "extract_docs_per_s": round(n_docs / t_extract), "extract_s": round(t_extract, 2),
        "line_items_per_s": round(n_items / t_items), "line_items_s": round(t_items, 2),
        "validate_detect_rows_per_s": round(n_docs / t_vd), "validate_detect_s": round(t_vd, 2),
        "profile_s": round(t_prof, 2), "sink_json_csv_s": round(t_sink, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
