"""Write the final (adaptive) physical plans of the headline queries to docs/plans/.

Usage: python docs/make_plans.py [sf_dir]   (default /root/testdata/sf0.01)
Each query runs once through the no-op sink so the plan shows AQE's final choices.
"""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NAMES = ["page_features", "feature_means", "dedup_pages", "existence_report", "title_search_top3",
         "lookup_by_title", "bucketize", "suggestions", "page_report", "labelled_pages"]


def main(sf_dir: str) -> None:
    from quillrank.plans import load_all
    from quillrank.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    reg = load_all()
    for name in NAMES:
        df = reg.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        with open(os.path.join(ROOT, "docs", "plans", f"{name}.txt"), "w") as fh:
            fh.write(plan)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
