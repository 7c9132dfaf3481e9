"""Time catalogue queries with the noop sink: python tests/timing.py sf [name ...]."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1])]

from tidemark import registry, session

spark = session.local_session("8")
spark.sparkContext.setLogLevel("ERROR")
registry.load_all()
sf_dir = f"/root/testdata/sf{sys.argv[1]}"
names = sys.argv[2:] or list(registry.QUERIES)
registry.QUERIES["min_slice"](spark, sf_dir).collect()
for name in names:
    took = []
    for _ in range(2):
        started = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took.append(time.time() - started)
    print(f"{min(took):7.2f} {took[0]:7.2f} {name}", flush=True)
