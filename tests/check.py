"""Run catalogue queries against their SQL twins: python tests/check.py [prefix ...] [sf=0.01] [hot=N]."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

import oracle

from tidemark import registry, session


def main(args):
    opts = dict(a.split("=") for a in args if "=" in a)
    wanted = [a for a in args if "=" not in a]
    sf_dir = f"/root/testdata/sf{opts.get('sf', '0.01')}"
    spark = session.local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    if "hot" in opts:
        spark.conf.set(session.HOT_ROWS_KEY, opts["hot"])
    registry.load_all()
    con = oracle.connect(sf_dir)
    failed = 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name == w or fn.__module__.endswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in registry.ORACLES:
                problem = oracle.difference(df, con, registry.ORACLES[name])
                note = f"{df.count()} rows" if not problem else ""
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as e:
            problem, note = "".join(traceback.format_exception_only(e))[:900], ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {note} {problem or ''}", flush=True)
    print("failed", failed)


main(sys.argv[1:])
