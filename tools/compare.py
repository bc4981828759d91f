"""Run catalog queries next to their SQL counterparts: ``python tools/compare.py SF_DIR [name ...]``."""

import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kinweave.plans.catalog import QUERIES  # noqa: E402
from kinweave.plans.oracles import ORACLES  # noqa: E402
from kinweave.session import get_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def main(sf_dir, names):
    spark = get_session(
        "compare", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="kinweave-compare-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = []
    for name in names or QUERIES:
        try:
            t0 = time.time()
            df = QUERIES[name](spark, sf_dir)
            mine = normal(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in ORACLES:
                print(f"---- {name}: {len(mine[1])} rows, no SQL, {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            theirs = normal([c[0] for c in cur.description], cur.fetchall())
            t2 = time.time()
            same = mine == theirs
            print(f"{'ok  ' if same else 'DIFF'} {name}: {len(mine[1])} vs {len(theirs[1])} rows, {t1 - t0:.1f}s / {t2 - t1:.1f}s", flush=True)
            if not same:
                bad.append(name)
                print("   columns", mine[0], theirs[0])
                a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
                for label, rows in (("spark only", a - b), ("sql only", b - a)):
                    for row in sorted(rows)[:4]:
                        print(f"   {label}: {row[:400]}")
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:700]}", flush=True)
    print(f"{len(bad)} bad: {' '.join(bad)}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
