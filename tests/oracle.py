"""Run queries and their SQL side by side and compare the rows.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, sf_dir, build, sql):
    """A list of differences; empty when both sides agree."""
    df = build(spark, sf_dir)
    mine = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = _sorted([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} != {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        return [f"{len(mine[1])} rows != {len(theirs[1])} rows"]
    out = []
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            out.append(f"{a!r:.400} != {b!r:.400}")
    return out


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as contract
    from callscope.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(args.sf)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            if name in oracles:
                diff = compare(spark, con, args.sf, queries[name], oracles[name])
            else:
                diff = []
                print(f"     {name}: {queries[name](spark, args.sf).count()} rows, no SQL")
        except Exception as error:  # report and go on with the next query
            diff = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in diff[:3]:
            print("      ", line)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
