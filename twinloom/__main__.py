"""Command line: smoke, open, --service, --http and retention over a stored twin."""

from __future__ import annotations

import argparse
import sys
import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinloom import functions as fn
from twinloom.api import WRITERS, Agent
from twinloom.model import Twin
from twinloom.operators.checks import violations
from twinloom.rpc import http_server, serve
from twinloom.sources.store import Store

VERSION = "0.1.0"
DAY = 86_400


def smoke(spark: SparkSession) -> int:
    """The four-node machine with two bounds, each of which one reading exceeds."""
    props = lambda **p: [(k.replace("__", "."), v) for k, v in p.items()]
    entities = [(0, "PLC", "PLC01", []), (1, "Drive", "Drive12", []), (2, "Motor", "Motor42", props(spec__current__max="10")), (3, "Pump", "Pump17", props(spec__pressure__max="180"))]
    relations = [(i, i, i + 1, t, k, 0, -1, 0, False) for i, (t, k) in enumerate((("network", "profinet"), ("electrical", "feeds"), ("mechanical", "drives")))]
    names = spark.createDataFrame([("Motor42.current", "Motor42", "current", 0, 11.7), ("Pump17.pressure", "Pump17", "pressure", 1, 183.0)], "name string, entity string, signal string, ord bigint, v double").withColumn("sid", fn.series_id(F.col("name")))
    points = names.select("sid", F.lit(0).cast("bigint").alias("batch_id"), F.col("ord").alias("seq"), F.lit(1).cast("bigint").alias("t"), "v")
    twin = Twin.of(spark, entities=entities, relations=relations, series=names.select("sid", "name", "entity", "signal", "ord"), points=points)
    found = violations(twin, "current").unionByName(violations(twin, "pressure")).orderBy("entity").collect()
    for r in found:
        print(f"VIOLATION {r['entity']}: {r['v']} > {r['expected_max']}")
    return 0 if len(found) == 2 else 1


def retain_once(agent: Agent, days: int, now: float | None = None) -> dict:
    """One round of periodic retention over the latest snapshot."""
    agent.refresh()
    return agent.retain(int(time.time() if now is None else now) - days * DAY)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twinloom")
    parser.add_argument("mode", choices=("smoke", "open"), nargs="?")
    parser.add_argument("--db", help="folder of a stored twin")
    parser.add_argument("--service", action="store_true", help="JSON-RPC on standard input and output")
    parser.add_argument("--http", action="store_true")
    parser.add_argument("--bind", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8888)
    parser.add_argument("--http-token")
    parser.add_argument("--agent", default="agent")
    parser.add_argument("--role", choices=("reader", *WRITERS), default="reader")
    parser.add_argument("--retention-days", type=int)
    parser.add_argument("--version", action="version", version=VERSION)
    options = parser.parse_args(args)
    if options.retention_days is not None and options.role not in WRITERS:
        parser.error("--retention-days needs --role writer or ingest")
    if options.mode != "smoke" and not options.db:
        parser.error("--db is needed")
    spark = SparkSession.builder.appName("twinloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if options.mode == "smoke":
        return smoke(spark)
    agent = Agent(Store(spark, options.db), options.agent, options.role)
    if options.retention_days is not None:
        def keep() -> None:
            own = Agent(Store(spark, options.db), f"{options.agent}-retention", options.role)  # its own snapshot: conflicts are told by the store
            while True:
                retain_once(own, options.retention_days)
                time.sleep(3600)

        threading.Thread(target=keep, daemon=True).start()
    if options.http:
        http_server(agent, options.bind, options.port, options.http_token).serve_forever()
    elif options.service:
        serve(agent, sys.stdin, sys.stdout)
    else:
        print({name: getattr(agent.twin, name).count() for name in ("entities", "relations", "series", "points", "states", "events")})
    return 0


if __name__ == "__main__":
    sys.exit(main())
