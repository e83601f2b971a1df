"""Run registered queries by name: python -m gramlake.runner --data DIR [--only a,b] [--skip c] (OR1-OR5).

Exit code 0: all ran; 1: some failed (the others still ran); 2: nothing to run or a bad configuration.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import traceback
from dataclasses import dataclass, field


@dataclass
class Config:
    """OR1/OR5: what to run on; a YAML file may give any of the fields."""

    data: str = ""
    out: str | None = None
    only: list[str] = field(default_factory=list)
    skip: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    dry_run: bool = False

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            known = {k: v for k, v in (yaml.safe_load(f) or {}).items() if k in cls.__dataclass_fields__}
        return cls(**known)


def choose(names: list[str], config: Config) -> list[str]:
    """OR2: registration order; disabled ones run only if named."""
    return [n for n in names if (n in config.only if config.only else n not in config.disabled) and n not in config.skip]


def run_one(spark, name: str, fn, config: Config) -> dict:
    """OR3: status ok, failed, interrupted, missing or dry_run, with rows and seconds."""
    if fn is None:
        return {"name": name, "status": "missing"}
    if config.dry_run:
        return {"name": name, "status": "dry_run"}
    began = time.time()
    try:
        df = fn(spark, config.data)
        if config.out:
            df.write.mode("overwrite").parquet(f"{config.out}/{name}")
            n = spark.read.parquet(f"{config.out}/{name}").count()
        else:
            n = df.count()
        return {"name": name, "status": "ok", "rows": n, "seconds": round(time.time() - began, 3)}
    except KeyboardInterrupt:
        return {"name": name, "status": "interrupted", "seconds": round(time.time() - began, 3)}
    except Exception as e:
        traceback.print_exc()
        return {"name": name, "status": "failed", "error": f"{type(e).__name__}: {e}"[:300], "seconds": round(time.time() - began, 3)}


def main(argv: list[str] | None = None) -> int:
    """OR4."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config")
    p.add_argument("--data")
    p.add_argument("--out")
    p.add_argument("--only", default="")
    p.add_argument("--skip", default="")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    config = Config.load(a.config) if a.config else Config()
    config.data, config.out, config.dry_run = a.data or config.data, a.out or config.out, a.dry_run or config.dry_run
    config.only = [x for x in a.only.split(",") if x] or config.only
    config.skip = [x for x in a.skip.split(",") if x] or config.skip
    from gramlake.plans import QUERIES

    names = choose([*QUERIES, *(n for n in config.only if n not in QUERIES)], config)
    if not names or (not config.data and not config.dry_run):
        print("nothing to run: no query chosen or no --data", file=sys.stderr)
        return 2
    spark = None
    if not config.dry_run:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("gramlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done = []
    for n in names:
        done.append(run_one(spark, n, QUERIES.get(n), config))
        print(json.dumps(done[-1]), flush=True)
        if done[-1]["status"] == "interrupted":
            break
    return int(any(x["status"] not in ("ok", "dry_run") for x in done))


if __name__ == "__main__":
    sys.exit(main())
