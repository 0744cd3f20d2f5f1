"""Command line: ``python -m tilesieve filter ...`` and ``python -m tilesieve exact ...``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import MISSING, fields

from tilesieve.config import METHODS, Config

CHOICES = {"fdr_method": METHODS, "inference_unit": ("read", "edge"), "tile_neighborhood": ("same-tile", "adjacent", "lane"), "spatial_metric": ("chebyshev", "euclidean"), "unparsed": ("error", "keep")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tilesieve")
    sub = top.add_subparsers(dest="mode", required=True)
    full = sub.add_parser("filter", help="statistical mode")
    kinds = {"int": int, "float": float}
    for f in fields(Config):
        flag = "--" + f.name.replace("_", "-")
        if f.default is MISSING:
            full.add_argument(flag, required=True)
        elif isinstance(f.default, bool):
            full.add_argument(flag, action=argparse.BooleanOptionalAction if f.default else "store_true", default=f.default)
        else:
            full.add_argument(flag, type=kinds.get(str(f.type), str), default=f.default, choices=CHOICES.get(f.name))
    exact = sub.add_parser("exact", help="exact sequences, one tile, a fixed distance")
    for flag in ("--r1", "--r2", "--output-r1", "--output-r2", "--report"):
        exact.add_argument(flag, required=True)
    exact.add_argument("--audit")
    exact.add_argument("--distance", type=int, default=2500)
    exact.add_argument("--unparsed", choices=("error", "keep"), default="error")
    exact.add_argument("--gzip-level", type=int, default=6)
    exact.add_argument("--temp-dir", help="Spark's own folders are used; kept for old command lines")
    exact.add_argument("--threads", type=int, default=0)
    exact.add_argument("--chunk-pairs", type=int, default=20000, help="Spark's own partitions are used")
    exact.add_argument("--force", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    mode = args.pop("mode")
    from tilesieve.plans.run import run, run_exact
    from tilesieve.session import local_session

    spark = local_session(args.get("threads") or None)
    try:
        if mode == "filter":
            run(spark, Config(**args), [sys.executable, *sys.argv])
        else:
            out = run_exact(spark, args["r1"], args["r2"], args["output_r1"], args["output_r2"], args["report"], args["audit"], args["distance"], args["unparsed"], args["gzip_level"], args["force"])
            print(json.dumps(out, indent=2, sort_keys=True))
    except (ValueError, OSError, MemoryError) as why:
        print(f"tilesieve: error: {why}", file=sys.stderr)
        return 2
    return 0
