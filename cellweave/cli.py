"""cellweave-build: command line of the build."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import BuildConfig
from .plans.build import build


def main(argv: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(prog="cellweave-build", description="Builds a spatial store from gazetteer tables.")
    p.add_argument("--config", "-c", help="YAML file; wins over --gazetteer")
    p.add_argument("--gazetteer", "-g", default="swissnames3d", help="a bundled configuration")
    p.add_argument("--db", required=True, help="folder with gazetteer, gaz_source and the source tables")
    p.add_argument("--output", "-o", help="folder of the store")
    a = p.parse_args(argv)
    cfg = BuildConfig.from_yaml(a.config) if a.config else BuildConfig.for_gazetteer(a.gazetteer)
    out = build(SparkSession.builder.getOrCreate(), cfg, a.db, a.output)
    print(out)
    return str(out)


if __name__ == "__main__":
    main()
