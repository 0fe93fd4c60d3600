"""python -m voxmill deconvolution -c run.json | psfgenerator -c psf.json -o folder"""

from __future__ import annotations

import argparse
import os
import sys


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from voxmill import engine
    from voxmill.sources import config

    top = argparse.ArgumentParser(prog="voxmill")
    kinds = top.add_subparsers(dest="kind", required=True)
    for kind in ("deconvolution", "psfgenerator"):
        own = kinds.add_parser(kind)
        own.add_argument("-c", "--config", required=True)
        own.add_argument("-o", "--output", default=".")
    asked = top.parse_args(args)
    spark = SparkSession.builder.appName("voxmill").getOrCreate()
    if asked.kind == "deconvolution":
        result = engine.run(spark, asked.config, spark.sparkContext.defaultParallelism)
        print(result.message)
        return int(not result.success)
    (values,) = config.read_psfs([asked.config])
    psf = engine.make_psf(spark, values)
    engine.save_psf(spark, psf, f"file://{os.path.abspath(asked.output)}")
    config.write_psf(f"{asked.output}/{psf.name}.json", values)
    return 0


if __name__ == "__main__":
    sys.exit(main())
