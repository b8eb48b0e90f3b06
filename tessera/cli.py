"""Command line: checks a configuration and shows what would be aligned and written, carries it out, or maps an image or a shape file through saved transforms."""

from __future__ import annotations

import argparse
from pathlib import Path

from . import config, runner


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    plan = commands.add_parser("plan", help="paths and outputs of a project")
    plan.add_argument("config")
    do = commands.add_parser("run", help="read, align, map and write a project")
    do.add_argument("config")
    do.add_argument("--output", help="folder in place of the configuration's output_dir")
    do.add_argument("--tile", type=int, default=512)
    do.add_argument("--kind", choices=runner.FORMATS, default="tiles", help="what images are written as")
    do.add_argument("--keep-crop", action="store_true", help="write targets' crops alone, not their whole extent")
    do.add_argument("--match-histograms", action="store_true", help="give moving planes the fixed ones' distribution before alignment")
    image = commands.add_parser("image", help="map one image through transforms")
    for name in ("image", "transforms", "output"):
        image.add_argument(name)
    image.add_argument("--tile", type=int, default=512)
    image.add_argument("--source-res", type=float, default=None, help="the image's pixel size, where its file doesn't say")
    image.add_argument("--interpolation", choices=("nearest", "linear"), default="nearest")
    move = commands.add_parser("shapes", help="map GeoJSON through transforms")
    for name in ("shapes", "transforms", "output"):
        move.add_argument(name)
    move.add_argument("--source-res", type=float, default=1.0)
    got = parser.parse_args(args)
    if got.command == "plan":
        graph = config.load(config.parse(Path(got.config).read_text()))
        for name, hops in graph.transform_paths().items():
            print(name, *(f"-> {e.target} ({', '.join(e.params)})" for e in hops))
        print("writes:", ", ".join(graph.outputs()))
        return 0
    from pyspark.sql import SparkSession

    from .operators import shapes
    from .sources import text

    spark = SparkSession.builder.getOrCreate()
    if got.command == "run":
        print(*runner.run(spark, config.parse(Path(got.config).read_text()), got.output, got.tile, got.kind, to_original_size=not got.keep_crop, match=got.match_histograms), sep="\n")
        return 0
    if got.command == "image":
        runner.transform_file(spark, got.image, config.load_transforms(Path(got.transforms).read_text()), got.output, got.tile, got.interpolation, got.source_res)
        print(got.output)
        return 0
    sequence = config.load_transforms(Path(got.transforms).read_text())
    text.write_geojson(shapes.to_geojson(shapes.transform(text.read_geojson(spark, got.shapes), sequence, source_res=got.source_res)), got.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
