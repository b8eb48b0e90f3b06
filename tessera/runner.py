"""A configuration carried out: images read, edges aligned, images and shapes mapped and written with their transforms.

An image without a path is written on its own grid. Outputs have the target's resolution, or the image's output_res, and the
target's whole extent: its crop is undone unless told otherwise. The output folder is one that driver and tasks can write to.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as cf
from . import workers
from .functions.names import merge_names
from .operators import register, resample, shapes
from .plots import write_plots
from .project import Project
from .sources import formats, images, text

FORMATS = ("tiles", "tiff", "zarr")


def read_image(spark: SparkSession, path: str, tile: int) -> tuple[DataFrame, formats.Info]:
    """Tiles of the full size on a grid, and what the file says of the image."""
    return formats.retiled(formats.read(spark, path), tile).drop("level"), formats.info(spark, path)


def write_image(tiles: DataFrame, path: str, kind: str, size: tuple[int, int], channels: int, dtype: str, tile: int, names: list[str], rgb: bool, res: float, pyramid: bool = True, colors: tuple[str, ...] = ()) -> None:
    """Tiles of the full size (without a level) as one of FORMATS. Tiles that are missing are 0."""
    if len(names) != channels or (colors and len(colors) != channels):
        raise ValueError(f"{path}: {channels} channels, but {len(names)} names and {len(colors)} colours")
    if kind == "tiles":
        images.write_tiles(tiles.withColumn("level", F.lit(0)).select(*images.NAMES), path)
        return
    # each level reads the full size, which is made once and kept beside the file until that is written
    staged = f"{path}.parts"
    images.write_tiles(tiles.withColumn("level", F.lit(0)).select(*images.NAMES), staged)
    tiles = images.read_tiles(tiles.sparkSession, staged).drop("level")
    if kind == "tiff":
        images.write_tiff(tiles, path, size, channels, dtype, tile, tuple(names), rgb, res, pyramid)
    else:
        images.write_chunks(tiles, path, size, channels, dtype, tile, tuple(names), pyramid, colors)
    system, where = images.opened(staged)
    system.delete_dir(where)


def check_merge(name: str, infos: list[formats.Info], sequences: list) -> None:
    """Members of a merge are written on one grid, and colours can't be merged with channels."""
    if len({(s.size, s.spacing) for s in sequences}) > 1:
        raise ValueError(f"{name}: its members have several grids: {', '.join(str(s.size) for s in sequences)}")
    if len(infos) > 1 and any(i.rgb for i in infos) and not all(i.rgb for i in infos):
        raise ValueError(f"{name}: colours and channels can't be merged")


def run(spark: SparkSession, config: dict, output: str | None = None, tile: int = 512, kind: str = "tiles", models: dict[str, register.Model] = register.MODELS, to_original_size: bool = True, match: bool = False) -> list[str]:
    """Writes <output>/<name>.<kind> for every image of Graph.outputs() (tiles that are all outside aren't made and are 0), each path's transforms and alignment log, each shape file and the configuration. Returns the paths."""
    if kind not in FORMATS or tile % 16:
        raise ValueError("kind is one of tiles, tiff and zarr, and a tile's side a multiple of 16")
    workers.ready(spark)
    config = cf.check(config)
    output = str(output or config["output_dir"]).rstrip("/")
    Path(output).mkdir(parents=True, exist_ok=True)
    graph = cf.load(config)
    read = {name: read_image(spark, node.image, tile) for name, node in graph.nodes.items()}
    tiles, infos = {n: t for n, (t, _) in read.items()}, {n: i for n, (_, i) in read.items()}
    own = cf.prepros(config)
    pixels = {n: resample.to_pixels(t) for n, t in tiles.items()}
    masks = {name: formats.read_mask(spark, node.mask, infos[name].size, name) for name, node in graph.nodes.items() if node.mask}
    project = Project(graph, pixels, {n: i.size for n, i in infos.items()}, own, {n for n, i in infos.items() if i.rgb}, masks=masks, cache=f"{output}/cache" if config["cache_images"] else None)
    project.register(spark, models, match)
    written = []
    for name in graph.outputs():
        members = graph.merges.get(name, (name,))
        sequences = [project.output(m, to_original_size) for m in members]
        check_merge(name, [infos[m] for m in members], sequences)
        # of several types the widest
        dtype = str(np.result_type(*(infos[m].dtype for m in members)))
        df, before = None, 0
        for m, sequence in zip(members, sequences, strict=True):
            one = resample.resample_tiles(tiles[m], infos[m].size, sequence, graph.nodes[m].image_res, tile)
            one = one.withColumn("image_id", F.lit(name)).withColumn("channel", (F.col("channel") + before).cast("int"))
            before += infos[m].channels
            df = one if df is None else df.unionByName(one)
        of = [list(graph.nodes[m].channel_names or infos[m].names) for m in members]
        of = [n if len(n) == infos[m].channels else [f"C{k}" for k in range(infos[m].channels)] for m, n in zip(members, of, strict=True)]
        names = of[0] if len(members) == 1 else merge_names(list(members), of)
        path = f"{output}/{name}.{kind}"
        rgb = len(members) == 1 and infos[members[0]].rgb
        colors = tuple(c for m in members for c in graph.nodes[m].channel_colors)
        write_image(df, path, kind, sequences[0].size, before, dtype, tile, names, rgb, sequences[0].spacing[0], colors=colors if len(colors) == before else ())
        written.append(path)
    for name, hops in graph.transform_paths().items():
        path = f"{output}/{name}_transformations.json"
        Path(path).write_text(cf.save_transforms(project.initial.get(name, []), [(e.target, list(e.transforms)) for e in hops]))
        written.append(path)
        if name in project.logs:
            written += write_plots(project.logs[name], f"{output}/{name}_iterations")
    for name, to in (config.get("attachment_shapes") or {}).items():
        for k, file in enumerate(to.get("shape_files") or []):
            file = file if isinstance(file, str) else file["shape_fp"]
            image = graph.shapes[name]
            path = f"{output}/{name}_{k}.geojson"
            moved = shapes.transform(text.read_geojson(spark, file), project.output(image, to_original_size), source_res=graph.nodes[image].image_res)
            text.write_geojson(shapes.to_geojson(moved), path)
            written.append(path)
    path = f"{output}/{config['project_name']}_configuration.json"
    Path(path).write_text(cf.text_of(cf.dump(graph, config["project_name"], output, own)))
    return [*written, path]


def transform_file(spark: SparkSession, source: str, transforms, output: str, tile: int = 512, interpolation: str = "nearest", res: float | None = None, pyramid: bool = True) -> None:
    """One image through a sequence, transform JSON or a list of key-to-values maps, written as what the output's suffix says. res: the source's pixel size, else what its file says, else 1."""
    kind = {"tif": "tiff"}.get(formats.suffix(output), formats.suffix(output))
    if kind not in FORMATS:
        raise ValueError(f"{output}: one of .tiff, .zarr and .tiles is written")
    workers.ready(spark)
    tiles, info = read_image(spark, source, tile)
    sequence = resample.sequence_of(transforms)
    moved = resample.resample_tiles(tiles, info.size, sequence, res or info.res or 1.0, tile, interpolation)
    names = list(info.names) or [f"C{k}" for k in range(info.channels)]
    write_image(moved, output, kind, sequence.size, info.channels, info.dtype, tile, names, info.rgb, sequence.spacing[0], pyramid)
