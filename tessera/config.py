"""Projects: a graph from a configuration (YAML where PyYAML is there, else JSON), its checks, and saving it again."""

from __future__ import annotations

import json

from .plans.graph import Graph
from .plans.transforms import Sequence, read_sequence
from .project import Encoder, Prepro

REQUIRED = ("project_name", "output_dir", "modalities")


def parse(text: str) -> dict:
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        return json.loads(text)


def check(config: dict) -> dict:
    """Required keys must be there; parameters that are one string become a list; images are cached unless told otherwise."""
    missing = [k for k in REQUIRED if k not in config]
    if missing:
        raise ValueError(f"configuration lacks {', '.join(missing)}")
    paths = {}
    for name, path in (config.get("reg_paths") or {}).items():
        params = path.get("reg_params") or ["rigid"]
        paths[name] = path | {"reg_params": [params] if isinstance(params, str) else list(params)}
    return config | {"reg_paths": paths, "cache_images": config.get("cache_images", True)}


#: The preprocessing keys of configurations, and the field that each sets here.
PREPRO = {
    "image_type": "image_type", "ch_indices": "channels", "max_int_proj": "max_projection", "contrast_enhance": "contrast", "invert_intensity": "invert", "as_uint8": "as_uint8", "rot_cc": "rotate", "flip": "flip",
    "crop_to_mask_bbox": "crop_to_mask", "mask_to_bbox": "crop_to_mask", "mask_bbox": "box", "downsampling": "downsampling", "use_mask": "use_mask",
}


def prepro_of(name: str, given: dict | None, functions: dict | None = None) -> Prepro:
    """A block of preprocessing. Unknown keys are refused; own functions are named and looked up in `functions`."""
    given = dict(given or {})
    custom = given.pop("custom_processing", None) or ()
    missing = [f for f in custom if f not in (functions or {})]
    if missing:
        raise ValueError(f"{name}: no function named {', '.join(missing)}")
    if unknown := sorted(set(given) - set(PREPRO)):
        raise ValueError(f"{name}: unknown preprocessing {', '.join(unknown)}")
    values: dict = {}
    for key, field in PREPRO.items():
        if given.get(key) is not None:
            # either of two keys asks for the crop
            values[field] = values.get(field, False) or given[key] if field == "crop_to_mask" else given[key]
    return Prepro(**values, custom=tuple(functions[f] for f in custom))


def prepros(config: dict, functions: dict | None = None) -> dict[str, Prepro]:
    return {name: prepro_of(name, m.get("preprocessing"), functions) for name, m in (config["modalities"] or {}).items()}


def prepro_entry(p: Prepro) -> dict:
    """The block that prepro_of() turns into the same preprocessing."""
    values = {k: getattr(p, v) for k, v in PREPRO.items() if k != "mask_to_bbox"}
    out = {k: list(v) if isinstance(v, tuple) else v for k, v in values.items() if v is not None and v != ()}
    return out | ({"custom_processing": [f.__name__ for f in p.custom]} if p.custom else {})


def load(config: dict, functions: dict | None = None) -> Graph:
    """The graph; preprocessing of images is read by prepros(), and what it refuses is refused here too."""
    config = check(config)
    prepros(config, functions)
    out = Graph()
    for name, m in (config["modalities"] or {}).items():
        res = m.get("output_res")
        out.add_image(name, str(m.get("image_filepath", "")), float(m.get("image_res", 1.0)), m.get("channel_names") or (), str(m.get("mask") or ""), m.get("channel_colors") or (), None if res is None else float(res))
    for path in config["reg_paths"].values():
        own = {k: prepro_of(f"{path['src_modality_name']} ({k})", v, functions) for k, v in (path.get("override_prepro") or {}).items() if v}
        out.add_path(path["src_modality_name"], path["tgt_modality_name"], path.get("thru_modality"), path["reg_params"], own)
    for name, to in (config.get("attachment_images") or {}).items():
        out.attach_image(to["attachment_modality"], name, str(to.get("image_filepath", "")), to.get("channel_names") or (), to.get("channel_colors") or ())
    for name, to in (config.get("attachment_shapes") or {}).items():
        out.attach_shapes(to["attachment_modality"], name)
    for name, members in (config.get("merge_modalities") or {}).items():
        out.add_merge(name, members if isinstance(members, (list, tuple)) else members["modalities"])
    return out


def dump(graph: Graph, project_name: str, output_dir: str, prepro: dict[str, Prepro] | None = None) -> dict:
    """The configuration that load() turns into the same graph, attachments and merges included, and prepros() into the same preprocessing."""
    prepro = prepro or {}
    own = [n for n in graph.nodes.values() if n.attached_to is None]

    def path_entry(source: str, steps: tuple) -> dict:
        e = next(e for e in graph.edges if e.source == source)
        override = {k: prepro_entry(v) for k, v in (("source", e.source_prepro), ("target", e.target_prepro)) if v is not None}
        return {"src_modality_name": source, "tgt_modality_name": steps[-1], "thru_modality": steps[0] if len(steps) > 1 else None, "reg_params": list(e.params)} | ({"override_prepro": override} if override else {})

    def node_entry(n) -> dict:
        out = {"image_filepath": n.image, "image_res": n.image_res, "channel_names": list(n.channel_names)}
        out |= {k: v for k, v in (("channel_colors", list(n.channel_colors)), ("mask", n.mask), ("output_res", n.output_res)) if v}
        return out | ({"preprocessing": prepro_entry(prepro[n.name])} if n.name in prepro else {})

    return {
        "project_name": project_name,
        "output_dir": output_dir,
        "modalities": {n.name: node_entry(n) for n in own},
        "reg_paths": {f"reg_path_{k}": path_entry(s, steps) for k, (s, steps) in enumerate(graph.paths.items())},
        "attachment_images": {n.name: {"attachment_modality": n.attached_to, "image_filepath": n.image} | ({"channel_names": list(n.channel_names)} if n.channel_names else {}) for n in graph.nodes.values() if n.attached_to},
        "attachment_shapes": {s: {"attachment_modality": n} for s, n in graph.shapes.items()},
        "merge_modalities": {m: list(x) for m, x in graph.merges.items()},
    }


def text_of(config: dict) -> str:
    """A configuration as text: JSON, which YAML's readers read too."""
    return json.dumps(config, indent=1, cls=Encoder)


def entry_of(t) -> dict:
    """A transform as the key-to-values map of a parameter file."""
    from .plans.transforms import FILE_KINDS, INTERPOLATORS

    kinds, interpolators = ({v: k for k, v in d.items()} for d in (FILE_KINDS, INTERPOLATORS))
    words = lambda values: [repr(v) if isinstance(v, float) else str(v) for v in values]
    out = {"Transform": [kinds[t.kind]], "TransformParameters": words(t.params), "CenterOfRotationPoint": words(t.center), "Size": words(t.size), "Spacing": words(t.spacing), "Origin": words(t.origin), "ResampleInterpolator": [interpolators[t.interpolator]]}
    if t.kind == "bspline":
        out |= {"GridSize": words(t.grid_size), "GridSpacing": words(t.grid_spacing), "GridOrigin": words(t.grid_origin)}
    return out


def save_transforms(initial: list, hops: list[tuple[str, list]]) -> str:
    """JSON of a path's transforms: the image's own ones under "initial", then each hop's under NNN-to-target."""
    out: dict = {"initial": [entry_of(t) for t in initial]} if initial else {}
    out |= {f"{k:03d}-to-{target}": [entry_of(t) for t in ts] for k, (target, ts) in enumerate(hops)}
    return json.dumps(out, indent=1)


def load_transforms(text: str) -> Sequence:
    return read_sequence(text)
