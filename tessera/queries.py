"""Queries of the alignment engine over the driver's tables, with the SQL that checks them.

The tables stand in for images and shapes: `embeddings` is a plane (y = vec_id, x = the component's place, v = the component
as 8 bits), orders are shapes whose vertices are their line items, and customer - nation - region is the graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workers
from .functions import names
from .operators import pixels as px
from .operators import resample, shapes
from .plans import graph
from .plans import transforms as tf
from .sources import images, text
from .streaming import iterations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def t(spark, sf_dir: str, name: str) -> DataFrame:
    workers.ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark, sf_dir: str) -> DataFrame:
    """(image_id, channel, y, x, v): the embeddings as an 8-bit image of one channel."""
    rows = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1.0) * 128.0))).cast("double")
    return rows.select(F.lit("plane").alias("image_id"), F.lit(0).alias("channel"), F.col("vec_id").alias("y"), F.col("x").cast("long").alias("x"), v.alias("v"))


def channels(spark, sf_dir: str) -> DataFrame:
    """The same as four channels of 16 columns."""
    return plane(spark, sf_dir).withColumns({"channel": F.floor(F.col("x") / 16).cast("int"), "x": F.col("x") % 16})


P = "p as (select vec_id as y, x::bigint as x, greatest(0, least(255, floor((e::double + 1.0) * 128.0)))::double as v from (select vec_id, unnest(generate_series(0, len(embedding) - 1)) as x, unnest(embedding) as e from embeddings))"
C = P + ", c as (select (x // 16)::integer as channel, y, x % 16 as x, v from p)"


def points(spark, sf_dir: str) -> DataFrame:
    """Line items as points."""
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 1000).cast("double").alias("y"))


L = "l as (select l_orderkey, l_linenumber, (l_partkey % 1000)::double as x, (l_suppkey % 1000)::double as y from lineitem)"


def rings(spark, sf_dir: str) -> DataFrame:
    """The same as vertices of their order, numbered anew, as line numbers repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("vertex"), "l_linenumber", (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 1000).cast("double").alias("y"))
    return rows


V = "l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::integer as vertex, l_linenumber, (l_partkey % 1000)::double as x, (l_suppkey % 1000)::double as y from lineitem)"


def r6(*columns: str):
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


def r6_(named):
    return [(F.round(c, 6) + 0.0).alias(n) for n, c in named]


# --- graph


def edge_table(spark, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("target"))
    n = t(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("target"))
    return c.unionByName(n)


EDGES = "e as (select 'C' || c_custkey as source, 'N' || c_nationkey as target from customer union all select 'N' || n_nationkey, 'R' || n_regionkey from nation)"
WALK = f"with recursive {EDGES}, w(start, hop, source, target, seen) as (select source, 0, source, target, [source] from e union all select w.start, w.hop + 1, e.source, e.target, list_append(w.seen, e.source) from w join e on w.target = e.source where not list_contains(w.seen, e.source))"


@query(f"{WALK} select start, hop, source, target from w")
def path_resolve(spark, sf_dir):
    return graph.resolve(edge_table(spark, sf_dir)).select("start", F.col("hop").cast("int").alias("hop"), "source", "target")


@query(f"{WALK} select start, count(*) as n_hops, arg_max(target, hop) as final, string_agg(lpad(hop::varchar, 3, '0') || '-to-' || target, ',' order by hop) as labels from w group by start")
def path_hops(spark, sf_dir):
    w = graph.resolve(edge_table(spark, sf_dir))
    label = F.struct("hop", names.hop_label(F.col("hop"), F.col("target")).alias("label"))
    return w.groupBy("start").agg(F.count("*").alias("n_hops"), F.max_by("target", "hop").alias("final"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(label)), lambda s: s["label"])).alias("labels"))


@query(f"with {EDGES} select distinct target as name from e where target not in (select source from e)")
def nonreg_nodes(spark, sf_dir):
    return graph.finals(edge_table(spark, sf_dir))


@query("with gone as (select n_nationkey from nation where n_regionkey = 1) select c_custkey from customer where c_nationkey not in (select n_nationkey from gone)")
def cascade_remove(spark, sf_dir):
    """A removed region takes the paths through it with it."""
    walk = graph.resolve(edge_table(spark, sf_dir))
    left = graph.without(walk, spark.createDataFrame([("R1",)], "name string"))
    return left.filter("hop = 0 and start like 'C%'").select(F.expr("cast(substring(start, 2) as bigint)").alias("c_custkey"))


@query("select count(*) as n, count(*) filter (exists (select 1 from customer where c_custkey = o_custkey)) as attached from orders")
def fk_check(spark, sf_dir):
    """Attachments whose node is there."""
    o, c = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    lost = graph.strays(o, c, "o_custkey").agg(F.count("*").alias("lost"))
    return o.agg(F.count("*").alias("n")).crossJoin(lost).select("n", (F.col("n") - F.col("lost")).alias("attached"))


# --- transforms of points

AFFINE = tf.Transform("affine", (0.75, 0.05, -0.125, 1.0, 31.5, -44.25), (640.0, 480.0))
EULER = tf.Transform("euler", (0.3, 12.0, -7.0), (500.0, 400.0))
SIMILARITY = tf.Transform("similarity", (1.25, -0.2, 3.0, 4.0), (500.0, 400.0))
SHIFT = tf.Transform("translation", (17.5, -2.25))


def _points_by(m: np.ndarray):
    def run(spark, sf_dir):
        x, y = tf.mapped(F.col("x"), F.col("y"), m)
        return points(spark, sf_dir).select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).select("l_orderkey", "l_linenumber", *r6("x", "y"))

    return run


def _points_sql(x: str, y: str) -> str:
    return f"with {L} select l_orderkey, l_linenumber, round({x}, 6) + 0.0 as x, round({y}, 6) + 0.0 as y from l"


AX, AY = "0.75 * (x - 640.0) + 0.05 * (y - 480.0) + 640.0 + 31.5", "-0.125 * (x - 640.0) + 1.0 * (y - 480.0) + 480.0 - 44.25"
EX, EY = "cos(0.3) * (x - 500.0) - sin(0.3) * (y - 400.0) + 500.0 + 12.0", "sin(0.3) * (x - 500.0) + cos(0.3) * (y - 400.0) + 400.0 - 7.0"
for _name, _t, _x, _y in (
    ("affine_points", AFFINE, AX, AY),
    ("euler_points", EULER, EX, EY),
    ("similarity_points", SIMILARITY, "1.25 * (cos(-0.2) * (x - 500.0) - sin(-0.2) * (y - 400.0)) + 500.0 + 3.0", "1.25 * (sin(-0.2) * (x - 500.0) + cos(-0.2) * (y - 400.0)) + 400.0 + 4.0"),
    ("translation_points", SHIFT, "x + 17.5", "y - 2.25"),
):
    QUERIES[_name], ORACLE[_name] = _points_by(_t.matrix()), _points_sql(_x, _y)
_det = "(0.75 * 1.0 + 0.05 * 0.125)"
QUERIES["inverse_points"] = _points_by(AFFINE.inverse())
ORACLE["inverse_points"] = _points_sql(f"(1.0 * (x - 671.5) - 0.05 * (y - 435.75)) / {_det} + 640.0", f"(0.125 * (x - 671.5) + 0.75 * (y - 435.75)) / {_det} + 480.0")
QUERIES["compose_points"] = _points_by(tf.Sequence().add([EULER, AFFINE], [0, 1]).composite())
ORACLE["compose_points"] = f"with {L}, a as (select l_orderkey, l_linenumber, {AX} as x, {AY} as y from l) select l_orderkey, l_linenumber, round({EX}, 6) + 0.0 as x, round({EY}, 6) + 0.0 as y from a"


@query(f"with {V} select l_orderkey, vertex, l_linenumber + coalesce(sum(l_linenumber) over (partition by l_orderkey order by vertex rows between unbounded preceding and 1 preceding), 0)::bigint as seq_idx, row_number() over (partition by l_orderkey order by vertex desc)::integer as reversed from l")
def seq_reindex(spark, sf_dir):
    """Each order as a sequence: groups counted on from those before, and places reversed."""
    return tf.reindexed(rings(spark, sf_dir), "l_orderkey", "vertex", "l_linenumber").select("l_orderkey", "vertex", "seq_idx", "reversed")


# --- sizes

SIZES = "s as (select p_partkey, (p_size * 37 + 11)::double as w, (p_size * 23 + 5)::double as h from part)"


def sizes(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 11).cast("double").alias("w"), (F.col("p_size") * 23 + 5).cast("double").alias("h"))


@query(f"with {SIZES} select p_partkey, ceil(w * 0.65 / 2.0)::bigint as w, ceil(h * 0.65 / 2.0)::bigint as h from s")
def output_size(spark, sf_dir):
    w, h = tf.Sequence(size=(F.col("w"), F.col("h")), spacing=(0.65, 0.65)).with_spacing((2.0, 2.0)).size
    return sizes(spark, sf_dir).select("p_partkey", w.alias("w"), h.alias("h"))


@query(f"with {SIZES} select p_partkey, round(h * abs(sin(radians(30))) + w * abs(cos(radians(30))), 6) as bw, round(h * abs(cos(radians(30))) + w * abs(sin(radians(30))), 6) as bh from s")
def rot_bound(spark, sf_dir):
    w, h = tf.rotation_bound(F.col("w"), F.col("h"), 30)
    return sizes(spark, sf_dir).select("p_partkey", F.round(w, 6).alias("bw"), F.round(h, 6).alias("bh"))


@query(f"with {SIZES}, b as (select *, h as bw, w as bh from s) select p_partkey, round((bw - 1) / 2 * 0.5, 6) as cx, round((bh - 1) / 2 * 0.5, 6) as cy, round((w - bw) / 2 * 0.5, 6) + 0.0 as tx, round((h - bh) / 2 * 0.5, 6) + 0.0 as ty from b")
def rot_params(spark, sf_dir):
    """A quarter turn's centre and shift at spacing 0.5."""
    turn = tf.rotation((F.col("w"), F.col("h")), 0.5, 90)
    return sizes(spark, sf_dir).select("p_partkey", *r6_(zip(("cx", "cy", "tx", "ty"), (*turn.center, *turn.params[1:]), strict=True)))


@query(f"with {SIZES} select p_partkey, -1.0::double as a11, 1.0::double as a22, (w - 1) / 2 * 0.5 as cx, (h - 1) / 2 * 0.5 as cy, floor(w / 4) * 0.5 as crop_tx, floor(h / 4) * 0.5 as crop_ty, floor(w / 2)::bigint as crop_w, floor(h / 2)::bigint as crop_h from s")
def flip_crop_params(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    mirror, cut = tf.flip((w, h), 0.5, "h"), tf.crop((F.floor(w / 4), F.floor(h / 4), F.floor(w / 2), F.floor(h / 2)), 0.5)
    named = {"a11": F.lit(mirror.params[0]), "a22": F.lit(mirror.params[3]), "cx": mirror.center[0], "cy": mirror.center[1], "crop_tx": cut.params[0], "crop_ty": cut.params[1]}
    return sizes(spark, sf_dir).select("p_partkey", *[c.cast("double").alias(n) for n, c in named.items()], cut.size[0].alias("crop_w"), cut.size[1].alias("crop_h"))


# --- shapes


@query(f"with {L} select l_orderkey, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*) as n_vertices from l group by l_orderkey")
def shape_bbox(spark, sf_dir):
    return shapes.bounding_boxes(points(spark, sf_dir), "l_orderkey")


@query(f"with {L} select l_orderkey, l_linenumber, x * 0.25 as x, y * 0.25 as y from l")
def shape_scale(spark, sf_dir):
    return shapes.scale(points(spark, sf_dir), 0.25)


@query(f"with {V}, v as (select l_orderkey, vertex, x, y from l), e as (select l_orderkey, arg_min(x, vertex) as ax, arg_min(y, vertex) as ay, arg_max(x, vertex) as bx, arg_max(y, vertex) as b_y, max(vertex) as n from l group by l_orderkey) select * from v union all select l_orderkey, (n + 1)::integer, ax, ay from e where ax <> bx or ay <> b_y")
def ring_close(spark, sf_dir):
    return shapes.close_rings(rings(spark, sf_dir).drop("l_linenumber"), ("l_orderkey",), "vertex")


@query(f"with {V} select l_orderkey, string_agg(round(0.955336489125606 * (x * 0.5 - 512.0 - 0.0) + 0.29552020666133955 * (y * 0.5 - 393.0) + 500.0, 3)::decimal(18,3)::varchar, ';' order by vertex) as xs, count(*) as n from l group by l_orderkey")
def shape_transform(spark, sf_dir):
    """Vertices at 0.5 a pixel mapped by the inverse of a turn, collected again in order."""
    seq = tf.Sequence().add([EULER])
    moved = shapes.transform(rings(spark, sf_dir), seq, pixels_in=True, source_res=0.5, pixels_out=False)
    s = F.struct("vertex", F.round("x", 3).cast("decimal(18,3)").cast("string").alias("t"))
    return moved.groupBy("l_orderkey").agg(F.concat_ws(";", F.transform(F.sort_array(F.collect_list(s)), lambda s: s["t"])).alias("xs"), F.count("*").alias("n"))


# --- pixels


@query(f"with {C}, w as (select y, x, max(v) filter (channel = 0) as r, max(v) filter (channel = 1) as g, max(v) filter (channel = 2) as b from c group by y, x) select y, x, (floor(0.2125 * r) + floor(0.7154 * g) + floor(0.0721 * b))::double as v from w")
def grayscale(spark, sf_dir):
    return px.grayscale_image(channels(spark, sf_dir)).select("y", "x", "v")


@query(f"with {C}, m as (select channel, min(v) as a, max(v) as b from c group by channel) select c.channel, y, x, case when b > a then floor((v - a) * 255.0 / (b - a)) else 0 end::double as v from c join m using (channel)")
def rescale_u8(spark, sf_dir):
    return px.rescale(channels(spark, sf_dir), ("channel",)).select("channel", "y", "x", "v")


@query(f"with {P} select y, x, least(255.0, abs(7 * v + 1))::double as contrast, (255.0 - v)::double as inverted, floor(v / 256)::bigint as high, (v >= 128)::integer as mask from p")
def contrast_invert(spark, sf_dir):
    v = F.col("v")
    return plane(spark, sf_dir).select("y", "x", px.contrast(v).alias("contrast"), px.invert(v).alias("inverted"), px.as_uint8(v).alias("high"), (v >= 128).cast("int").alias("mask"))


@query(f"with {C} select y, x, max(v) as v from c group by y, x")
def max_projection(spark, sf_dir):
    return px.max_projection(channels(spark, sf_dir)).select("y", "x", "v")


@query(f"with {C} select (case channel when 3 then 0 else 1 end)::integer as channel, y, x, v from c where channel in (3, 1)")
def channel_select(spark, sf_dir):
    return px.select_channels(channels(spark, sf_dir), [3, 1]).select("channel", "y", "x", "v")


@query(f"with {C} select y, x, v from c where channel = 0")
def channel_fallback(spark, sf_dir):
    """A channel that isn't there gives the first."""
    return px.single_channel(channels(spark, sf_dir), 9).select("y", "x", "v")


@query(f"with {P} select y // 3 as y, x // 3 as x, v from p where y % 3 = 0 and x % 3 = 0 and x // 3 < 64 // 3 and y // 3 < (select max(y) + 1 from p) // 3")
def shrink(spark, sf_dir):
    return px.shrink(plane(spark, sf_dir), 3).select("y", "x", "v")


@query(f"with {P} select y, 63 - x as x, v from p")
def flip_h(spark, sf_dir):
    return px.flip(plane(spark, sf_dir), "h", 64, 0).select("y", F.col("x").cast("long").alias("x"), "v")


@query(f"with {P} select (select max(y) from p) - y as y, x, v from p")
def flip_v(spark, sf_dir):
    p = plane(spark, sf_dir)
    h = t(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    return px.flip(p, "v", 64, h).select("y", "x", "v")


@query(f"with {P} select 63 - x as y, y as x, v from p")
def rot90(spark, sf_dir):
    return px.rotate90(plane(spark, sf_dir), 64).select(F.col("y").cast("long").alias("y"), "x", "v")


@query(f"with {P} select y - 100 as y, x - 8 as x, v from p where x >= 8 and x < 40 and y >= 100 and y < 300")
def crop(spark, sf_dir):
    return px.crop(plane(spark, sf_dir), 8, 100, 32, 200).select("y", "x", "v")


@query(f"with {P}, b as (select max(x) as mx, max(y) as my, min(x) filter (v >= 170) as x0, min(y) filter (v >= 170) as y0, max(x) filter (v >= 170) as x1, max(y) filter (v >= 170) as y1 from p) select greatest(x0 - 3, 0)::bigint as x, greatest(y0 - 3, 0)::bigint as y, (least(x1 + 4, mx + 1) - greatest(x0 - 3, 0))::bigint as w, (least(y1 + 4, my + 1) - greatest(y0 - 3, 0))::bigint as h from b where x0 is not null")
def mask_bbox_padded(spark, sf_dir):
    mask = plane(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 170, 255.0).otherwise(0.0))
    return px.mask_box(mask, 3).select(*[F.col(c).cast("long").alias(c) for c in "xywh"])


TURN = np.array([[0.8, 0.3, 2.25], [-0.2, 1.1, 5.5], [0, 0, 1.0]])


@query(f"with {P}, o as (select y, x, floor(round(x * 0.8 + y * 0.3 + 2.25, 9) + 0.5)::bigint as sx, floor(round(x * -0.2 + y * 1.1 + 5.5, 9) + 0.5)::bigint as sy from (select unnest(generate_series(0, 79)) as x), (select unnest(generate_series(0, 199)) as y)) select o.y::bigint as y, o.x::bigint as x, coalesce(p.v, 0.0) as v from o left join p on p.x = sx and p.y = sy")
def nearest_resample(spark, sf_dir):
    return resample.nearest(plane(spark, sf_dir), (80, 200), TURN)


@query("with t as (select ty, tx, ty * 64 as y0, tx * 64 as x0 from (select unnest(generate_series(0, 15)) as ty), (select unnest(generate_series(0, 9)) as tx)), b as (select *, least(64, 1000 - y0) as h, least(64, 600 - x0) as w from t), k as (select *, unnest([0, 0, 1, 1]) as dx, unnest([0, 1, 0, 1]) as dy from b), m as (select ty, tx, floor(min((x0 + dx * (w - 1)) * 0.8 + (y0 + dy * (h - 1)) * 0.3 + 2.25)) - 2 as ax, ceil(max((x0 + dx * (w - 1)) * 0.8 + (y0 + dy * (h - 1)) * 0.3 + 2.25)) + 2 as bx, floor(min((x0 + dx * (w - 1)) * -0.2 + (y0 + dy * (h - 1)) * 1.1 + 5.5)) - 2 as ay, ceil(max((x0 + dx * (w - 1)) * -0.2 + (y0 + dy * (h - 1)) * 1.1 + 5.5)) + 2 as by_ from k group by ty, tx), s as (select unnest(generate_series(0, 7)) as sy), u as (select unnest(generate_series(0, 7)) as sx) select ty::integer as ty, tx::integer as tx, sy::integer as sy, sx::integer as sx from m, s, u where bx >= 0 and by_ >= 0 and ax < 512 and ay < 512 and sx * 64 <= bx and sx * 64 + 64 > ax and sy * 64 <= by_ and sy * 64 + 64 > ay")
def tile_overlap_join(spark, sf_dir):
    """Output tiles of a 600 x 1000 grid against the tiles of a 512 x 512 source."""
    return resample.source_tiles(resample.tile_index(spark, 600, 1000, 64), TURN, (512, 512), 64)


def _level(k: int):
    def run(spark, sf_dir):
        h = t(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
        return px.pyramid_level(plane(spark, sf_dir), k, 64, h).select("y", "x", "v")

    return run


for _k in (1, 2, 3):
    QUERIES[f"pyramid_l{_k}"] = _level(_k)
    ORACLE[f"pyramid_l{_k}"] = f"with {P} select y // {1 << _k} as y, x // {1 << _k} as x, floor(round(avg(v), 9))::double as v from p where y < (select max(y) + 1 from p) // {1 << _k} * {1 << _k} group by all"


@query("with s as (select p_partkey, p_size * 97 as w, p_size * 53 + 40 as h from part), n as (select *, unnest(generate_series(0, 20)) as k from s) select p_partkey, k::integer as level, (w // (1 << k))::bigint as w, (h // (1 << k))::bigint as h from n where k = 0 or (least(w, h) // (1 << k) > 64)")
def pyramid_levels(spark, sf_dir):
    """Levels of images of many sizes at tile 64."""
    return px.pyramid_table(t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).alias("w"), (F.col("p_size") * 53 + 40).alias("h")), 64)


@query(f"with {C} select channel, y, x, v, 'a' as source from c union all select (channel + 4)::integer, y, x, 255.0 - v, 'b' from c where channel < 2")
def merge_channels(spark, sf_dir):
    c = channels(spark, sf_dir)
    other = c.filter("channel < 2").withColumn("v", 255.0 - F.col("v"))
    return px.merge_channels([("a", c), ("b", other)]).select("channel", "y", "x", "v", "source")


@query("select p_brand || ' - ' || p_name as name, arg_max(p_type, p_partkey) as widest, count(*) as n from part group by 1")
def merge_names(spark, sf_dir):
    return t(spark, sf_dir, "part").select(names.merged_name(F.col("p_brand"), F.col("p_name")).alias("name"), "p_type", "p_partkey").groupBy("name").agg(F.max_by("p_type", "p_partkey").alias("widest"), F.count("*").alias("n"))


@query("select o_orderkey, case when o_orderkey * 7 <= 255 then 'uint8' when o_orderkey * 7 <= 65535 then 'uint16' else 'int32' end as dtype from orders")
def dtype_pick(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", px.narrowest(F.col("o_orderkey") * 7).alias("dtype"))


@query(f"with {C}, s as (select * from c where channel in (1, 2)), m as (select channel, min(v) as a, max(v) as b from s group by channel), r as (select y, x, max(case when b > a then floor((v - a) * 255.0 / (b - a)) else 0 end) as v from s join m using (channel) group by y, x) select y, x, least(255.0, abs(v * 7 + 1))::double as v from r")
def preprocess_intensity(spark, sf_dir):
    """Two of four channels made one plane for alignment: rescaled, projected, their contrast raised; inversion isn't for fluorescence."""
    from .project import Prepro, intensity

    return intensity(channels(spark, sf_dir), Prepro(channels=(1, 2), contrast=True, invert=True)).select("y", "x", "v")


@query(f"with {P}, h as (select (max(y) + 1) // 2 as h from p), s as (select y // 2 as y, 31 - x // 2 as x, v from p, h where y % 2 = 0 and x % 2 = 0 and y // 2 < h) select y - 10 as y, x - 3 as x, v from s where x >= 3 and x < 23 and y >= 10 and y < 110")
def preprocess_spatial(spark, sf_dir):
    """Shrunk, mirrored, cropped, in this order."""
    from .project import Prepro, spatial

    h = t(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    out, steps, size, res = spatial(plane(spark, sf_dir), Prepro(downsampling=2, flip="h", box=(3, 10, 20, 100)), (64, h), 1.0)
    assert size == (20, 100) and res == 2.0 and [x.kind for x in steps] == ["affine", "translation"]
    return out.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


# --- metrics

PAIRS = C + ", q as (select a.v / 256 as a, b.v / 256 as b from c a join c b on a.y = b.y and a.x = b.x where a.channel = 0 and b.channel = 1)"


def pairs(spark, sf_dir):
    c = channels(spark, sf_dir)
    wide = c.filter("channel < 2").groupBy("y", "x").agg(F.max(F.when(F.col("channel") == 0, F.col("v") / 256)).alias("a"), F.max(F.when(F.col("channel") == 1, F.col("v") / 256)).alias("b"))
    return wide.select("a", "b")


@query(f"with {PAIRS} select least(floor(a * 16), 15)::bigint as a, least(floor(b * 16), 15)::bigint as b, count(*) as n from q group by 1, 2")
def joint_hist(spark, sf_dir):
    return px.joint_histogram(pairs(spark, sf_dir), 16).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


@query(f"with {PAIRS}, h as (select least(floor(a * 16), 15) as a, least(floor(b * 16), 15) as b, count(*)::double as n from q group by 1, 2), m as (select n, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as total from h) select round(sum(n / total * ln(n * total / (na * nb))), 6) as mi from m")
def mutual_info(spark, sf_dir):
    return px.mutual_information(px.joint_histogram(pairs(spark, sf_dir), 16)).select(F.round("mi", 6).alias("mi"))


@query(f"with {PAIRS} select round(avg((a - b) * (a - b)), 8) as msq, round(corr(a, b), 8) as ncc from q")
def mean_squares_correlation(spark, sf_dir):
    q = pairs(spark, sf_dir)
    return px.mean_squares(q).crossJoin(px.normalised_correlation(q)).select(F.round("msq", 8).alias("msq"), F.round("ncc", 8).alias("ncc"))


@query(f"with {PAIRS}, m as (select a >= 0.5 as a, b >= 0.5 as b from q) select round(2.0 * count(*) filter (a and b) / nullif(count(*) filter (a) + count(*) filter (b), 0), 8)::double as dice from m")
def dice(spark, sf_dir):
    m = pairs(spark, sf_dir).select(F.when(F.col("a") >= 0.5, 1).otherwise(0).alias("a"), F.when(F.col("b") >= 0.5, 1).otherwise(0).alias("b"))
    return px.dice(m).select(F.round(F.col("dice").cast("double"), 8).alias("dice"))


# --- text


@query("with l as (select p_partkey, case when p_partkey % 5 = 0 then '// ' || p_name else '(' || replace(p_brand, '#', '') || ' ' || p_size || ' \"' || p_partkey || '\")' end as line from part) select p_partkey, nullif(regexp_extract(line, '^\\((\\S+)[^)]*\\)', 1), '') as key, case when line like '(%' then array_to_string(list_filter(regexp_split_to_array(replace(regexp_extract(line, '^\\(\\S+\\s*([^)]*)\\)', 1), '\"', ''), '\\s+'), lambda v: v <> ''), '|') else '' end as vals from l")
def parse_params(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("// "), "p_name")).otherwise(F.concat(F.lit("("), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" "), F.col("p_size").cast("string"), F.lit(' "'), F.col("p_partkey").cast("string"), F.lit('")')))
    rows = t(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    return rows.select("p_partkey", text.parameter_key(F.col("line")).alias("key"), F.array_join(text.parameter_values(F.col("line")), "|").alias("vals"))


@query("select p_partkey, row_number() over (partition by p_size order by p_partkey)::integer as place from part")
def natural_sort(spark, sf_dir):
    """Names that end in numbers, in the order of the numbers."""
    key = names.natural_key(F.concat(F.lit("Info.R"), F.col("p_partkey").cast("string"), F.lit(".txt")))
    return t(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(key)).alias("place"))


@query("select event_id, user_id, round(value - lag(value) over w, 6) + 0.0 as delta, row_number() over w as iteration from events window w as (partition by user_id order by ts, event_id)")
def iteration_series(spark, sf_dir):
    told = text.series(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return told.select("event_id", "user_id", (F.round("delta", 6) + 0.0).alias("delta"), "iteration")


@query("select user_id, arg_max(event_id, (value, -event_id)) as largest, count(*) as n from events group by user_id")
def largest_series(spark, sf_dir):
    return images.largest_series(t(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("select date_trunc('hour', ts) as start, round(avg(value), 6) as mean, count(*) as n from events group by 1")
def metric_windows(spark, sf_dir):
    """The streaming extension's aggregate, run over the whole table at once."""
    return iterations.windowed(t(spark, sf_dir, "events"), "ts", "value").select("start", F.round("mean", 6).alias("mean"), "n")


@query("select o_orderkey, case when len(n) = k then array_to_string(n, ',') else array_to_string(list_transform(generate_series(0, k - 1), lambda i: 'C' || i), ',') end as names from (select o_orderkey, [o_orderstatus, o_orderpriority] as n, (o_orderkey % 3 + 1)::integer as k from orders)")
def channel_names(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.array_join(names.channel_names(F.array("o_orderstatus", "o_orderpriority"), (F.col("o_orderkey") % 3 + 1).cast("int")), ",").alias("names"))


# --- the flagship: points through two-hop paths

FLAGSHIP = f"""
with o as (select c_nationkey as n, n_regionkey as r, c_custkey as c, o_totalprice / 1000.0 as x, (o_orderkey % 1000)::double as y from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
a as (select *, 0.01 * (c % 7) as th, (c % 11)::double as tx, -(c % 5)::double as ty from o),
b as (select r, n, cos(th) * (x - 100.0 - tx) + sin(th) * (y - 50.0 - ty) + 100.0 as x, cos(th) * (y - 50.0 - ty) - sin(th) * (x - 100.0 - tx) + 50.0 as y from a),
d as (select r, x - n as u, y + n as v, 1 + 0.01 * (n % 3) as a11, (1 + 0.01 * (n % 3)) * 1.0 + 0.02 * 0.01 as det from b),
f as (select r, (1.0 * u - 0.02 * v) / det / 0.5 as x, (a11 * v + 0.01 * u) / det / 0.5 as y from d)
select r::varchar as region, count(*) as n, round(min(x), 6) as x0, round(min(y), 6) as y0, round(max(x), 6) as x1, round(max(y), 6) as y1, round(greatest(min(x) - 100, 0), 6) as px, round(greatest(min(y) - 100, 0), 6) as py from f group by r
"""


@query(FLAGSHIP)
def flagship(spark, sf_dir):
    """Orders as points of their customer's image, mapped to the region's: resolve two hops, join their transforms, map, and take the padded box.

    Edges are tables of their keys' size; the points are read once, joined by the customer and combined before the one
    shuffle of the result.
    """
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    hops = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        "c_custkey", "n_regionkey", (F.lit(0.01) * (F.col("c_custkey") % 7)).alias("angle"), (F.col("c_custkey") % 11).cast("double").alias("tx"), (-(F.col("c_custkey") % 5)).cast("double").alias("ty"), F.col("n_nationkey").cast("double").alias("k"), (F.lit(1.0) + F.lit(0.01) * (F.col("n_nationkey") % 3)).alias("a11")
    )
    o = t(spark, sf_dir, "orders").select("o_custkey", (F.col("o_totalprice") / 1000.0).alias("x"), (F.col("o_orderkey") % 1000).cast("double").alias("y"))
    joined = o.join(hops, o["o_custkey"] == hops["c_custkey"])
    x, y = tf.euler_columns(F.col("x"), F.col("y"), F.col("angle"), F.col("tx"), F.col("ty"), F.lit(100.0), F.lit(50.0), inverse=True)
    first = joined.select("n_regionkey", "k", "a11", x.alias("x"), y.alias("y"))
    x, y = tf.affine_columns(F.col("x"), F.col("y"), (F.col("a11"), F.lit(0.02), F.lit(-0.01), F.lit(1.0)), F.col("k"), -F.col("k"), F.lit(0.0), F.lit(0.0), inverse=True)
    second = first.select("n_regionkey", (x / 0.5).alias("x"), (y / 0.5).alias("y"))
    low = lambda e: F.round(F.greatest(e - 100, F.lit(0.0)), 6)
    return second.groupBy(F.col("n_regionkey").cast("string").alias("region")).agg(F.count("*").alias("n"), F.round(F.min("x"), 6).alias("x0"), F.round(F.min("y"), 6).alias("y0"), F.round(F.max("x"), 6).alias("x1"), F.round(F.max("y"), 6).alias("y1"), low(F.min("x")).alias("px"), low(F.min("y")).alias("py"))


# --- filled polygons

POLYGONS = f"{V}, o as (select o_orderkey, (o_custkey % 10)::varchar as set_name from orders), many as (select l_orderkey from l group by 1 having count(*) >= 3), v as (select set_name, l_orderkey as id, vertex, trunc(x / 10)::bigint as x, trunc(y / 10)::bigint as y from l join many using (l_orderkey) join o on l_orderkey = o_orderkey)"
FILL = f"""
with {POLYGONS},
e as (select *, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1 from v window w as (partition by id order by vertex rows between unbounded preceding and unbounded following)),
cut as (select set_name, id, k as y, x + (k - y) * (x1 - x) / (y1 - y) as x from (select *, unnest(generate_series(greatest(least(y, y1), 0), least(greatest(y, y1), 100) - 1)) as k from e where y <> y1)),
pair as (select *, row_number() over w as n, lead(x) over w as b from cut window w as (partition by id, y order by x)),
inner_ as (select set_name, id, y, unnest(generate_series(greatest(ceil(x), 0)::bigint, least(floor(b), 99)::bigint)) as x from pair where n % 2 = 1),
step as (select *, greatest(abs(x1 - x), abs(y1 - y), 1) as n from e),
outline as (select set_name, id, round_even(y + (y1 - y) * k / n, 0)::bigint as y, round_even(x + (x1 - x) * k / n, 0)::bigint as x from (select *, unnest(generate_series(0, n)) as k from step))
select set_name, y, x, max(id) + 1 as v from (select * from inner_ union all select set_name, id, y, x from outline where x between 0 and 99 and y between 0 and 99) group by set_name, y, x
"""


def polygons(spark, sf_dir):
    """Orders of three lines or more as polygons a tenth of the size, in sets by the last digit of the order's customer."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("set_name"))
    p = rings(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey"))).filter("n >= 3")
    return p.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "set_name", F.col("l_orderkey").alias("feature_id"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("vertex").cast("int").alias("vertex"), (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), F.lit("Polygon").alias("shape_type"), F.concat(F.lit("s"), "set_name").alias("shape_name")
    )


@query(FILL)
def rasterise(spark, sf_dir):
    """The polygons filled on a raster of 100 x 100 for each set, a later order over an earlier one."""
    return shapes.rasterise(polygons(spark, sf_dir), (100, 100))


@query(f"with {POLYGONS} select set_name, id as feature_id, '{{\"type\": \"Feature\", \"geometry\": {{\"type\": \"Polygon\", \"coordinates\": [[' || string_agg('[' || x::double || ', ' || y::double || ']', ', ' order by vertex) || case when arg_min(x, vertex) <> arg_max(x, vertex) or arg_min(y, vertex) <> arg_max(y, vertex) then ', [' || arg_min(x, vertex)::double || ', ' || arg_min(y, vertex)::double || ']' else '' end || ']]}}, \"properties\": {{\"classification\": {{\"name\": \"s' || set_name || '\"}}}}}}' as feature from v group by set_name, id")
def geojson_features(spark, sf_dir):
    """Polygons as GeoJSON text, their rings closed."""
    v = polygons(spark, sf_dir).withColumns({c: F.floor(c).cast("double") for c in "xy"})
    return shapes.to_geojson(v)


@query(f"with {POLYGONS}, last as (select set_name, max(id) as last from v group by 1) select set_name, id as feature_id, vertex, x::double as x, y::double as y from v union all select set_name, id + last + 1, vertex, x * 2.0, y * 2.0 from v join last using (set_name) where id % 3 = 0")
def shape_add(spark, sf_dir):
    """A set with some of its shapes, doubled, added once more."""
    v = polygons(spark, sf_dir).withColumns({c: F.floor(c).cast("double") for c in "xy"})
    return shapes.add(v, shapes.scale(v.filter("feature_id % 3 = 0"), 2.0)).select("set_name", "feature_id", "vertex", "x", "y")


@query(f"with {POLYGONS} select set_name, id as feature_id, vertex, case when id % 3 = 0 then x + 0.5 else x end::double as x, y::double as y from v")
def shape_update(spark, sf_dir):
    v = polygons(spark, sf_dir).withColumns({c: F.floor(c).cast("double") for c in "xy"})
    moved = v.filter("feature_id % 3 = 0").withColumn("x", F.col("x") + 0.5)
    return shapes.update(v, moved).select("set_name", "feature_id", "vertex", "x", "y")


@query(f"with {POLYGONS} select set_name, 'Polygon' as shape_type, 's' || set_name as shape_name, count(distinct id) as n_shapes from v group by set_name")
def shape_counts(spark, sf_dir):
    return shapes.counts(polygons(spark, sf_dir))


@query("with r as (select unnest(generate_series(0, (select max(vec_id) from embeddings) // 50)) as k), b as (select k, max(vec_id) - k * 50 + 1 as h from r join embeddings on vec_id // 50 = k group by k) select k * 2 + s as feature_id, (s * 32)::double as x0, (k * 50)::double as y0, (s * 32 + 32)::double as x1, (k * 50 + h)::double as y1, 4::bigint as n_vertices from b, (select unnest([0, 1]) as s)")
def label_outlines(spark, sf_dir):
    """The plane in labelled blocks of 50 x 32, turned back into polygons."""
    from .operators import contours

    raster = plane(spark, sf_dir).select(F.lit("set").alias("set_name"), "y", "x", (F.floor(F.col("y") / 50) * 2 + F.floor(F.col("x") / 32) + 1).alias("v"))
    return shapes.bounding_boxes(contours.label_polygons(raster), "feature_id")


@query(f"with {P}, r as (select (y // 50) * 2 + x // 32 + 1 as label, y, x from p) select label, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, count(*) as area from r group by label")
def label_boxes(spark, sf_dir):
    raster = plane(spark, sf_dir).select(F.lit("set").alias("set_name"), "y", "x", (F.floor(F.col("y") / 50) * 2 + F.floor(F.col("x") / 32) + 1).alias("v"))
    return shapes.label_boxes(raster).drop("set_name")


# --- B-splines

#: Coefficients by place, x and then y, of a grid of 14 x 14.
SPLINE = tf.Transform("bspline", tuple(((i * 7 + j * 3 + c * 5) % 17 - 8) * 0.7310585 for c in (0, 1) for j in range(14) for i in range(14)), size=(1000, 1000), grid_size=(14, 14), grid_spacing=(100.0, 100.0), grid_origin=(-150.0, -150.0))


def _weight(k: str, u: str) -> str:
    return f"(case {k} when 0 then (1 - {u}) ** 3 when 1 then 3 * {u} ** 3 - 6 * {u} ** 2 + 4 when 2 then -3 * {u} ** 3 + 3 * {u} ** 2 + 3 * {u} + 1 else {u} ** 3 end / 6)"


SPLINED = f"""{L}, k as (select unnest([0, 1, 2, 3]) as k), u as (select *, (x + 150.0) / 100.0 as ux, (y + 150.0) / 100.0 as uy from l),
near as (select l_orderkey, l_linenumber, x, y, floor(ux)::bigint - 1 + a.k as i, floor(uy)::bigint - 1 + b.k as j, {_weight('a.k', '(ux - floor(ux))')} * {_weight('b.k', '(uy - floor(uy))')} as w from u, k a, k b),
d as (select l_orderkey, l_linenumber, x, y, sum(w * ((i * 7 + j * 3) % 17 - 8) * 0.7310585) as dx, sum(w * ((i * 7 + j * 3 + 5) % 17 - 8) * 0.7310585) as dy, count(*) // 16 as n from near group by all)"""


@query(f"with {SPLINED} select l_orderkey, l_linenumber, x, y, round(x + dx / n, 6) + 0.0 as mx, round(y + dy / n, 6) + 0.0 as my, n from d")
def bspline_forward(spark, sf_dir):
    """Points through a cubic B-spline grid; n: how often the same point is in its order."""
    p = points(spark, sf_dir).groupBy("l_orderkey", "l_linenumber", "x", "y").agg(F.count("*").alias("n"))
    moved = shapes.mapped_by(p.withColumns({"mx": F.col("x"), "my": F.col("y")}), tf.Sequence().add([SPLINE]), ("mx", "my"))
    return moved.select("l_orderkey", "l_linenumber", "x", "y", *r6("mx", "my"), "n")


@query(f"with {L} select l_orderkey, l_linenumber, x, y from l")
def bspline_points(spark, sf_dir):
    """Points through the inverse of a B-spline grid and a turn, and back through both: each returns to itself."""
    # the turn comes first, about the middle and small, so that all points stay on the grid
    seq = tf.Sequence().add([tf.Transform("euler", (0.02, 1.0, -2.0), (500.0, 500.0)), SPLINE], [0, 1])
    back = shapes.mapped_by(shapes.transform(points(spark, sf_dir), seq), seq)
    return back.select("l_orderkey", "l_linenumber", *[(F.round(c, 3) + 0.0).alias(c) for c in "xy"])


# --- graphs on the driver, from nations and regions


def project_graph(spark, sf_dir) -> graph.Graph:
    """Nation k is aligned to its region through nation k // 2, the first one straight; every fifth has an image attached, every seventh shapes; three merges."""
    n = [tuple(r) for r in t(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    g = graph.Graph()
    for k, name in n:
        g.add_image(f"N{k}", f"{name}.tiff", 0.5 + k, [name])
    g.add_image("R", "region.tiff", 2.0, output_res=4.0)
    g.add_path("N0", "R")
    for k, _ in n[1:]:
        g.add_path(f"N{k}", "R", f"N{k // 2}", ("rigid", "affine"))
    for k, _ in n[::5]:
        g.attach_image(f"N{k}", f"A{k}")
    for k, _ in n[::7]:
        g.attach_shapes(f"N{k}", f"S{k}")
    for k in (1, 2, 3):
        g.add_merge(f"M{k}", [f"N{k}", f"N{k + 10}"])
    return g


PARENTS = "a as (select n_nationkey as k from nation), h(start, hop, source) as (select k, 0, k from a union all select start, hop + 1, source // 2 from h where source > 0)"


@query(f"with recursive {PARENTS} select 'N' || start as modality, hop::integer as hop, 'N' || source as source, case when source = 0 then 'R' else 'N' || (source // 2) end as target from h")
def graph_hops(spark, sf_dir):
    return project_graph(spark, sf_dir).tables(spark)["hop"]


@query("select 'N' || n_nationkey as name, n_name || '.tiff' as image, 0.5 + n_nationkey as image_res, null::varchar as attached_to from nation union all select 'R', 'region.tiff', 2.0, null union all select 'A' || n_nationkey, '', 0.5 + n_nationkey, 'N' || n_nationkey from nation where n_nationkey % 5 = 0")
def graph_images(spark, sf_dir):
    return project_graph(spark, sf_dir).tables(spark)["image"]


@query("with o as (select 1 as part, n_nationkey as k, 'N' || n_nationkey as name from nation where n_nationkey not in (1, 2, 3, 11, 12, 13) union all select 2, n_nationkey, 'A' || n_nationkey from nation where n_nationkey % 5 = 0 union all select 3, k, 'M' || k from (select unnest([1, 2, 3]) as k) union all select 4, 0, 'R') select (row_number() over (order by part, k) - 1)::integer as place, name from o")
def graph_outputs(spark, sf_dir):
    """What a project writes, in order; merged images aren't written alone."""
    return spark.createDataFrame(list(enumerate(project_graph(spark, sf_dir).outputs())), "place int, name string")


@query(f"""with recursive {PARENTS}, gone as (select distinct start as k from h where source = 5),
merges as (select k, k as a, k + 10 as b from (select unnest([1, 3]) as k))
select 'image' as kind, 'N' || k as name from a where k <> 5 union all select 'image', 'R' union all select 'image', 'A' || k from a where k % 5 = 0 and k <> 5
union all select 'path', 'N' || k from a where k not in (select k from gone) union all select 'edge', 'N' || k || '-' || case when k = 0 then 'R' else 'N' || (k // 2) end from a where k not in (select k from gone) and k <> 5 and k // 2 <> 5
union all select 'shapes', 'S' || k from a where k % 7 = 0 and k <> 7 union all select 'merge', 'M' || k from merges where a <> 5 and b <> 5""")
def graph_removal(spark, sf_dir):
    """An image goes with the paths that use it, a shape set and a merge alone."""
    g = project_graph(spark, sf_dir)
    g.remove("N5")
    g.remove("S7")
    g.remove_merge("M2")
    rows = [("image", n) for n in g.nodes] + [("path", s) for s in g.paths] + [("edge", f"{e.source}-{e.target}") for e in g.edges] + [("shapes", n) for n in g.shapes] + [("merge", n) for n in g.merges]
    return spark.createDataFrame(rows, "kind string, name string")


@query("select 'N' || n_nationkey as source, case when n_nationkey = 0 then 'R' else 'N' || (n_nationkey // 2) end as target, case when n_nationkey = 0 then 'rigid' else 'rigid,affine' end as params, n_nationkey % 4 <> 0 as registered from nation")
def graph_reset(spark, sf_dir):
    """All edges aligned, then every fourth to be aligned anew."""
    from dataclasses import replace

    g = project_graph(spark, sf_dir)
    g.edges = [replace(e, registered=True, transforms=(EULER,)) for e in g.edges]
    g.reset([e.source for e in g.edges][::4])
    return g.tables(spark)["edge"].withColumn("params", F.array_join("params", ","))


@query("select 'N' || n_nationkey as name, n_name || '.tiff' as image, 0.5 + n_nationkey as image_res, n_name as channels, case when n_nationkey = 0 then 'R' else 'N' || (n_nationkey // 2) || ',R' end as path, case when n_nationkey % 2 = 0 then 90 else 0 end::double as rotate, null::double as output_res from nation union all select 'R', 'region.tiff', 2.0, '', null, 0, 4.0")
def configuration(spark, sf_dir):
    """The graph and preprocessing as a configuration's text, and read again."""
    from . import config
    from .project import Prepro

    g = project_graph(spark, sf_dir)
    own = {n.name: Prepro(rotate=90.0 if n.name[1:] and int(n.name[1:]) % 2 == 0 else 0.0) for n in g.nodes.values() if n.attached_to is None}
    data = config.check(config.parse(config.text_of(config.dump(g, "p", "o", own))))
    back, prepro = config.load(data), config.prepros(data)
    rows = [(n.name, n.image, n.image_res, ",".join(n.channel_names), ",".join(back.paths[n.name]) if n.name in back.paths else None, float(prepro[n.name].rotate), n.output_res) for n in back.nodes.values() if n.attached_to is None]
    return spark.createDataFrame(rows, "name string, image string, image_res double, channels string, path string, rotate double, output_res double")


# --- what the driver knows by heart, against written-out values


def fixed(schema: str, rows: str):
    """A query whose rows are made on the driver, against these values."""
    kinds = dict(x.split() for x in schema.split(", "))
    cast = ", ".join(f"{k}::{ {'string': 'varchar', 'int': 'integer'}.get(v, v)} as {k}" for k, v in kinds.items())

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: spark.createDataFrame(f(), schema)
        ORACLE[f.__name__] = f"select {cast} from (values {rows}) v({', '.join(kinds)})"
        return f

    return register


@fixed("name string, kind string, metric string, resolutions int, iterations int, samples int, bins int, grid double", "('rigid', 'euler', 'mutual_information', 10, 200, 10000, 16, null::double), ('affine', 'affine', 'mutual_information', 10, 200, 10000, 32, null), ('similarity', 'similarity', 'mutual_information', 10, 200, 10000, 32, null), ('nl', 'bspline', 'mutual_information', 10, 200, 50000, 32, 100), ('fi_correction', 'euler', 'mutual_information', 4, 75, 10000, 16, null), ('nl-reduced', 'bspline', 'mutual_information', 5, 150, 50000, 32, 100), ('nl_mid', 'bspline', 'mutual_information', 5, 200, 50000, 32, 150), ('rigid-expanded', 'euler', 'mutual_information', 10, 500, 30000, 16, null), ('nl3', 'bspline', 'mutual_information', 1, 1000, 125000, 32, 200), ('nl2', 'bspline', 'mutual_information', 10, 200, 15000, 32, 75), ('affine_test', 'affine', 'mutual_information', 10, 10, 10000, 32, null), ('nl_ams', 'bspline', 'mean_squares', 10, 200, 50000, 32, 100), ('rigid_anc', 'euler', 'correlation', 10, 200, 10000, 16, null)")
def alignment_models():
    from .operators import register

    names_ = ("rigid", "affine", "similarity", "nl", "fi_correction", "nl-reduced", "nl_mid", "rigid-expanded", "nl3", "nl2", "affine_test", "nl_ams", "rigid_anc")
    found = zip(names_, register.models_of(names_), strict=True)
    return [(n, m.kind, m.metric, m.resolutions, m.iterations, m.samples, m.bins, float(m.grid) if m.kind == "bspline" else None) for n, m in found]


@fixed("kind string, channels string, max_projection boolean, contrast boolean, invert boolean, box string", "('FL', '3', true, true, false, null), ('BF', '', false, false, true, '1,2,3,4'), ('FL', '0,2', false, false, false, null)")
def preprocessing_rules():
    from .config import prepro_of

    blocks = ({"image_type": "FL", "ch_indices": 3, "contrast_enhance": True, "invert_intensity": True}, {"image_type": "BF", "contrast_enhance": True, "invert_intensity": True, "mask_bbox": [1, 2, 3, 4]}, {"ch_indices": [0, 2], "max_int_proj": False})
    rules = [prepro_of("a", b).effective() for b in blocks]
    return [(p.image_type, ",".join(map(str, p.channels)), p.max_projection, p.contrast, p.invert, ",".join(map(str, p.box)) if p.box else None) for p in rules]


@fixed("place int, seq_idx int, ordinal int, kind string, x double, y double", "(0, 0, 0, 'euler', 7.0, 3.0), (1, 1, 1, 'affine', 7.0, 3.0), (2, 2, 4, 'euler', 7.0, 3.0), (3, 2, 3, 'translation', 7.0, 3.0), (4, 2, 2, 'similarity', 7.0, 3.0)")
def transform_files():
    """Transforms saved as JSON and read again: groups, the order of the composite, and a point through it and back."""
    from . import config

    first = [EULER, AFFINE]
    hop = [SIMILARITY, SHIFT, EULER]
    seq = config.load_transforms(config.save_transforms(first, [("target", hop[::-1])]))
    seq = tf.Sequence().add(seq.transforms, seq.groups)
    back = shapes.inverse_points(seq, shapes.map_points(seq, np.array([[7.0, 3.0]]))).round(6)[0]
    place = {i: k for k, i in enumerate(seq.order())}
    return [(k, g, place[k], x.kind, float(back[0]), float(back[1])) for k, (g, x) in enumerate(zip(seq.groups, seq.transforms, strict=True))]


@fixed("rule string, w int, h int, spacing double", "('own', 200, 100, 0.65), ('coarser', 65, 33, 2.0), ('finer', 260, 130, 0.5)")
def output_rules():
    rules = {"own": None, "coarser": 2.0, "finer": 0.5}
    return [(k, *tf.OutputRule((200, 100), 0.65, r).grid()[0], tf.OutputRule((200, 100), 0.65, r).grid()[1]) for k, r in rules.items()]


@fixed("name string, cropped boolean, w int, h int, spacing double, x double, y double", "('a', false, 200, 100, 1.0, 15.0, 37.0), ('a', true, 100, 60, 1.0, 35.0, 47.0), ('b', false, 50, 25, 4.0, 30.0, 40.0), ('c', false, 10, 20, 1.0, 30.0, 40.0)")
def project_outputs():
    """The grids that a project's images are written on, a target's crop undone or kept, and where a point of each lies on its image."""
    from dataclasses import replace

    from .project import Project

    g = graph.Graph()
    g.add_image("a", image_res=2.0)
    g.add_image("b", image_res=1.0, output_res=4.0)
    g.add_image("c", image_res=1.0)
    g.add_path("a", "b")
    g.edges = [replace(g.edges[0], registered=True, transforms=(tf.Transform("translation", (5.0, 7.0), size=(100, 60)),))]
    p = Project(g, {}, {"a": (50, 40), "b": (200, 100), "c": (10, 20)}, initial={"a": [], "b": [tf.crop((20, 10, 100, 60), 1.0)]})
    out = []
    for name, cropped in (("a", False), ("a", True), ("b", False), ("c", False)):
        rule = p.output(name, to_original_size=not cropped)
        at = shapes.map_points(rule, np.array([[30.0, 40.0]]))[0]
        out.append((name, cropped, *(int(n) for n in rule.size), rule.spacing[0], float(at[0]), float(at[1])))
    return out


@fixed("place int, name string", "(0, 'a - DAPI'), (1, 'a - C1'), (2, 'b - red')")
def merged_channel_names():
    return list(enumerate(names.merge_names(["a", "b"], [["DAPI", "C1"], ["red"]])))


@fixed("w int, h int, channels string, res double", "(640, 480, 'one,two & three', 0.5)")
def image_descriptions():
    """The description written with an image, and read again."""
    told, res = images.xml_info(images.image_xml(480, 640, ["one", "two & three"], "uint16", False, 0.5))
    return [(640, 480, ",".join(told), res)]


# --- tiles


@query(f"with {C} select channel, y, x, v from c")
def tile_round_trip(spark, sf_dir):
    """Pixels as tiles of 48 and back."""
    return resample.to_pixels(resample.to_tiles(channels(spark, sf_dir), 48, "uint8")).select("channel", "y", "x", "v")


@query(f"with {P}, o as (select y, x, floor(round(x * 0.8 + y * 0.3 + 2.25, 9) + 0.5)::bigint as sx, floor(round(x * -0.2 + y * 1.1 + 5.5, 9) + 0.5)::bigint as sy from (select unnest(generate_series(0, 79)) as x), (select unnest(generate_series(0, 199)) as y)) select o.y::bigint as y, o.x::bigint as x, p.v as v from o join p on p.x = sx and p.y = sy where p.v > 0")
def tile_resample(spark, sf_dir):
    """What nearest_resample gives, by tiles."""
    turn = tf.Transform("affine", (0.8, 0.3, -0.2, 1.1, 2.25, 5.5), size=(80, 200))
    h = t(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    tiles = resample.resample_tiles(resample.to_tiles(plane(spark, sf_dir), 32, "uint8"), (64, h), tf.Sequence().add([turn]), 1.0, 32)
    return resample.to_pixels(tiles).filter("v > 0").select("y", "x", "v")


@query(f"with {P}, h as (select max(y) + 1 as h from p) select y // 4 as y, x // 4 as x, avg(v) as v from p, h where y < h // 4 * 4 group by 1, 2")
def tile_pyramid(spark, sf_dir):
    """The second level below, by halving tiles twice."""
    h = t(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    tiles = resample.to_tiles(plane(spark, sf_dir), 32, "uint8")
    small = images.halved_tiles(images.halved_tiles(tiles, 64, h, 32), 32, h // 2, 32)
    return resample.to_pixels(small).select("y", "x", "v")


@query("select l::integer as level, c::integer as channel, y::bigint as y, x::bigint as x, ((c * 50 + y * 7 * (1 + l) + x * 3 * (1 + l)) % 251)::double as v from (select unnest([0, 1]) as l), (select unnest([0, 1]) as c), (select unnest(generate_series(0, 44)) as y), (select unnest(generate_series(0, 69)) as x) where l = 0 or (y < 23 and x < 35)")
def tiff_pixels(spark, sf_dir):
    """A pyramidal file of two channels, made and decoded again."""
    workers.ready(spark)
    c, y, x = np.mgrid[0:2, 0:45, 0:70]
    full = ((c * 50 + y * 7 + x * 3) % 251).astype("uint16")
    raw = images.tiff_bytes([full, np.ascontiguousarray(full[:, ::2, ::2])], 16)
    tiles = images.decode_files(spark.createDataFrame([("made.tiff", bytearray(raw))], "path string, content binary"))
    # to_pixels() keeps the image's name, which has the level in it here
    named = tiles.withColumn("image_id", F.col("level").cast("string"))
    return resample.to_pixels(named).select(F.col("image_id").cast("int").alias("level"), "channel", "y", "x", "v")


@query("select y::bigint as y, x::bigint as x, c::integer as channel, ((y * 5 + x * 11 + c * 90) % 256)::double as v from (select unnest([0, 1, 2]) as c), (select unnest(generate_series(0, 19)) as y), (select unnest(generate_series(0, 29)) as x)")
def array_pixels(spark, sf_dir):
    """Colours of an array at hand, sent out by tiles."""
    from .sources import formats

    workers.ready(spark)
    y, x, c = np.mgrid[0:20, 0:30, 0:3]
    return resample.to_pixels(formats.read(spark, ((y * 5 + x * 11 + c * 90) % 256).astype("uint8"), tile=16)).select("y", "x", "channel", "v")


@query("select y::bigint as y, x::bigint as x, (case when y >= 3 and x >= 5 then 1000 + y * 20 + x else y * 20 + x end)::double as v from (select unnest(generate_series(0, 12)) as y), (select unnest(generate_series(0, 24)) as x) where (y < 10 and x < 20) or (y >= 3 and x >= 5)")
def mosaic_pixels(spark, sf_dir):
    """Two blocks of a mosaic that lie over each other, cut to a grid: the later one covers the earlier."""
    from .sources import formats

    workers.ready(spark)
    y, x = np.mgrid[0:13, 0:25]
    whole = (y * 20 + x).astype("uint16")
    block = lambda k, y0, x0, a: ("m", 0, 0, k, 0, y0, x0, *a.shape, "uint16", bytearray(np.ascontiguousarray(a).tobytes()))
    rows = [block(0, 0, 0, whole[:10, :20]), block(1, 3, 5, whole[3:, 5:] + 1000)]
    out = resample.to_pixels(formats.retiled(spark.createDataFrame(rows, images.TILES), 8))
    # corners that no block covers are 0 there
    return out.select("y", "x", "v").filter("(y < 10 and x < 20) or (y >= 3 and x >= 5)")


@query("select 'x' as edge_id, true as found union all select 'y', true union all select 'z', true")
def register_shift(spark, sf_dir):
    """Three planes whose shifts are known, aligned in one job: each is found to within a pixel."""
    from .operators import register

    y, x = np.mgrid[0:96, 0:96]
    picture = lambda u, v: 127 + 60 * np.sin((x + u) / 9.0) * np.cos((y + v) / 7.0) + 60 * np.exp(-(((x + u - 40) / 20.0) ** 2) - ((y + v - 50) / 15.0) ** 2)
    shifts = {"x": (3.0, -2.0), "y": (-1.5, 2.5), "z": (0.0, 0.0)}
    raw = lambda a: bytearray(a.astype(np.float32).tobytes())
    rows = [(k, raw(picture(*s)), raw(picture(0, 0)), 96, 96, 96, 96, "float32") for k, s in shifts.items()]
    edges = spark.createDataFrame(rows, "edge_id string, fixed binary, moving binary, h int, w int, mh int, mw int, dtype string")
    got = register.register_edges(edges, register.Model("translation", "mean_squares", 3, 80, 4000))
    want = F.create_map(*[F.lit(v) for k, s in shifts.items() for v in (k, F.array(F.lit(s[0]), F.lit(s[1])))])[F.col("edge_id")]
    near = lambda i: F.abs(F.col("params")[i] - want[i]) < 1.0
    return got.select("edge_id", (near(0) & near(1)).alias("found"))


# --- no SQL


@query()
def register_edge(spark, sf_dir):
    """The plane's two halves, each moved by two rows against itself, aligned by the rigid model over all its levels, both in one job."""
    from .operators import register

    half = plane(spark, sf_dir).withColumns({"channel": F.floor(F.col("x") / 32).cast("int"), "x": F.col("x") % 32})
    tiles = resample.to_tiles(half, 1 << 30, "uint8").filter("h > 2")
    # a byte a pixel: what is left from the third row on is the moved plane
    edges = tiles.select(F.concat(F.lit("edge"), F.col("channel").cast("string")).alias("edge_id"), F.col("data").alias("fixed"), F.expr("substring(data, 2 * w + 1)").alias("moving"), "h", "w", (F.col("h") - 2).alias("mh"), F.col("w").alias("mw"), "dtype")
    return register.register_edges(edges, register.MODELS["rigid"]).drop("log")
