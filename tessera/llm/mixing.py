"""Mixing sources to target weights by iterative proportional fitting.

Documents carry tokens and three labels. Raking scales the table of tokens by source, language and topic, one margin
after the other, until its margins are the targets; the factor of a cell is how much of its text the mixture wants
against what there is. A document is then sampled with a probability proportional to its cell's factor, up to 1, so
that a set share of all tokens is expected, by a draw that depends on its id alone.

Sources may be many and are never collected: each is a row with its tokens by language and topic, and a step of the
fitting is one pass over these rows given the factors of languages and topics, which the driver holds (their number
is checked against `MOST_CELLS`). The labels' tokens are combined before they are shuffled.

Targets are powers of a label's own share (exponent 1 keeps it, 0 makes all equal) or given shares by value; values without
a given share keep theirs, and all are scaled to sum to 1. Null labels are a value of their own. Ties of the draw can't arise within an id and don't matter between ids: each draw is held to its own chance. A null or empty text
has no tokens and the factor of its cell, or 1 if its cell has no tokens at all. Rows of equal id share their draw. An
empty table gives an empty result. sample() keeps the columns it is given, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow, cut, drop, table

MOST_CELLS = 1_000_000
#: Sources up to this many are broadcast, one name and factor each; a larger table of them is joined by a shuffle.
FEW_SOURCES = 50_000
LABELS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mixture:
    """exponents: of the shares of sources, languages and topics. shares: given target shares by label and value. keep: expected share of all tokens. rounds: of the fitting; steps: of solving for the sampling rate."""

    exponents: tuple[float, float, float] = (0.7, 0.8, 0.8)
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    keep: float = 0.7
    rounds: int = 20
    steps: int = 12


def tokens(text: Column) -> Column:
    """Words of a text: its runs of characters other than white space."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""))).cast("long")


def topic(text: Column) -> Column:
    """The form of a text: table, symbols or prose; other topics can be handed in as a column."""
    return F.when(text.contains(" | "), "table").when(text.contains("***") | text.contains("###") | text.contains("$$$") | text.contains("%%%") | text.contains("&&&"), "symbols").otherwise("prose")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) of the id alone."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def target(own: np.ndarray, values: list, exponent: float, given: dict[str, float]) -> np.ndarray:
    share = own / max(own.sum(), 1)
    out = np.array([given.get(v, s) for v, s in zip(values, share, strict=True)]) if given else np.where(share > 0, share, 0) ** exponent * (share > 0)
    return out / max(out.sum(), 1e-300)


def fit(labelled: DataFrame, mix: Mixture) -> tuple[DataFrame, DataFrame]:
    """Factors from rows of LABELS and tokens: (source, total) by source with its factor, and the factors of (lang, topic), times the sampling rate.

    Returns (source, by_source) and (lang, topic, by_cell): a document's probability is the product, up to 1; the factor itself is `weight`.
    """
    spark = labelled.sparkSession
    cells = cut(labelled.groupBy(*LABELS).agg(F.sum("tokens").alias("tokens")))
    kinds = [tuple(r) for r in cells.select("lang", "topic").distinct().limit(MOST_CELLS + 1).collect()]
    if len(kinds) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of language and topic")
    kinds.sort(key=lambda r: tuple((x is not None, x) for x in r))
    langs, topics = (sorted({k[i] for k in kinds}, key=lambda x: (x is not None, x)) for i in (0, 1))
    place = {k: langs.index(k[0]) * len(topics) + topics.index(k[1]) for k in kinds}
    width = len(langs) * len(topics)
    # a source's tokens by kind, as doubles
    index = spark.createDataFrame([(k[0], k[1], p) for k, p in place.items()], "lang string, topic string, place int")
    placed = cells.withColumn("lang", F.col("lang").cast("string")).withColumn("topic", F.col("topic").cast("string"))
    placed = placed.join(F.broadcast(index), placed["lang"].eqNullSafe(index["lang"]) & placed["topic"].eqNullSafe(index["topic"])).select("source", "place", "tokens")
    sources = cut(placed.groupBy("source").agg(F.collect_list(F.struct("place", "tokens")).alias("cells"), F.sum("tokens").alias("total")))
    # the sources' own exponent makes their targets; their sum over all is one number
    by_source = F.when(F.col("total") > 0, F.pow(F.col("total").cast("double"), F.lit(mix.exponents[0]))).otherwise(0.0)
    given = mix.shares.get("source")
    if given:
        whole = float(sources.agg(F.sum("total")).first()[0] or 1)
        by_source = F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col("source")], F.col("total") / F.lit(whole))
    all_targets, everything = sources.agg(F.sum(by_source), F.sum("total")).first()
    everything = float(everything or 0)
    sources = sources.withColumn("want", by_source / F.lit(float(all_targets or 1) or 1.0))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slice's matrix has some four million numbers at most
        most = max((4 << 20) // max(width, 1), 1)
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                yield batch.slice(k, most)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, width))
        for i, own in enumerate(batch.column("cells").to_pylist()):
            for c in own:
                out[i, c["place"]] += c["tokens"]
        return out

    def factor(n: np.ndarray, want: np.ndarray, kind: np.ndarray) -> np.ndarray:
        total = n @ kind
        return np.divide(want, total, out=np.zeros_like(total), where=total > 0)

    def sums(of, size: int = width) -> np.ndarray:
        """of(matrix, want): rows to `size` numbers, added over all sources; a task gives as many."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in narrow(batches):
                part = of(matrix(batch), batch.column("want").to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "x"])

        out = np.zeros(size)
        for r in sources.select("cells", "want").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[r["k"]] = r["x"]
        return out

    shape = (len(langs), len(topics))
    own = sums(lambda n, want: n.sum(0)).reshape(shape)
    want_l = target(own.sum(1), langs, mix.exponents[1], mix.shares.get("lang", {}))
    want_t = target(own.sum(0), topics, mix.exponents[2], mix.shares.get("topic", {}))
    g, h = np.ones(len(langs)), np.ones(len(topics))
    for _ in range(mix.rounds if everything else 0):
        kind, before = np.outer(g, h).ravel(), (g, h)
        m = sums(lambda n, want, kind=kind: (factor(n, want, kind)[:, None] * n).sum(0)).reshape(shape)
        scaled = m * h
        g = np.divide(want_l, scaled.sum(1), out=np.zeros_like(g), where=scaled.sum(1) > 0)
        scaled = m * g[:, None]
        h = np.divide(want_t, scaled.sum(0), out=np.zeros_like(h), where=scaled.sum(0) > 0)
        if all(np.allclose(now, then, rtol=1e-12, atol=0) for now, then in zip((g, h), before, strict=True)):
            break
    # the factors of the last full round: the sources' from before it, the languages' and topics' from it
    last, kind = (kind if mix.rounds and everything else np.ones(width)), np.outer(g, h).ravel() * everything
    # rate: the expected tokens, sum of n * min(1, rate * weight), are the share to keep; solved by fixing which cells are full
    rate = mix.keep
    for _ in range(mix.steps if everything else 0):

        def split(n: np.ndarray, want: np.ndarray, rate=rate) -> np.ndarray:
            weight = factor(n, want, last)[:, None] * kind
            full = rate * weight >= 1
            return np.array([(n * full).sum(), (n * weight * ~full).sum()])

        full, rest = sums(split, 2)
        after = (mix.keep * everything - full) / rest if rest > 0 else rate
        if after <= rate * (1 + 1e-13):
            break
        rate = after

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            f = factor(matrix(batch), batch.column("want").to_numpy(zero_copy_only=False), last)
            yield pa.RecordBatch.from_arrays([batch.column("source"), pa.array(f)], ["source", "by_source"])

    found = cut(sources.select("source", "cells", "want").mapInArrow(factors, "source string, by_source double"))
    drop(cells)
    rows = [(k[0], k[1], float(kind[p]), float(rate)) for k, p in place.items()]
    return found, spark.createDataFrame(rows, "lang string, topic string, by_kind double, rate double")


def weigh(docs: DataFrame, mix: Mixture = Mixture(), topics: Column | None = None, counts: Column | None = None) -> DataFrame:
    """docs with the struct _mix: topic, tokens, weight (its cell's factor), probability, sampled. topics, counts: of columns of docs, in place of topic() and tokens()."""
    arrow(docs.sparkSession)
    text = F.col("text")
    labelled = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (topic(F.coalesce(text, F.lit(""))) if topics is None else topics).alias("topic"), (tokens(text) if counts is None else F.coalesce(counts.cast("long"), F.lit(0))).alias("tokens"))
    by_source, by_kind = fit(labelled, mix)
    if by_source.count() <= FEW_SOURCES:
        # then a source with a third of all rows stays where it is
        by_source = F.broadcast(by_source)
    own = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), (topic(F.coalesce(text, F.lit(""))) if topics is None else topics).alias("_topic"), (tokens(text) if counts is None else F.coalesce(counts.cast("long"), F.lit(0))).alias("_tokens")
    )
    s, k = by_source.alias("s"), F.broadcast(by_kind).alias("k")
    joined = own.join(k, F.col("_row.lang").cast("string").eqNullSafe(F.col("k.lang")) & F.col("_topic").eqNullSafe(F.col("k.topic")), "left")
    joined = joined.join(s, F.col("_row.source").cast("string").eqNullSafe(F.col("s.source")), "left")
    weight = F.coalesce(F.col("by_source") * F.col("by_kind"), F.lit(1.0))
    chance = F.least(F.lit(1.0), weight * F.coalesce("rate", F.lit(mix.keep)))
    return joined.select("_row", F.struct(F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), weight.alias("weight"), chance.alias("probability"), (draw(F.col("_row.doc_id")) < chance).alias("sampled")).alias("_mix"))


def sample(docs: DataFrame, mix: Mixture = Mixture(), topics: Column | None = None, counts: Column | None = None) -> DataFrame:
    """The sampled documents with the columns they came with."""
    return weigh(docs, mix, topics, counts).filter("_mix.sampled").select("_row.*")


def op3_mixing_to_target_weights(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = weigh(docs.select("doc_id", "source", "lang", "text"))
    return out.select("_row.doc_id", "_row.source", "_row.lang", "_mix.topic", "_mix.tokens", F.round("_mix.weight", 6).alias("weight"), F.round("_mix.probability", 6).alias("probability"), "_mix.sampled")


def oracle(mix: Mixture = Mixture()) -> str:
    """DuckDB's SQL: the same fitting on the table of cells, each step written out."""
    a, b, c = mix.exponents
    sql = f"""
with d as (
    select doc_id, source, lang, case when contains(text, ' | ') then 'table'
        when contains(text, '***') or contains(text, '###') or contains(text, '$$$') or contains(text, '%%%') or contains(text, '&&&') then 'symbols' else 'prose' end as topic,
        coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '')), 0)::bigint as tokens
    from documents
),
n as (select source, lang, topic, sum(tokens)::double as n from d group by all),
m as (select *, sum(n) over (partition by source) as ns, sum(n) over (partition by lang) as nl, sum(n) over (partition by topic) as nt, sum(n) over () as total from n),
ts as (select source, case when ns > 0 then ns ** {a} else 0 end as x from (select distinct source, ns from m)),
tl as (select lang, case when nl > 0 then (nl / total) ** {b} else 0 end as x from (select distinct lang, nl, total from m)),
tt as (select topic, case when nt > 0 then (nt / total) ** {c} else 0 end as x from (select distinct topic, nt, total from m)),
w0 as (
    select m.*, n as w, ts.x / (select sum(x) from ts) as ws, tl.x / (select sum(x) from tl) as wl, tt.x / (select sum(x) from tt) as wt
    from m join ts on m.source is not distinct from ts.source join tl on m.lang is not distinct from tl.lang join tt on m.topic = tt.topic
)"""
    k = 0
    for _ in range(mix.rounds):
        for label, want in (("source", "ws"), ("lang", "wl"), ("topic", "wt")):
            sql += f",\nw{k + 1} as (select * replace (case when sum(w) over (partition by {label}) > 0 then w * {want} / sum(w) over (partition by {label}) else 0 end as w) from w{k})"
            k += 1
    sql += f",\nf as materialized (select source, lang, topic, n, total, case when n > 0 then w * total / n end as weight from w{k}),\nr0 as (select {mix.keep}::double as rate)"
    for j in range(mix.steps):
        sql += f",\nr{j + 1} as (select greatest(any_value(rate), case when sum(case when rate * weight < 1 then n * weight end) > 0 then ({mix.keep} * any_value(total) - coalesce(sum(case when rate * weight >= 1 then n end), 0)) / sum(case when rate * weight < 1 then n * weight end) else any_value(rate) end) as rate from f, r{j})"
    return sql + f"""
select d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(weight, 1), 6) as weight, round(least(1, coalesce(weight, 1) * rate), 6) as probability,
    ('0x' || substr(md5(coalesce(d.doc_id::varchar, '') || ':mix'), 1, 12))::bigint / 281474976710656.0 < least(1, coalesce(weight, 1) * rate) as sampled
from d join f on d.source is not distinct from f.source and d.lang is not distinct from f.lang and d.topic = f.topic, r{mix.steps}
"""


ORACLE = {"op3_mixing_to_target_weights": oracle()}
