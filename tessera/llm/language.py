"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers, one from each side, read windows of a text's bytes; their states label every position with a
probability for each language, and a document's probabilities are the mean of those of all its positions. The network
is trained here in numpy by backpropagation through time on windows of a bounded sample of labelled rows
(`Settings.sample_rows`); prediction covers every byte of every text.

A null text, and one without a letter, gets `und` with score 0. Rows whose label is null don't train. Repeated rows get
equal results. If there is nothing to learn from (an empty table, no labels), every text gets `und`. An empty table
gives an empty result. Columns other than doc_id, text and, for training, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, slices, table, utf8

UNKNOWN = "und"
#: Stands after the end of a text in its last window.
PAD = 256


@dataclass(frozen=True)
class Settings:
    """sample_rows: labelled rows that train at any table size, in equal shares by language, those with the smallest hashes of id and text; as many languages at most. sample_parts: parts of a window's size that stand for each of them, spread over its whole text. window: bytes that a network reads at once."""

    sample_rows: int = 4000
    sample_parts: int = 8
    window: int = 64
    hidden: int = 8
    batch: int = 256
    steps: int = 300
    rate: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class Network:
    """languages, and arrays: for side f(orward) and b(ackward) the byte tables and recurrent weights of update gate z, reset gate r and candidate n, and the output's."""

    languages: tuple[str, ...]
    weights: dict[str, np.ndarray]
    window: int


def windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts cut into windows: (window, width) with PAD after a text's end, and the text that each window is of. An empty text has none."""
    lengths = np.diff(offsets)
    count = -(-lengths // width)
    text = np.repeat(np.arange(len(lengths)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + first * width
    left = np.minimum(offsets[1:][text] - start, width)
    out = np.full((len(text), width), PAD, np.int16)
    inside = np.arange(width) < left[:, None]
    # windows are in the order of the bytes, so the bytes fill the inside in order
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, text


def sigmoid_(x: np.ndarray) -> np.ndarray:
    """In place, by the faster tanh; its input comes halved."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def side(net: dict[str, np.ndarray], s: str, steps: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one layer after each step, in the order of `steps` (time, window). Gate weights are kept halved for sigmoid_."""
    t, n = steps.shape
    h = np.zeros((n, net[f"{s}Un"].shape[0]), np.float32)
    out, kept = np.empty((t, *h.shape), np.float32), []
    for k in range(t):
        at = steps[k]
        z = sigmoid_(net[f"{s}Ez"].take(at, 0) + h @ net[f"{s}Uz"])
        r = sigmoid_(net[f"{s}Er"].take(at, 0) + h @ net[f"{s}Ur"])
        u = h @ net[f"{s}Un"]
        c = net[f"{s}En"].take(at, 0)
        c += r * u
        np.tanh(c, out=c)
        if keep:
            kept.append((h, z, r, u, c))
        # h = c + z * (h - c)
        h = h - c
        h *= z
        h += c
        out[k] = h
    return out, kept


def logits(net: dict[str, np.ndarray], steps: np.ndarray, keep: bool = False) -> tuple:
    """(time, window, language) before the softmax; with keep, also what the way back needs."""
    ahead, kept_a = side(net, "f", steps, keep)
    behind, kept_b = side(net, "b", steps[::-1], keep)
    out = ahead @ net["Wf"] + behind[::-1] @ net["Wb"]
    out += net["b"]
    return out, ahead, behind, kept_a, kept_b


def softmax_(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def back(net: dict[str, np.ndarray], s: str, steps: np.ndarray, states: np.ndarray, kept: list, grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Backpropagation through time of one layer; grad: of the loss by each state."""
    later = np.zeros_like(grad[0])
    inputs = {gate: np.empty_like(grad) for gate in "zrn"}
    for k in range(len(steps) - 1, -1, -1):
        h, z, r, u, c = kept[k]
        g = grad[k] + later
        gc = g * (1 - z) * (1 - c * c)
        gz = g * (h - c) * z * (1 - z) * 2  # twice, as the gates' inputs are halved
        gr = gc * u * r * (1 - r) * 2
        gu = gc * r
        later = g * z + gz @ net[f"{s}Uz"].T + gr @ net[f"{s}Ur"].T + gu @ net[f"{s}Un"].T
        for gate, value, recurrent in (("z", gz, gz), ("r", gr, gr), ("n", gc, gu)):
            inputs[gate][k] = value
            out[f"{s}U{gate}"] += h.T @ recurrent
    bytes_ = steps.ravel()
    for gate, value in inputs.items():
        for unit in range(value.shape[2]):
            out[f"{s}E{gate}"][:, unit] += np.bincount(bytes_, value[:, :, unit].ravel(), PAD + 1)


def fit(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Network:
    """Trains on windows at random places of the texts, languages in equal shares, by Adam."""
    rng = np.random.default_rng(settings.seed)
    languages = tuple(sorted(set(labels)))
    h, w = settings.hidden, settings.window
    net = {f"{s}E{g}": rng.normal(0, 0.3, (PAD + 1, h)) for s in "fb" for g in "zrn"} | {f"{s}U{g}": rng.normal(0, 0.3, (h, h)) for s in "fb" for g in "zrn"} | {f"W{s}": rng.normal(0, 0.3, (h, len(languages))) for s in "fb"} | {"b": np.zeros(len(languages))}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    cut, of = windows(*utf8(pa.array(texts, pa.large_string())), w)
    target = np.array([languages.index(x) for x in labels], np.int64)[of]
    by = [np.flatnonzero(target == k) for k in range(len(languages))]
    by = [x for x in by if len(x)]
    if not by:
        return Network((), {}, w)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    for step in range(1, settings.steps + 1):
        pick = np.concatenate([rng.choice(x, settings.batch // len(by) + 1) for x in by])
        steps = np.ascontiguousarray(cut[pick].T).astype(np.int64)
        mask = steps != PAD
        p, ahead, behind, kept_a, kept_b = logits(net, steps, keep=True)
        p = softmax_(p)
        p[:, np.arange(len(pick)), target[pick]] -= 1
        p *= (mask / mask.sum())[:, :, None].astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in net.items()}
        grads["b"] += p.sum((0, 1))
        grads["Wf"] += np.einsum("tnh,tnl->hl", ahead, p)
        grads["Wb"] += np.einsum("tnh,tnl->hl", behind[::-1], p)
        back(net, "f", steps, ahead, kept_a, p @ net["Wf"].T, grads)
        back(net, "b", steps[::-1], behind, kept_b, (p @ net["Wb"].T)[::-1], grads)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = settings.rate * min(1.0, 4 * (1 - (step - 1) / settings.steps))
        for k, g in grads.items():
            g *= min(1.0, 1.0 / max(size, 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, net, w)


def label_positions(net: Network, text: str) -> np.ndarray:
    """A probability for each byte and language of one text."""
    cut, _ = windows(*utf8(pa.array([text], pa.large_string())), net.window)
    p = softmax_(logits(net.weights, np.ascontiguousarray(cut.T).astype(np.int64))[0])
    return p.transpose(1, 0, 2).reshape(-1, len(net.languages))[: len(text.encode())]


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, lanes: int = 2048) -> np.ndarray:
    """(text, language): the mean over all positions of a text; 0 for an empty one."""
    out = np.zeros((len(offsets) - 1, len(net.languages)))
    cut, of = windows(data, offsets, net.window)
    for k in range(0, len(of), lanes):
        steps = np.ascontiguousarray(cut[k : k + lanes].T).astype(np.int64)
        p = softmax_(logits(net.weights, steps)[0])
        if (steps[-1] == PAD).any():
            p *= (steps != PAD)[:, :, None]
        np.add.at(out, of[k : k + lanes], p.sum(0))
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    import pyarrow.compute as pc

    plain = pc.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False).astype(bool)
    for i in np.flatnonzero(~plain):
        plain[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return plain


def train(docs: DataFrame, settings: Settings = Settings(), where=None) -> Network:
    """Learns from the bounded sample of the labelled rows that `where` admits: for each language its rows of the smallest draws, up to equal shares of the sample."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows if where is None else rows.filter(where)
    drawn = rows.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text", F.lit(settings.seed)).alias("draw"), "text")
    # as many numbers as languages; of a language beyond what is wanted only draws below a bound of about twice that leave their tasks
    many = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.sample_rows).collect()}
    if not many:
        return Network((), {}, settings.window)
    quota = max(settings.sample_rows // len(many), 1)
    bound = {k: int((2 * quota + 32) / n * (1 << 64)) - (1 << 63) for k, n in many.items() if n > 2 * quota + 32}
    if bound:
        below = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv])[F.col("lang")]
        drawn = drawn.filter(F.col("lang").isin(list(many)) & (below.isNull() | (F.col("draw") < below)))
    drawn = drawn.select("lang", "draw", parts_of(F.col("text"), F.col("draw"), settings).alias("parts"))
    first = Window.partitionBy("lang").orderBy("draw", "parts")
    got = drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= quota).orderBy("lang", "place").collect()
    texts = [(part, r["lang"]) for r in got for part in r["parts"]]
    return fit([t for t, _ in texts], [k for _, k in texts], settings)


def parts_of(text: Column, draw: Column, settings: Settings) -> Column:
    """Parts of about a window spread over the whole text, one at a place given by the draw in each of its equal stretches; a shorter text whole, in parts."""
    n, w = settings.sample_parts, settings.window
    stretch = F.greatest(F.lit(w), F.ceil(F.length(text) / n).cast("int"))
    at = lambda k: k * stretch + F.pmod(F.xxhash64(draw, k), stretch - w + 1).cast("int") + 1
    return F.filter(F.transform(F.array(*map(F.lit, range(n))), lambda k: F.substring(text, at(k), F.lit(w))), lambda x: x != "")


def predict(docs: DataFrame, net: Network, *keep: str, with_text: bool = False) -> DataFrame:
    """doc_id, [text], [columns kept], lang_pred, score for every row; score is the pooled probability of the language."""
    arrow(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col("doc_id").cast("long"), "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            place = whole.schema.get_field_index("text")
            filled = max(whole.schema.names, key=len) + "_"  # a name of its own
            names = [*whole.schema.names, filled]
            for batch in slices(iter([pa.RecordBatch.from_arrays([*whole.columns, whole.column(place).fill_null("")], names)]), column=filled):
                texts = batch.column(filled)
                n = batch.num_rows
                labels, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if net.languages:
                    p = pooled(net, *utf8(texts))
                    letters = has_letter(texts)
                    labels[letters] = np.array(net.languages, object)[p.argmax(1)][letters]
                    score[letters] = np.clip(p.max(1), 0, 1)[letters]
                others = [name for name in names[:-1] if with_text or name != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in others), pa.array(labels.tolist(), pa.string()), pa.array(score)], [*others, "lang_pred", "score"])

    schema = StructType([f for f in rows.schema.fields if with_text or f.name != "text"]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def held_out():
    """Rows whose crc32 of the id as text leaves 2 by 4; they never train. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, where=~held_out())
    return predict(docs.withColumn("held_out", held_out()), net, "held_out")
