"""Secret scan by one deterministic automaton over all rules.

The rules' mirrored expressions become one minimised transition array (`automaton`), which passes once over the bytes of
every text and says where which rules may begin. From there a second array, that of all expressions as they are, tells how far
each reaches, which gives the leftmost-longest matches. A match whose checked part is too short for its rule is dropped, as it
would be by a check after the match.

A null text is an empty one. Repeated rows get equal results. An empty table gives an empty result. Spans count code
points, the end exclusive. Columns other than doc_id and text pass untouched through redact() and aren't read by scan().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import automaton
from .common import arrow, slices, table, text_only, utf8


@dataclass(frozen=True)
class Secret:
    """A kind of secret: its expression; the expression of what stands before the checked part; the part's least length.

    begin: an expression that matches, from the same byte on, whatever a match that isn't dropped begins with, for the pass over all
    texts; the expression itself, its counts reduced to one, if none is named. Counters side by side would multiply the states.
    """

    kind: str
    pattern: str
    before: str = ""
    least: int = 0
    begin: str = ""

    def head(self) -> tuple:
        # of what stands before, the key's letters are in either case
        return automaton.any_case(automaton.parse(self.before))

    def tree(self) -> tuple:
        return "cat", [self.head(), automaton.parse(self.pattern)]

    def begin_tree(self) -> tuple:
        return automaton.parse(self.begin) if self.begin else automaton.uncounted(self.tree())


#: The base rules of the contract, then further well-known forms.
BASE = (
    Secret("assign", r"[A-Za-z0-9+/_.=-]+", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", 6),
    Secret("access", r"AKIA[A-Z0-9]+", least=20),
    Secret("hex", r"[0-9a-f]+", least=24, begin=r"[0-9a-f]{24}"),
)
HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: What stands before a key's END line, in whatever quoting, but no two hyphens.
BODY = r"([^-]|-[^-])*-----END [A-Z ]*PRIVATE KEY-----"
#: Without an END line: lines of fields, then base64 in parts of 16 or more, and the last one of any length. A break may be written as an escape.
GAP = r"[\x20\t\r\n\\\"']"
RUN = rf"({GAP}+[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:[^\r\n\\]*)*({GAP}*[A-Za-z0-9+/=]{{16,}})+({GAP}+[A-Za-z0-9+/=]{{1,15}})?"
MORE = (
    Secret("forge", r"(gh[oprsu]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})"),
    Secret("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Secret("private_key", HEADER + f"({BODY}|{RUN})?", begin=HEADER),
)


@cache
def machines(rules: tuple[Secret, ...]) -> tuple[automaton.Automaton, automaton.Ahead, list[int]]:
    """The combined automaton of where the rules begin, that of how far they and then their heads reach, and each rule's head among these, or -1."""
    heads = [r for r in rules if r.before]
    behind = automaton.build([automaton.backwards(r.begin_tree()) for r in rules], anywhere=True)
    return behind, automaton.Ahead([r.tree() for r in rules] + [r.head() for r in heads]), [len(rules) + heads.index(r) if r.before else -1 for r in rules]


def find(data: np.ndarray, offsets: np.ndarray, rules: tuple[Secret, ...]) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with spans: (start, rule's number, end) in code points, sorted."""
    behind, ahead, heads = machines(rules)
    buffer, first = automaton.joined(data, offsets)
    text, rule, start, ends = automaton.spans(behind, ahead, len(rules), buffer, first)
    rows = np.arange(len(text))
    head = np.array(heads)[rule]
    end, value = ends[rows, rule], np.where(head < 0, start, ends[rows, head])
    keep = end - value >= np.array([r.least for r in rules])[rule]
    # bytes to code points: less the continuation bytes before
    before = np.concatenate([[0], np.cumsum((buffer & 0xC0) == 0x80)])
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, k, s, e in zip(*(x[keep].tolist() for x in (text, rule, start, end)), strict=True):
        zero = first[i] - before[first[i]]
        out.setdefault(i, []).append((int(s - before[s] - zero), k, int(e - before[e] - zero)))
    return {i: sorted(x) for i, x in out.items()}


def scan(docs: DataFrame, rules: tuple[Secret, ...] = BASE + MORE, base: tuple[Secret, ...] = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans, for every row."""
    arrow(docs.sparkSession)
    columns = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches):
            found = find(*utf8(batch.column("text")), rules)
            n = batch.num_rows
            counts = np.zeros((len(base), n), np.int64)
            digests, told = [nothing] * n, [""] * n
            for i, spans in found.items():
                words = [f"{rules[k].kind}:{s}:{e}" for s, k, e in spans]
                own = [w for w, (_, k, _) in zip(words, spans, strict=True) if k < len(base)]
                for _, k, _ in spans:
                    if k < len(base):
                        counts[k, i] += 1
                digests[i], told[i] = hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(digests), pa.array(told)], columns)

    if rules[: len(base)] != base:
        raise ValueError("the base rules come first")
    return text_only(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{r.kind} long" for r in base) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Secret, ...] = BASE + MORE) -> DataFrame:
    """The same rows and columns with each secret replaced by [<kind>], overlapping spans by one mark. n_chars, where there is such a column, follows where the text changed; all else stays, a null text too."""
    arrow(docs.sparkSession)
    if not isinstance(docs.schema["text"].dataType, StringType):
        raise ValueError("text must be a string")
    made = "safe_text"
    while made in docs.columns:
        made += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.get_field_index("text")
            filled = pa.RecordBatch.from_arrays([whole.column(place).fill_null("").cast(pa.string()), pa.array(np.arange(whole.num_rows))], ["text", "row"])
            made: list[str | None] = [None] * whole.num_rows
            for batch in slices(iter([filled])):
                rows = batch.column("row").to_numpy()
                for i, spans in find(*utf8(batch.column("text")), rules).items():
                    text = batch.column("text")[i].as_py()
                    out, at = [], 0
                    for s, k, e in spans:
                        if s >= at:
                            out += [text[at:s], f"[{rules[k].kind}]"]
                        at = max(at, e)
                    made[rows[i]] = "".join([*out, text[at:]])
            # the rows as they came and one column more, in every batch alike
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(made, pa.string())], [*whole.schema.names, "made"])

    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [StructField(made, StringType(), True)])
    done = docs.mapInArrow(run, schema)
    changed = {"text": F.coalesce(F.col(made), F.col("text")), "n_chars": F.when(F.col(made).isNull(), F.col("n_chars")).otherwise(F.char_length(made).cast(LongType()))}
    return done.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
