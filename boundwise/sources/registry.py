"""Sketches that a session keeps, and which of them answers a question."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bounds
from ..functions.hashing import fast
from ..operators import frequency, hll, quantiles
from ..operators.quantiles import QUARTILES
from ..plans.calls import DISTINCT, FREQ, TOP_K, ApproxCall
from ..plans.lexer import normalised

HLL, KLL, FREQUENCY = "hll", "kll", "freq"
#: A frequency sketch of more cells than this isn't kept.
MOST_CELLS = 1 << 22


def kind_of(name: str) -> str:
    return HLL if name == DISTINCT else KLL if name in QUARTILES else FREQUENCY


def required(call: ApproxCall) -> dict[str, int] | None:
    """The least parameters for a call's bounds; None if no sketch of this kind is kept at that size."""
    return required_for(kind_of(call.name), call.epsilon, call.confidence, call.k or bounds.DEFAULT_K)


def required_for(kind: str, epsilon: float, confidence: float, k: int = bounds.DEFAULT_K) -> dict[str, int] | None:
    if kind == HLL:
        size = bounds.hll_precision(epsilon, confidence)
        return {"p": size.value} if size.met and size.value <= bounds.NATIVE_HLL_PRECISION else None
    if kind == KLL:
        size = bounds.kll_capacity(epsilon, confidence)
        return {"k": size.value} if size.met and size.value <= bounds.NATIVE_KLL_K else None
    dims, capacity = bounds.cms_dims(epsilon, confidence), bounds.topk_capacity(k, epsilon)
    if not dims.met or not capacity.met or dims.width * dims.depth > MOST_CELLS:
        return None
    return {"width": dims.width, "depth": dims.depth, "capacity": capacity.value}


@dataclass
class Entry:
    """A sketch of an expression over a source (the text from FROM on), and what of the source it covers."""

    kind: str
    source: str
    expression: str
    params: dict[str, int]
    seed: int
    state: str
    n: int
    value_type: str
    sketch: bytes = b""
    values: list[str] = field(default_factory=list)
    counters: list[int] = field(default_factory=list)
    errors: list[int] = field(default_factory=list)
    lost: int = 0
    answers: dict = field(default_factory=dict)

    @property
    def key(self) -> tuple:
        return (self.kind, self.source, self.expression, self.seed, tuple(sorted(self.params.items())))

    def memory(self) -> int:
        return len(self.sketch) + sum(len(v.encode()) + 16 for v in self.values)

    def serves(self, needed: dict[str, int]) -> bool:
        return all(self.params[name] >= least for name, least in needed.items())


class Registry:
    """Entries by key."""

    def __init__(self) -> None:
        self.entries: dict[tuple, Entry] = {}

    def find(self, kind: str, source: str, expression: str, seed: int, state: str, needed: dict[str, int]) -> Entry | None:
        """The smallest entry that is current and accurate enough."""
        fits = [e for e in self.entries.values() if (e.kind, e.source, e.expression, e.seed, e.state) == (kind, source, expression, seed, state) and e.serves(needed)]
        return min(fits, key=lambda e: (e.memory(), sorted(e.params.items())), default=None)

    def put(self, entry: Entry) -> None:
        self.entries[entry.key] = entry

    def drop(self, keys: list[tuple]) -> None:
        for key in keys:
            self.entries.pop(key, None)

    def memory_bytes(self) -> int:
        return sum(e.memory() for e in self.entries.values())


def build(spark: SparkSession, kind: str, source: str, expression: str, params: dict[str, int], seed: int, state: str) -> Entry:
    """A sketch over a source as it is now, in one pass over it; only the sketch comes to the driver."""
    return build_all(spark, source, [(kind, expression, params)], seed, state)[0]


def build_all(spark: SparkSession, source: str, wanted: list[tuple[str, str, dict[str, int]]], seed: int, state: str) -> list[Entry]:
    """Sketches (kind, expression, params) over one source: one pass for all HLL and KLL ones, one for each of frequencies."""
    rows = spark.sql(f"SELECT {', '.join(f'({e}) AS v{i}' for i, (_, e, _) in enumerate(wanted))} {source}")
    out = [Entry(kind, normalised(source), normalised(e), params, seed, state, 0, rows.schema[f"v{i}"].dataType.simpleString()) for i, (kind, e, params) in enumerate(wanted)]
    aggregates, said = [], []
    for i, entry in enumerate(out):
        v, s, n = F.col(f"v{i}"), f"s{i}", f"n{i}"
        if entry.kind == HLL:
            aggregates += [hll.native(v, entry.params["p"], seed).alias(s), F.count(v).alias(n)]
            said.append(F.coalesce(F.hll_sketch_estimate(s), F.lit(0)).cast("double").alias(f"a{i}_{DISTINCT}"))
        if entry.kind == KLL:
            finite = quantiles.finite(v)
            aggregates += [F.kll_sketch_agg_double(finite, F.lit(entry.params["k"])).alias(s), F.count(finite).alias(n)]
            said += [F.expr(f"if({n} = 0, 0D, kll_sketch_get_quantile_double({s}, {p}D))").alias(f"a{i}_{name}") for name, p in QUARTILES.items()]
    got = rows.agg(*aggregates).select("*", *said).first().asDict() if aggregates else {}
    for i, entry in enumerate(out):
        if entry.kind == FREQUENCY:
            out[i] = _with_frequencies(entry, rows.select(F.col(f"v{i}").cast("string").alias("v")))
        else:
            answers = {(name.split("_", 1)[1], None, None): value for name, value in got.items() if name.startswith(f"a{i}_")}
            out[i] = replace(entry, sketch=bytes(got[f"s{i}"] or b"") if got[f"n{i}"] else b"", n=got[f"n{i}"], answers=answers)
    return out


def _with_frequencies(entry: Entry, rows: DataFrame) -> Entry:
    width, depth, capacity = (entry.params[x] for x in ("width", "depth", "capacity"))
    table = np.zeros((depth, width), np.int64)
    both = frequency.sketched(rows, F.col("v"), width, depth, capacity, entry.seed)
    best = both.filter("nth is null").orderBy(F.col("value").isNotNull(), F.desc("counter"), "value").limit(capacity + 2)
    got = both.filter("nth is not null").unionByName(best).toArrow()  # at most width * depth cells and some counters
    nth = got["nth"].is_valid()
    cells, best = got.filter(nth), got.filter(pc.invert(nth)).to_pylist()
    table[cells["nth"].to_numpy(), cells["bucket"].to_numpy()] = cells["counter"].to_numpy()
    own = frequency.Summary(capacity)
    own.lost = sum(r["lost"] for r in best if r["value"] is None)
    own.counters = {r["value"]: r["counter"] for r in best if r["value"] is not None}
    own.errors = {r["value"]: r["off"] + own.lost for r in best if r["value"] is not None}
    own.add({})
    return _holding(replace(entry, sketch=table.tobytes(), n=int(table[0].sum())), own)


def _holding(entry: Entry, s: frequency.Summary) -> Entry:
    values = sorted(s.counters, key=lambda v: (-s.counters[v], v))
    return replace(entry, values=values, counters=[s.counters[v] for v in values], errors=[s.errors[v] for v in values], lost=s.lost, answers={})


def _summary(entry: Entry) -> frequency.Summary:
    s = frequency.Summary(entry.params["capacity"])
    s.counters, s.errors, s.lost = dict(zip(entry.values, entry.counters, strict=True)), dict(zip(entry.values, entry.errors, strict=True)), entry.lost
    return s


def merge(spark: SparkSession, a: Entry, b: Entry, state: str) -> Entry:
    """The sketch of both inputs; they must be of one kind, size and seed."""
    if (a.kind, a.params, a.seed) != (b.kind, b.params, b.seed):
        raise ValueError("sketches of different kinds, sizes or seeds don't merge")
    out = replace(a, state=state, n=a.n + b.n, answers={})
    if not b.n:
        return out
    if not a.n:
        return replace(out, sketch=b.sketch, values=b.values, counters=b.counters, errors=b.errors, lost=b.lost)
    if a.kind == FREQUENCY:
        own = _summary(a)
        own.merge(_summary(b))
        return _holding(replace(out, sketch=(np.frombuffer(a.sketch, np.int64) + np.frombuffer(b.sketch, np.int64)).tobytes()), own)
    x, y = F.lit(bytearray(a.sketch)), F.lit(bytearray(b.sketch))
    return replace(out, sketch=bytes(_said(spark, F.hll_union(x, y) if a.kind == HLL else F.kll_sketch_merge_double(x, y))))


def _said(spark: SparkSession, value: Column):
    """An expression of literals, without a job."""
    return spark.sql("SELECT 1").select(value.alias("x")).first().x


def answer(spark: SparkSession, entry: Entry, call: ApproxCall):
    """What an entry says to a call: a number, or rows of (value text, estimate, error). Asked again, it needs no job."""
    asked = (call.name, call.target, call.k)
    if asked not in entry.answers:
        entry.answers[asked] = _answer(spark, entry, call)
    return entry.answers[asked]


def _answer(spark: SparkSession, entry: Entry, call: ApproxCall):
    if call.name == TOP_K:
        return _summary(entry).top(call.k)
    if call.name == FREQ:
        width, depth = entry.params["width"], entry.params["depth"]
        buckets = _said(spark, F.array(*[F.pmod(fast(F.lit(call.target), entry.seed + r), F.lit(width)) for r in range(depth)]))
        table = np.frombuffer(entry.sketch, np.int64).reshape(depth, width)
        return int(min(table[r, buckets[r]] for r in range(depth)))
    if not entry.n:
        return 0.0
    s = F.lit(bytearray(entry.sketch))
    return float(_said(spark, F.hll_sketch_estimate(s) if call.name == DISTINCT else F.kll_sketch_get_quantile_double(s, F.lit(QUARTILES[call.name]))))
