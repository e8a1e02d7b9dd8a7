"""A session: SQL with approximate functions, answered from kept sketches where they fit."""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bounds
from .errors import MisuseError, QueryError
from .plans import statements as st
from .plans.calls import DISTINCT, FREQ, TOP_K, ApproxCall, rewritten
from .plans.lexer import literal, normalised, tokens
from .plans.lexer import statements as split_statements
from .shipping import ship
from .sources import registry as reg
from .sources.state import source_state, unsteady
from .sources.store import Store

SEED_VARIABLE = "BOUNDWISE_HASH_SEED"
#: Results of up to so many rows are literals of a plan.
_LITERALS = 1000


class Session:
    """root: a folder for sketches that outlive the session; without it they live in memory. recheck: for so many seconds
    value() trusts that nobody else has changed a source since it last looked at its files."""

    def __init__(self, spark: SparkSession, root: str | None = None, hash_seed: int | None = None, recheck: float = 0):
        self.spark, self.registry, self.last_error = spark, reg.Registry(), "not an error"
        self.store = Store(spark, root) if root and root != ":memory:" else None
        self._open, self._changes, self._batches = True, 0, {}
        self.recheck, self._values = recheck, {}
        self._steady: dict[tuple[str | None, str], bool] = {}
        self._builders = ThreadPoolExecutor(4)  # jobs of several sketches side by side
        ship(spark)
        kept = self.store.seed() if self.store else None
        self.seed = hash_seed or int(os.environ.get(SEED_VARIABLE, 0)) or kept or random.getrandbits(31) or 1
        if self.store:
            if kept != self.seed:
                self.store.save_seed(self.seed)
            self.store.load(self.registry)

    open = classmethod(lambda cls, spark, root=None, **options: cls(spark, root, **options))

    def close(self) -> None:
        """Safe to call again."""
        self._open = False
        self._builders.shutdown()
        self.registry = reg.Registry()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def memory_bytes(self) -> int:
        return self.registry.memory_bytes()

    # statements

    def sql(self, text: str) -> DataFrame | None:
        """Runs the statements of a text; the result of the last."""
        if not self._open:
            raise MisuseError("the session is closed")
        out = None
        try:
            for statement in split_statements(text):
                out = self._run(st.plan(statement))
        except (QueryError, PySparkException) as e:
            self.last_error = str(e)
            raise e if isinstance(e, QueryError) else QueryError(str(e)) from e
        self.last_error = "not an error"
        return out

    def exec(self, text: str, callback: Callable[[list[str | None], list[str]], int | None] | None = None) -> None:
        """Like sql; every row goes to the callback as texts, with the columns' names. What it returns other than 0 stops."""
        out = self.sql(text)
        if out is None or callback is None:
            return
        for row in out.toLocalIterator():
            if callback([formatted(v) for v in row], out.columns):
                self.last_error = "query aborted by callback"
                raise QueryError(self.last_error)

    def _run(self, p: st.Plan) -> DataFrame:
        if p.kind == st.INSERT:
            return self._insert(p.insert)
        if p.kind == st.APPROX and (lone := st.lone_call(p)):
            call, source = lone
            if (out := self._from_sketch(call, source)) is not None:
                return out
            if call.name == TOP_K:
                raise QueryError(f"{TOP_K}: no summary of that size is kept")
        sql = rewritten(p.sql, self.seed) if p.calls else p.sql
        out = self.spark.sql(sql)
        if p.kind == st.MUTATION:
            self._changes += 1
            self._forget_stale()
        return out

    # sketches

    def state(self, source: str) -> str | None:
        """What a source (the text from FROM on) holds: its plan with all views opened, and the place, length and time of each of
        its files as they are now. Where other things than files are read, this session's changes count as well, and nothing
        outlives it. None: what it holds may differ from one moment to the next, so that no sketch of it can be kept."""
        columns = "1" if any(t.low == "group" for t in tokens(source)) else "*"
        return source_state(self.spark.sql(f"SELECT {columns} {source}"), self._changes)

    def sketch(self, call: ApproxCall, source: str) -> reg.Entry | None:
        """The kept sketch for a call over a source, built if there is none that is current and accurate enough."""
        needed = reg.required(call)
        if needed is None:
            return None
        kind, state = reg.kind_of(call.name), self.state(source)
        if (state, call.expression) not in self._steady:
            self._steady[state, call.expression] = state is not None and not unsteady(self.spark.sql(f"SELECT ({call.expression}) AS v {source}"))
        if not self._steady[state, call.expression]:
            return reg.build(self.spark, kind, source, call.expression, needed, self.seed, "") if call.name == TOP_K else None
        found = self.registry.find(kind, normalised(source), normalised(call.expression), self.seed, state, needed)
        if found is None:
            found = reg.build(self.spark, kind, source, call.expression, needed, self.seed, state)
            self._keep([found])
        return found

    def _keep(self, entries: list[reg.Entry]) -> None:
        for e in entries:
            self.registry.put(e)
        if self.store:
            self.store.save([e for e in entries if e.state.startswith("files:")])

    def _forget_stale(self) -> None:
        now: dict[str, str | None] = {}
        for source in {e.source for e in self.registry.entries.values()}:
            try:
                now[source] = self.state(source)
            except PySparkException:  # the source is gone
                now[source] = None
        self.registry.drop([key for key, e in self.registry.entries.items() if e.state != now[e.source]])

    def _from_sketch(self, call: ApproxCall, source: str) -> DataFrame | None:
        entry = self.sketch(call, source)
        if entry is None:
            return None
        got = reg.answer(self.spark, entry, call)
        if call.name == TOP_K:
            if not got or len(got) > _LITERALS:
                rows = self.spark.createDataFrame(got, "value string, estimate long, error long")
            else:  # literals: no job
                rows = self.spark.sql(f"SELECT * FROM VALUES {', '.join(f'({literal(v)}, {n}L, {e}L)' for v, n, e in got)} AS _(value, estimate, error)")
            return rows.withColumn("value", F.col("value").cast(entry.value_type))
        name = (call.alias or call.name).replace("`", "``")
        return self.spark.sql(f"SELECT {got}{'L' if call.name == FREQ else 'D'} AS `{name}`")  # a literal: no job

    def value(self, text: str) -> object:
        """What a kept sketch says to SELECT call FROM source [WHERE condition]: a number, or the rows of a top-k. While the answer
        is trusted, asking again neither plans nor runs anything."""
        if not self._open:
            raise MisuseError("the session is closed")
        changes, until, value = self._values.get(text, (-1, 0.0, None))
        if changes == self._changes and time.monotonic() < until:
            return value
        lone = st.lone_call(st.plan(text))
        entry = self.sketch(*lone) if lone else None
        if entry is None:
            raise QueryError("not a statement that one kept sketch answers")
        value = reg.answer(self.spark, entry, lone[0])
        self._values[text] = (self._changes, time.monotonic() + self.recheck, value)
        return value

    # changes

    def _insert(self, insert: st.Insert) -> DataFrame:
        schema = self.spark.table(insert.table).schema
        columns = list(insert.columns) or [f.name.lower() for f in schema]
        values = self.spark.sql(f"SELECT * FROM {insert.values} AS _given({', '.join(f'`{c}`' for c in columns)})")
        given = {c.lower() for c in columns}
        rows = values.select(*[(F.col(f"`{f.name}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        # the literals of a statement: they are evaluated once, for the table and for the sketches
        rows = self.spark.createDataFrame(rows.collect(), schema)
        self.append(rows, insert.table, insert.hint, [c.lower() for c in insert.columns])
        return self.spark.createDataFrame([], "count long")

    def append(self, rows: DataFrame, table: str, hint: st.Hint | None = None, named: list[str] | None = None) -> None:
        """Appends rows to a table and takes its sketches along: those of the table alone, with or without a condition, get
        the rows' own sketches merged in, all or none. If the table was empty, sketches of the hinted columns, or of the
        named ones at the default bounds, are started. Sketches that can't follow are out of date by the table's state."""
        before: dict[str, str | None] = {}
        follow = []
        for e in list(self.registry.entries.values()):
            if _reads_only(e.source, table):
                if e.source not in before:
                    before[e.source] = self.state(e.source)
                if e.state == before[e.source]:
                    follow.append(e)
        was_empty = not any(e.n for e in follow) and self.spark.table(table).isEmpty()
        view = f"_boundwise_{uuid.uuid4().hex}"
        rows.select(*self.spark.table(table).columns).write.insertInto(table)
        self.spark.catalog.refreshTable(table)  # rows can be of another session, as a stream's batches are
        self._changes += 1
        try:
            rows.createOrReplaceGlobalTempView(view)
            after = {source: self.state(source) for source in before}

            def followed(some: list[reg.Entry]) -> list[reg.Entry]:
                source = _with_table(some[0].source, f"global_temp.{view}")
                deltas = reg.build_all(self.spark, source, [(e.kind, e.expression, e.params) for e in some], some[0].seed, "")
                return [reg.merge(self.spark, e, d, after[e.source]) for e, d in zip(some, deltas, strict=True)]

            self._keep([e for some in self._builders.map(followed, _passes(follow)) for e in some])
        finally:
            self.spark.catalog.dropGlobalTempView(view)
        if was_empty:
            self._prewarm(table, hint, named)
        self._forget_stale()

    def _prewarm(self, table: str, hint: st.Hint | None, named: list[str] | None) -> None:
        held = {c.lower() for c in self.spark.table(table).columns}
        hint = hint or st.Hint(tuple(named or ()), bounds.DEFAULT_EPSILON, bounds.DEFAULT_CONFIDENCE)
        source, started = f"FROM {table}", []
        state = self.state(source)
        for column in hint.columns if state else ():
            for kind in (reg.HLL, reg.KLL, reg.FREQUENCY):
                needed = reg.required_for(kind, hint.epsilon, hint.confidence)
                if column in held and needed and not self.registry.find(kind, normalised(source), normalised(column), self.seed, state, needed):
                    started.append((kind, column, needed))
        one = [x for x in started if x[0] != reg.FREQUENCY]
        passes = [one] * bool(one) + [[x] for x in started if x[0] == reg.FREQUENCY]
        built = self._builders.map(lambda some: reg.build_all(self.spark, source, some, self.seed, state), passes)
        self._keep([e for some in built for e in some if e.n])

    def append_batch(self, stream: str, batch: int, rows: DataFrame, table: str, hint: st.Hint | None = None) -> bool:
        """append, once for each batch of a stream in this session; whether it did."""
        if self._batches.get(stream, -1) >= batch:
            return False
        self.append(rows, table, hint, rows.columns)
        self._batches[stream] = batch
        return True

    # without SQL

    def count_distinct(self, table: str, column: str, epsilon: float, confidence: float) -> float:
        return self.sql(f"SELECT {DISTINCT}({column}, {epsilon}, {confidence}) FROM {table}").first()[0]

    def frequency(self, table: str, column: str, target: object, epsilon: float, confidence: float) -> int:
        return self.sql(f"SELECT {FREQ}({column}, {literal(str(target))}, {epsilon}, {confidence}) FROM {table}").first()[0]


def _passes(entries: list[reg.Entry]) -> list[list[reg.Entry]]:
    """Entries that are built in one pass: those of one source and seed that aren't of frequencies."""
    out: dict[tuple, list[reg.Entry]] = {}
    for e in entries:
        out.setdefault((e.source, e.seed, e.key if e.kind == reg.FREQUENCY else None), []).append(e)
    return list(out.values())


def _reads_only(source: str, table: str) -> bool:
    """FROM table, or FROM table WHERE a condition without a subquery."""
    ts, name = tokens(source), normalised(table)
    rest = normalised(source).removeprefix("from ")
    return rest == name or rest.startswith(f"{name} where ") and not any(t.low == "select" for t in ts)


def _with_table(source: str, table: str) -> str:
    ts = tokens(source)
    at = 2
    while at + 1 < len(ts) and ts[at].kind == ".":
        at += 2
    return f"FROM {table} {source[ts[at].start :] if at < len(ts) else ''}"


def formatted(value: object) -> str | None:
    """A value as the shell shows it."""
    return None if value is None else f"{value:.6f}" if isinstance(value, float) else str(value)
