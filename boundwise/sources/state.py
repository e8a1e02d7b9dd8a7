"""What a plan reads, as a text that changes when that does."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

_STATUS = re.compile(r"path=([^;]+);.*?length=(\d+);.*?modification_time=(\d+);", re.DOTALL)
#: What gives another value at another time, in another session or for another user. Fixed values.
_MOMENT = re.compile(r"\b(?:current_\w+|now|localtimestamp|session_user|user|uuid|rand\w*|input_file\w*|monotonically_increasing_id|spark_partition_id)\(")

_CHOICE = re.compile(r"^[\s:+\-|]*(?:Sample|GlobalLimit|LocalLimit|Offset|Tail)\b", re.MULTILINE)


def _analyzed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def _text(plan) -> str:
    """The plan without the numbers that its columns happen to have."""
    return plan.canonicalized().treeString()


def unsteady(df: DataFrame) -> bool:
    """Whether a plan's rows may differ from one moment to the next while its tables don't, are a sample or a choice among more, or
    come from subqueries in expressions, whose tables aren't among its leaves."""
    plan = _analyzed(df)
    text = _text(plan)
    return not plan.deterministic() or bool(_MOMENT.search(text) or _CHOICE.search(text)) or not plan.subqueriesAll().isEmpty()


def source_state(df: DataFrame, changes: int) -> str | None:
    """files:..., of the plan and its files, for what reads files only; plan:... with changes else; None for what isn't steady."""
    if unsteady(df):
        return None
    plan, kept = _analyzed(df), hashlib.sha256()
    leaves, only_files = plan.collectLeaves(), True
    kept.update(_text(plan).encode())
    for i in range(leaves.size()):
        files = _files(df, leaves.apply(i))
        only_files &= files is not None
        kept.update("\n".join(files or ()).encode())
    if only_files:
        return f"files:{kept.hexdigest()}"
    return f"plan:{kept.hexdigest()}:{plan.semanticHash()}:{changes}"


def _files(df: DataFrame, leaf) -> list[str] | None:
    """Path, length and modification time of each file of a relation, listed anew by the engine; None if it has no files."""
    if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    nil = getattr(getattr(df.sparkSession._jvm.scala.collection.immutable, "Nil$"), "MODULE$")
    index = leaf.relation().location()
    index.refresh()
    return sorted(" ".join(found) for found in _STATUS.findall(index.listFiles(nil, nil).mkString("\n")))
