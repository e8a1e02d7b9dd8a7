"""python -m boundwise.shell [root]: a line is a text of statements."""

from __future__ import annotations

import sys
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import SparkSession

from . import __version__
from .errors import QueryError
from .session import Session

HELP = ".help  .quit  .exit  .memory, or SQL with approx_count_distinct, approx_25, approx_median, approx_75, approx_freq, approx_top_k"


def loop(session: Session, lines: Iterable[str], out: TextIO) -> None:
    def show(values: list[str | None], names: list[str]) -> None:
        print(" | ".join(f"{n}={'' if v is None else v}" for n, v in zip(names, values, strict=True)), file=out)

    for line in lines:
        line = line.strip()
        if line in (".quit", ".exit"):
            break
        if line == ".help":
            print(HELP, file=out)
        elif line == ".memory":
            print(session.memory_bytes(), file=out)
        elif line:
            try:
                session.exec(line, show)
            except QueryError as e:
                print(f"error: {e}", file=out)


def main() -> None:
    spark = SparkSession.builder.appName(f"boundwise {__version__}").getOrCreate()
    with Session(spark, sys.argv[1] if len(sys.argv) > 1 else None) as session:
        loop(session, sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
