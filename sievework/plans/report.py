"""Reports rendered on the driver from small aggregates.  A table with more rows than the report has room for says how
many are not shown."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def _shown(df: DataFrame, rows: int) -> tuple[list[Row], int]:
    """The first rows, and the number of the others."""
    got = df.limit(rows + 1).collect()
    return got[:rows], df.count() - rows if len(got) > rows else 0


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A Markdown table; what doesn't fit into `rows` rows is counted below it."""

    def line(cells) -> str:
        texts = ["" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c).replace("|", "\\|") for c in cells]
        return f"| {' | '.join(texts)} |"

    shown, more = _shown(df, rows)
    out = [line(df.columns), "|" + "---|" * len(df.columns), *map(line, shown)]
    return "\n".join(out + ([f"\n{more} more rows not shown"] if more else []))


def sheet(df: DataFrame, title: str, rows: int = 2000, flags: dict[str, Callable[[Row], bool]] | None = None) -> str:
    """An HTML review sheet; rows for which a flag's test holds carry its name.  What doesn't fit is counted."""
    cell = lambda c, t="td": f"<{t}>{html.escape('' if c is None else str(c))}</{t}>"
    shown, more = _shown(df, rows)
    marks = lambda r: ", ".join(name for name, test in flags.items() if test(r))
    head = "".join(cell(c, "th") for c in [*df.columns, *(["flags"] if flags else [])])
    body = "".join(f"<tr>{''.join(map(cell, [*r, *([marks(r)] if flags else [])]))}</tr>" for r in shown)
    tail = f"<p>{more} more rows not shown</p>" if more else ""
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>{tail}"


def review_and_key(df: DataFrame, id_: str, hidden: list[str], seed: object) -> tuple[DataFrame, DataFrame]:
    """(review, key): rows in hash order under a number of their own, without the hidden columns; the key has those,
    the id and the number."""
    from sievework.functions.textkeys import hash_rank
    from sievework.operators.ranks import hash_ranked

    r = hash_ranked(df, [], hash_rank(seed, F.col(id_)), id_).withColumnRenamed("_r", "number").drop("_n")
    return r.select("number", *[c for c in df.columns if c not in (*hidden, id_)]), r.select("number", id_, *hidden)
