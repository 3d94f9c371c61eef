"""A row's options as rows or as lists by class: any number of them, found by the names of their columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def options_of(df: DataFrame, text: str, label: str | None = None) -> Column:
    """Array of (option, text, label), in the order of the columns.  `text` and `label` are patterns whose one group is the
    option's name, such as Answer(.+)Text.  An option without a column for its label has none; a text of null is empty;
    labels are texts, trimmed, and an empty one is null.  No column with a text, or two for one option, is an error."""

    def found(pattern: str | None) -> dict[str, str]:
        got: dict[str, str] = {}
        for c in df.columns if pattern else ():
            if m := re.fullmatch(pattern, c):
                if m[1] in got:
                    raise ValueError(f"option {m[1]} has columns {got[m[1]]} and {c}")
                got[m[1]] = c
        return got

    texts, labels = found(text), found(label)
    if not texts:
        raise ValueError(f"no column is like {text}")
    said = lambda o: F.nullif(F.trim(df[labels[o]].cast("string")), F.lit("")) if o in labels else F.lit(None).cast("string")
    return F.array(*[F.struct(F.lit(o).alias("option"), F.coalesce(df[c].cast("string"), F.lit("")).alias("text"), said(o).alias("label")) for o, c in texts.items()])


def option_rows(df: DataFrame, keep: list[str], text: str, label: str | None = None) -> DataFrame:
    """(keep..., option, text, label), one row an option."""
    return df.select(*keep, F.inline(options_of(df, text, label)))


def kind_of(label: Column, target: Column) -> Column:
    """target, other or unlabelled; a target of null is nobody's label."""
    return F.when(label.isNull(), "unlabelled").when(F.coalesce(label == target.cast("string"), F.lit(False)), "target").otherwise("other")


def label_lists(df: DataFrame, text: str, label: str, correct: Column, target: Column) -> DataFrame:
    """Adds target, other and unlabelled, in the stead of columns of these names: lists of a row's wrong options by the
    class of their label, in the order of the columns.  The right option, trimmed, is in none; where it is null or names no
    option, all options are wrong.  The lists are made within the row, without a shuffle."""
    wrong = F.filter(options_of(df, text, label), lambda o: ~F.coalesce(o["option"] == F.trim(correct), F.lit(False)))
    of = lambda kind: F.filter(wrong, lambda o: kind_of(o["label"], target) == kind)
    return df.withColumns({k: of(k) for k in ("target", "other", "unlabelled")})
