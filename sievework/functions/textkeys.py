"""Text keys and scalar functions.  Keys that need NFKC take a column already normalised by `nfkc`."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_MARK = "\u241f"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark lacks."""
    return text.str.normalize("NFKC")


def strip(c: Column) -> Column:
    """Without white space, Unicode's too, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def squash(c: Column) -> Column:
    return F.lower(collapse(c))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def short_hash(c: Column, prefix: str = "", digits: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, digits))


def sample_id(dataset: Column, *fields: Column) -> Column:
    """dataset, colon, 16 hex digits of the stripped fields joined by a mark."""
    return F.concat(dataset, F.lit(":"), short_hash(F.concat_ws(FIELD_MARK, *[strip(F.coalesce(f, F.lit(""))) for f in fields])))


def group_key(c: Column) -> Column:
    """Question group that keeps punctuation and digits; a minus sign becomes a hyphen."""
    return short_hash(squash(F.translate(c, "\u2212", "-")))


def question_key(c: Column) -> Column:
    """Question key of letters and digits only."""
    return short_hash(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", ""), "qg:")


def text_key(c: Column) -> Column:
    """Duplicate key: white space gone, operators kept."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def label_key(c: Column) -> Column:
    return squash(F.translate(c, "_", " "))


def answer_key(c: Column) -> Column:
    """Answer without LaTeX delimiters, roman text, thin spaces, ties, white space and dollars."""
    c = F.regexp_replace(c, r"\\(?:mathrm|text)\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, r"\\[()\[\],;!]", "")
    return F.regexp_replace(c, r"(?U)[\s$~]+", "")


def hash_rank(seed: object, *parts: object) -> Column:
    """Order key that depends on the seed and the row only, so other rows never move it."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hash_int(c: Column) -> Column:
    """First 32 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def hash_long(c: Column) -> Column:
    """First 60 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("long")


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z'\-]+)"), F.lit(1))


def shared_words(a: Column, b: Column, common: list[str]) -> Column:
    """Sorted longer words of a that b has too, without common ones, joined by comma and blank."""
    low = lambda c: F.array_distinct(F.transform(words(c), F.lower))
    both = F.array_except(F.array_intersect(low(a), low(b)), F.array(*[F.lit(w) for w in common]).cast("array<string>"))
    return F.array_join(F.array_sort(F.filter(both, lambda w: F.length(w) > 3)), ", ")


def evidence_found(evidence: Column, text: Column) -> Column:
    return F.when(blank(evidence), F.lit(False)).otherwise(F.coalesce(F.contains(squash(text), squash(evidence)), F.lit(False)))


def strict_label(c: Column, labels: list[str], invalid: str = "invalid") -> Column:
    """The label if the stripped text is one exactly."""
    return F.when(strip(c).isin(labels), strip(c)).otherwise(F.lit(invalid))


def lenient_label(c: Column, labels: list[str], invalid: str = "invalid") -> Column:
    """The one label that occurs as a whole word; several or none are invalid."""
    hits = F.array_compact(F.array(*[F.when(F.lower(c).rlike(rf"(?<![a-z_]){x}(?![a-z_])"), F.lit(x)) for x in labels]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(F.lit(invalid))


def render(template: str, values: Mapping[str, Column]) -> Column:
    """One pass over the template: inserted text is never looked at again."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def render_lines(template: str, values: Mapping[str, Column]) -> Column:
    """As render, and lines with a null value go."""
    import re

    lines = []
    for line in template.split("\n"):
        names = re.findall(r"\{(\w+)\}", line)
        whole = render(line, values)
        lines.append(F.when(~F.greatest(*[values[n].isNull() for n in names], F.lit(False)), whole) if names else F.lit(line))
    return F.concat_ws("\n", *lines)


def all_aligned(labels: Column, want: str = "aligned") -> Column:
    """True only for a non-empty array of that label."""
    return F.coalesce((F.size(labels) > 0) & F.forall(labels, lambda x: x.eqNullSafe(F.lit(want))), F.lit(False))
