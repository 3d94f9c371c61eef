"""Sentence BLEU-4 as published: 13a tokens, exponential smoothing, effective order."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 13a rules: what is put for what, in this order, then the splits.
JOINS = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SPLITS = ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))


def tokens(text: str) -> list[str]:
    text = text.rstrip()
    for find, put in JOINS:
        text = text.replace(find, put)
    text = f" {text} "
    for find, put in SPLITS:
        text = re.sub(find, put, text)
    return text.split()


#: White space of Python's texts, as a class of Java's patterns.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def token_column(text: Column) -> Column:
    """tokens() as a column; a null has none."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE + r"\z", "")
    text = reduce(lambda t, rule: F.replace(t, F.lit(rule[0]), F.lit(rule[1])), JOINS, text)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for find, put in SPLITS:
        text = F.regexp_replace(text, find, put.replace("\\", "$"))
    return F.filter(F.split(text, _SPACE), lambda t: t != "")


def sentence_bleu(hypothesis: str, reference: str, order: int = 4) -> float:
    """0 to 1."""
    return token_bleu(tokens(hypothesis), tokens(reference), order)


def token_bleu(h: list[str], r: list[str], order: int = 4) -> float:
    if not h or not r:
        return 0.0
    logs, used, smooth = 0.0, 0, 1.0
    for n in range(1, order + 1):
        a = Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
        total = sum(a.values())
        if not total:
            break
        b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        match = sum(min(c, b[g]) for g, c in a.items())
        if n == 1 and not match:
            return 0.0
        if not match:
            smooth *= 2
        logs += math.log(match / total if match else 1 / (smooth * total))
        used += 1
    brevity = 1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))
    return brevity * math.exp(logs / used)
