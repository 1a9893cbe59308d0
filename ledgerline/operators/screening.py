"""Screening of untrusted text for instructions, fencing it, and search over what is published.

Screening is a classifier of clauses that learns from labelled ones (attempts.EXAMPLES, or others). A clause's features are its words and the ordered pairs of words at
most `NEAR` apart; addresses, fences, line starts and colons are words of their own, so that sending somewhere or speaking under a label can be learned. A kind has a
weight for each feature by logistic regression against the clean clauses. A stretch of `STRETCH` words and more scores the sum over its distinct features, and a text is reported for a
kind if some stretch reaches the kind's threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc
from .attempts import EXAMPLES

#: Ends of clauses, and what becomes a word of its own: pattern and word.
ENDS = r"[.;!?]+(?:\s+|$)|\n\s*\n"
MARKS = (
    (r"[a-z]+://\S+", " addressmark "), (r"[^\s@]+@[^\s@]+[.][a-z]+", " addressmark "), (r"(?:#{3,}|-{3,}|={3,}|\*{3,}|`{3,})", " fencemark "),
    (r"[:>]", " colonmark "), (r"\n", " linemark "), (r"[^\p{L}\p{N}]+", " "),
)
NEAR, STRETCH = 3, 24
#: Letters of words that may be too common to say anything.
SHORT = 4
#: Ridge of the fit, and the least weight that is kept.
RIDGE, WEIGHT = 0.1, 0.1


class Screen(NamedTuple):
    """Weights of features by kind, and what the features of a kind have to add up to."""

    weights: dict[str, dict[str, float]]
    threshold: dict[str, float]


def _clause_features(text: str) -> list[list[tuple[str, int]]]:
    """Of each clause its features and the place of their first word; in Python for the labelled clauses."""
    out = []
    for clause in re.split(ENDS, text.lower()):
        for pattern, word in MARKS[:-1]:
            clause = re.sub(pattern, word, clause)
        words = ["startmark", *re.sub(r"[\W_]+", " ", clause).split()]
        out.append([(f, i) for i, w in enumerate(words) for f in (w, *(f"{w} {words[i + n]}" for n in range(1, NEAR + 1) if i + n < len(words)))])
    return out


def stretches(features: list[tuple[str, int]]) -> list[set[str]]:
    """The distinct features of each stretch; stretches overlap by half."""
    half, out = STRETCH // 2, {}
    for f, i in features:
        for w in (i // half, i // half - 1):
            if w >= 0 or i < half:
                out.setdefault(max(w, 0), set()).add(f)
    return list(out.values())


def learn(examples: dict[str, tuple[str, ...]], rounds: int = 60) -> Screen:
    """A logistic regression for each kind of labelled texts against the clean ones, by Newton's method. Bounded by the labelled texts."""
    weights, threshold = {}, {}
    # Short words of several kinds of attempts, and marks, say nothing by themselves: a feature has another word in it.
    words = lambda kind: {w for t in examples[kind] for c in _clause_features(t) for w, _ in c if " " not in w}
    broad = Counter(w for kind in examples for w in words(kind) if len(w) <= SHORT)
    plain = {w for w, n in broad.items() if n > 1} | {"startmark", *(word.strip() for _, word in MARKS)}
    telling = lambda f: not plain.issuperset(f.split(" "))
    for kind in sorted(set(examples) - {"clean"}):
        texts = [{f for c in _clause_features(t) for f, _ in c if telling(f)} for t in (*examples[kind], *examples["clean"])]
        y = np.array([1.0] * len(examples[kind]) + [0.0] * len(examples["clean"]))
        names = sorted(set().union(*texts))
        x = np.array([[f in t for f in names] for t in texts], dtype=float)
        # In the span of the texts, which are fewer than their features: w = x' a.
        gram, a, bias = x @ x.T, np.zeros(len(y)), 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(gram @ a + bias)))
            s = np.maximum(p * (1 - p), 1e-6)
            z = gram @ a + bias + (y - p) / s
            system = np.block([[gram + RIDGE * np.diag(1 / s), np.ones((len(y), 1))], [np.ones((1, len(y))), np.zeros((1, 1))]])
            solved = np.linalg.solve(system, np.append(z, 0.0))
            a, bias = a + 0.5 * (solved[:-1] - a), bias + 0.5 * (solved[-1] - bias)
        w = np.round(x.T @ a, 3)
        weights[kind] = {f: float(v) for f, v in zip(names, w) if abs(v) >= WEIGHT}
        threshold[kind] = round(-float(bias), 3)
    return Screen(weights, threshold)


@lru_cache(1)
def default_screen() -> Screen:
    return learn(EXAMPLES)


def visible(c: Column) -> Column:
    """In compatibility form (NFKC), without format characters, lower case, and with blanks other than line ends collapsed."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfkc(c), r"\p{Cf}", ""), r"[ \t\x{A0}]+", " "))


def scan(rows: DataFrame, column: str, name: str = "kinds", screen: Screen | None = None) -> DataFrame:
    """Adds the kinds of attempts that a text holds, in order of their names; a null text holds none."""
    screen = screen or default_screen()
    kinds = sorted(screen.weights)
    known = sorted({f for own in screen.weights.values() for f in own})
    firsts = sorted({f.split(" ")[0] for f in known})
    # One map for all kinds: a few hundred features, as many as the labelled clauses give.
    table = F.create_map(*[x for f in known for x in (F.lit(f), F.array(*[F.lit(screen.weights[k].get(f, 0.0)) for k in kinds]))])

    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  bound, so that it is computed once

    def words(clause: Column) -> Column:
        for pattern, word in MARKS:
            clause = F.regexp_replace(clause, pattern, word)
        return F.filter(F.split(F.concat(F.lit("startmark "), clause), " "), lambda w: w != "")

    def features(w: Column) -> Column:
        # Most words begin no feature: for them no pairs are made.
        each = F.transform(w, lambda x, i: F.when(x.isin(*firsts), F.transform(F.array(x, *[F.concat(x, F.lit(" "), F.get(w, i + n)) for n in range(1, NEAR + 1)]), lambda f: F.struct(f.alias("f"), F.floor(i / (STRETCH // 2)).alias("h")))))
        return F.filter(F.flatten(F.filter(each, lambda own: own.isNotNull())), lambda p: F.coalesce(p["f"].isin(*known), F.lit(False)))

    def held(found: Column) -> Column:
        halves = F.array_distinct(F.flatten(F.transform(found, lambda p: F.array(p["h"], F.greatest(p["h"] - 1, F.lit(0))))))
        own = F.transform(halves, lambda h: F.array_distinct(F.transform(F.filter(found, lambda p: (p["h"] == h) | (p["h"] == h + 1)), lambda p: p["f"])))
        valued = F.transform(own, lambda s: F.transform(s, lambda f: F.try_element_at(table, f)))
        total = lambda s, n: F.round(F.aggregate(s, F.lit(0.0), lambda a, w: a + w[n]), 3)
        over = lambda n, kind: lambda s: total(s, n) >= screen.threshold[kind]
        reached = lambda all_: [F.when(F.exists(all_, over(n, kind)), kind) for n, kind in enumerate(kinds)]
        return once(valued, lambda all_: F.array_compact(F.array(*reached(all_))))

    clauses = F.split(F.col("__visible"), ENDS)
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(clauses, lambda c: once(once(words(c), features), held)))))
    seen = rows.withColumn("__visible", visible(F.col(column)))
    return seen.withColumn(name, F.coalesce(found, F.array().cast("array<string>"))).drop("__visible")


def fenced(c: Column, mark: str) -> Column:
    """The text between marks; a text that contains the mark is refused."""
    return F.when(F.contains(c, F.lit(mark)), F.raise_error(F.lit("text contains the fence"))).otherwise(F.concat(F.lit(f"{mark}\n"), c, F.lit(f"\n{mark}")))


def search_documents(fields: DataFrame, whitelist: tuple[str, ...]) -> DataFrame:
    """document, version, extracted_on, values: a map of the published values of the whitelisted fields."""
    good = fields.where(F.col("published") & F.col("value").isNotNull() & F.col("field").isin(*whitelist))
    return good.groupBy("document", "version", "extracted_on").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("values"))


def search(index: DataFrame, wanted: str, hits: int, kind: str | None = None) -> DataFrame:
    """The newest 1 to 20 documents of which some value contains the text; `matched` is how many values do."""
    n = F.size(F.filter(F.map_values("values"), lambda v: F.contains(F.lower(v), F.lit(wanted.lower()))))
    found = index.withColumn("matched", n).where("matched > 0")
    if kind is not None:
        found = found.where(F.try_element_at("values", F.lit("document_type")) == kind)
    return found.orderBy(F.desc("extracted_on"), F.desc("matched"), "document").limit(min(max(hits, 1), 20))
