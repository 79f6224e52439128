"""Mixing to target weights with soft domain membership, with DataFrame operations only.

A naive Bayes classifier fitted on a labelled table gives each document posterior probabilities of the domains. Rates of
the documents, not below zero, are fitted by projected-gradient least squares so that the expected tokens of each domain
match its target. Steps add up before they are projected, so a document's rate follows from its own posteriors and one
number per domain; and documents with equal posteriors (rounded to DIGITS places) have equal rates, so they are added up
once and each pass is one aggregation over those profiles. Step lengths follow the last change of the gradient
(Barzilai and Borwein).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, text_or_empty

TRAIN_ROWS = 20_000  # labelled documents that the classifier is fitted on, at most
VOCABULARY = 128  # words that the classifier looks at: those whose frequency differs most between the domains
OTHERS = "*"  # the name under which the smallest domains count together, if a caller bounds their number
DIGITS = 4  # places of a posterior
PASSES, CLOSE = 400, 1e-5  # passes of a round at most; misses that count as none, as a share of all tokens
RIDGE, ROUNDS = 1e-2, 4  # pull towards the rates of the round before


def _words(text: Column) -> Column:
    flat = F.lower(text)
    for sign in ("\n", "\t", "\r"):
        flat = F.replace(flat, F.lit(sign), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _row_of(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit_domains(docs: DataFrame, labelled: DataFrame, vocabulary: int = VOCABULARY, domains: int | None = None) -> tuple[list[str], list[float], dict[str, list[float]]]:
    """Domains, their base scores and the words' scores, from ``labelled`` (doc_id, domain).

    At most TRAIN_ROWS labelled documents are used (those with the smallest hash); words are the ``vocabulary`` ones whose
    frequency differs most between domains. All domains are told apart, unless ``domains`` bounds their number: then the
    smallest count together as OTHERS.
    """
    one = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # a bounded table: safe to broadcast
    train = docs.select("doc_id", F.array_distinct(_words(text_or_empty())).alias("words")).join(F.broadcast(some), "doc_id")
    largest = train.groupBy("domain").count().orderBy(F.desc("count"), "domain").collect()  # at most TRAIN_ROWS
    if domains and len(largest) > domains:
        own = [r["domain"] for r in largest[: domains - 1]]
        train = train.withColumn("domain", F.when(F.col("domain").isin(own), F.col("domain")).otherwise(OTHERS))
        largest = train.groupBy("domain").count().collect()
    sizes = {r["domain"]: r["count"] for r in largest}
    names = sorted(sizes)
    if not names:
        return [], [], {}
    total = sum(sizes.values())
    counts = train.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("domain") == n).alias(f"n{i}") for i, n in enumerate(names)])
    every = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0)) / total
    apart = sum((F.abs(F.col(f"n{i}") / sizes[n] - every) * (sizes[n] / total) for i, n in enumerate(names)), F.lit(0.0))
    best = counts.orderBy(apart.desc(), "word").limit(vocabulary).collect()
    base = [math.log(sizes[n] / total) for n in names]
    scores = {}
    for row in best:
        p = [(row[f"n{i}"] + 0.5) / (sizes[n] + 1) for i, n in enumerate(names)]
        scores[row["word"]] = [math.log(x / (1 - x)) for x in p]
        base = [b + math.log(1 - x) for b, x in zip(base, p)]
    return names, base, scores


def domain_posteriors(docs: DataFrame, labelled: DataFrame, vocabulary: int = VOCABULARY, domains: int | None = None) -> tuple[list[str], DataFrame]:
    """Names of the domains, and ``(doc_id, n_tokens, posterior array<double>)`` for every row of ``docs``."""
    names, base, scores = fit_domains(docs, labelled, vocabulary, domains)
    words = docs.select("doc_id", _words(text_or_empty()).alias("words"))
    if not scores:
        flat = [1 / len(names)] * len(names) if names else []
        return names, words.select("doc_id", F.size("words").cast("bigint").alias("n_tokens"), (_row_of(flat) if flat else F.array().cast("array<double>")).alias("posterior"))
    table = F.map_from_arrays(F.array(*[F.lit(w) for w in scores]), F.array(*[_row_of(v) for v in scores.values()]))
    met = F.array_intersect("words", F.array(*[F.lit(w) for w in scores]))
    raw = F.aggregate(met, _row_of(base), lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
    out = words.select("doc_id", F.size("words").cast("bigint").alias("n_tokens"), raw.alias("raw"))
    out = out.select("doc_id", "n_tokens", F.transform("raw", lambda x: F.exp(x - F.array_max("raw"))).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return names, out.select("doc_id", "n_tokens", F.transform("e", lambda x: F.round(x / total, DIGITS)).alias("posterior"))


def _rate(pull: list[float], cap: float | None) -> Column:
    """Rate of a row after steps that add up to ``pull``, projected onto what a rate may be."""
    down = F.aggregate(F.zip_with("posterior", _row_of(pull), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    new = F.greatest(F.lit(0.0), 1 - down)
    return F.least(F.lit(float(cap)), new) if cap is not None else new


def fit_rates(mass: Callable[[list[float]], list[float]], own: list[float], wanted: list[float]) -> list[float]:
    """Sums of the steps, per domain, that minimise the squared misses, each over its domain's own tokens.

    ``mass`` gives each domain's tokens under such sums. A round minimises the misses and RIDGE times the squared change of
    the rates since the round before; rounds go on while misses shrink. Raises if a round does not settle.
    """
    k, everything = len(own), sum(own)
    centre, least = [0.0] * k, math.inf
    for _ in range(ROUNDS):
        pull, before, step = list(centre), None, 1.0
        for _ in range(PASSES):
            now = mass(pull)
            grad = [(a - t) / m - RIDGE * (x - c) if m > 0 else 0.0 for a, t, m, x, c in zip(now, wanted, own, pull, centre)]
            if max(abs(g) * m for g, m in zip(grad, own)) <= CLOSE * everything:
                break
            if before is not None:
                moved = [x - y for x, y in zip(pull, before[0])]
                bent = -sum(m * d * (g - h) for m, d, g, h in zip(own, moved, grad, before[1]))
                step = sum(m * d * d for m, d in zip(own, moved)) / bent if bent > 0 else 1.0
                step = min(max(step, 0.5), 1 / RIDGE)
            before = pull, grad
            pull = [x + step * g for x, g in zip(pull, grad)]
        else:
            raise RuntimeError(f"rates did not settle in {PASSES} passes")
        centre = pull
        miss = max(abs(a - t) for a, t in zip(now, wanted))
        if miss <= 2 * CLOSE * everything or miss > 0.5 * least:
            break
        least = miss
    return centre


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | float, total: float | str = "same", cap: float | None = None,
    vocabulary: int = VOCABULARY, domains: int | None = None,
) -> DataFrame:
    """Rates at which documents are to be drawn so that domains reach their target weights.

    ``targets`` are weights per domain (missing: 0), or an exponent that tempers the domains' own shares. ``total`` is the
    number of tokens wanted: a number, "same" as the input, or "within" (the most that no domain has to repeat for).
    ``vocabulary`` and ``domains`` bound the classifier, see ``fit_domains``; domains pooled as OTHERS have their targets
    pooled. Returns one row per input row: ``(doc_id, n_tokens, posterior, rate)``; ``rate`` is at least 0 and at most
    ``cap``. Targets that cannot be met are missed by least squares; a fit that does not settle raises an error. Null and
    empty texts have no tokens and the prior as posterior. Without labelled documents, or with no weight on any domain,
    all rates are 1. Rows that repeat count each; extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names, posteriors = domain_posteriors(docs, labelled, vocabulary, domains)
    table = scratch.save(posteriors, "posteriors")
    if not names:
        return table.withColumn("rate", F.lit(1.0))
    profiles = scratch.save(table.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens")), "profiles")

    def mass(pull: list[float]) -> list[float]:
        taken = profiles.select("posterior", (_rate(pull, cap) * F.col("n_tokens")).alias("t"))
        got = taken.agg(*[F.sum(F.col("t") * F.element_at("posterior", i + 1)) for i in range(len(names))]).first()
        return [float(x or 0.0) for x in got]

    own = mass([0.0] * len(names))
    everything = sum(own)
    if isinstance(targets, dict):
        weights = [targets.get(n, 0.0) for n in names]
        if OTHERS in names and OTHERS not in targets:
            weights[names.index(OTHERS)] = sum(w for n, w in targets.items() if n not in names)
    else:
        weights = [(m / everything) ** targets if m > 0 else 0.0 for m in own] if everything > 0 else []
    if everything <= 0 or sum(weights) <= 0:
        return table.withColumn("rate", F.lit(1.0))
    shares = [w / sum(weights) for w in weights]
    if total == "within":
        total = min((m / s for m, s in zip(own, shares) if s > 0), default=everything)
    wanted = [s * (everything if total == "same" else float(total)) for s in shares]
    return table.withColumn("rate", _rate(fit_rates(mass, own, wanted), cap))


def copies_of(rate: Column, key: Column, seed: int = 42) -> Column:
    """Whole number of times to take a row: the rate rounded by a hash of its key, so that it is right on average."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return F.floor(rate + u).cast("bigint")
