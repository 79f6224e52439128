"""Toxicity: noisy-channel restoration of disguised words, then a rule score over the restored text.

A disguised word (digits and signs for letters, signs or spaces between letters, doubled or stretched letters) is a lattice of
the characters that each written one may stand for; a run of short fragments is one lattice whose spaces may be dropped or
end a word. Viterbi decoding finds the letters that the channel costs and a character trigram model, counted over the whole
corpus, make likeliest. Tokens of any length are restored and scored. Restored words give features (the word and its first
letters); a greedy cover over labelled texts picks the few whose presence marks the label beyond chance, and words that do so
without following others join them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, text_or_empty

LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER, EDGE, SIZE = 26, 27, 28  # any other letter; the space around words
# What a sign or digit may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
COST_SWAP, COST_REPEAT, COST_KEEP_REPEAT, COST_DOUBLE, COST_JOIN = 1.0, 0.3, 1.5, 3.0, 0.2
COST_CUT = 2.0  # for a space between tokens that look like words: most of those are just that
# Signs without a letter to stand for, and runs of one sign, are likely noise; digits hardly ever are.
COST_DROP_NOISE, COST_DROP_SIGN, COST_DROP_DIGIT = 1.0, 4.0, 7.5
TRAIN_ROWS = 20_000  # labelled texts that the rules are fitted on, at most
MIN_PREFIX, MAX_PREFIX = 4, 8
CACHE_ROWS, RUNS = 400_000, 50_000
REMEMBERED = 64  # tokens up to this length are remembered once restored; longer ones are restored each time
FRAGMENTS = re.compile(r"(?<!\S)(?:\S{1,3}\s+){2,}\S{1,3}(?!\S)")
DOUBLED = re.compile(r"(.)\1", re.S)
STRETCHED = re.compile(r"(.)\1{3,}", re.S)
EDGES = ".,;:!?%#&*\"'()[]{}|<>«»“”„…-_~`^/\\="
PRIOR, CERTAIN = 0.02, 0.7


def _table() -> np.ndarray:
    t = np.full(256, EDGE, np.uint8)
    for i, c in enumerate(LETTERS):
        t[ord(c)] = t[ord(c.upper())] = i
    t[128:] = OTHER
    return t


_CODE = _table()
_LETTER = {c: i for i, c in enumerate(LETTERS)}


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Letter trigrams of all texts; a fixed number of counts (SIZE cubed), whatever the corpus."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, np.int64)
        for frame in frames:
            for text in frame["text"]:
                x = _CODE[np.frombuffer(f"  {text} ".encode(), np.uint8)].astype(np.int64)
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"k": some, "n": total[some]})

    rows = docs.select(text_or_empty(text_col).alias("text")).mapInPandas(run, "k bigint, n bigint")
    out = np.zeros(SIZE**3)
    for k, n in rows.groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out


def log_model(counts: np.ndarray) -> list:
    """Log probability of the third letter after two, backing off to one and none."""
    c3 = counts.reshape(SIZE, SIZE, SIZE)
    p1 = (c3.sum((0, 1)) + 1) / (c3.sum() + SIZE)
    c2 = c3.sum(0)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return np.log(p3).tolist()


def decode(written: str, model: list, join: float = COST_JOIN) -> str:
    """Likeliest letters behind lower-case characters; a space may be dropped, or stays as the end of a word.

    ``join`` is what a dropped space costs. Linear in the length: a state is the last two letters and the last one as text, and its text is a chain of letters that
    states share. Runs of one character count as three at most.
    """
    written = STRETCHED.sub(r"\1\1\1", written)
    beam: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(EDGE, EDGE, ""): (0.0, None)}
    runs = [len(m[0]) for m in re.finditer(r"(.)\1*", written, re.S) for _ in m[0]]
    for ch, run in zip(written, runs):
        new: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

        def offer(state: tuple[int, int, str], cost: float, chain: tuple | None) -> None:
            if cost < new.get(state, (math.inf,))[0]:
                new[state] = (cost, chain)

        letter_written = ch.isalpha()
        options = [(ch, 0.0)] if letter_written else [(x, COST_SWAP) for x in STANDS_FOR.get(ch, "")]
        for (a, b, last), (cost, chain) in beam.items():
            if ch == " ":
                offer((a, b, last), cost + join, chain)
                if b != EDGE:
                    offer((b, EDGE, " "), cost - model[a][b][EDGE], (" ", chain))
                continue
            for letter, price in options:
                k = _LETTER.get(letter, OTHER)
                again = letter == last
                offer((b, k, letter), cost + price - model[a][b][k] + (COST_KEEP_REPEAT if again and run > 2 else 0.0), (letter, chain))
                if again and run > 1:  # the same letter, doubled or stretched
                    offer((a, b, last), cost + price + (COST_REPEAT if run > 2 else COST_DOUBLE), chain)
            if not letter_written:
                noise = run > 2 or ch not in STANDS_FOR and not ch.isalnum()
                offer((a, b, last), cost + (COST_DROP_NOISE if noise else COST_DROP_DIGIT if ch.isalnum() else COST_DROP_SIGN), chain)
        beam = new
    # Of equally likely readings the one reached first, which is the same everywhere.
    chain = min(((cost - model[a][b][EDGE], i, chain) for i, ((a, b, _), (cost, chain)) in enumerate(beam.items())), key=lambda x: x[:2])[2]
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out))


def restore(word: str, model: list) -> str:
    """A lower-case word without white space, restored; one of letters only, none of them doubled, comes back unchanged."""
    return word if word.isalpha() and not DOUBLED.search(word) else decode(word, model)


def _plain(token: str) -> str:
    """Token without signs at its ends; leetspeak signs stay where they may be letters."""
    return token.lower().strip(EDGES)


def _fragments(text: str) -> Iterator[tuple[str, bool]]:
    """Runs of three or more fragments of one or two characters, with a space between; whether most are single letters."""
    for m in FRAGMENTS.finditer(text):
        run: list[str] = []
        for token in [*m[0].lower().split(), ""]:
            part = token if len(token) == 1 and (token.isalnum() or token in STANDS_FOR) else token.strip(EDGES)
            if 0 < len(part) <= 2 and (part.isalnum() or len(part) == 1):
                run.append(part)
                continue
            single = sum(len(x) == 1 and x.isalpha() for x in run)
            if len(run) >= 3 and len(set(run)) > 1:
                yield " ".join(run), single >= 3 and 2 * single >= len(run)
            run = []


class Reader(dict):
    """Restored words of a text, remembering words it has met (at most CACHE_ROWS of REMEMBERED characters)."""

    def __init__(self, model: list) -> None:
        self.model = model

    def __missing__(self, word: str) -> str:
        out = restore(word, self.model)
        if len(self) >= CACHE_ROWS:
            self.clear()
        if len(word) <= REMEMBERED:
            self[word] = out
        return out

    def words(self, text: str) -> set[str]:
        out = set()
        for token in set(text.split()):
            word = _plain(token)
            out.add(word)
            out.add(self[word])
        for run, spelt in _fragments(text):
            if spelt:
                out.add(run.replace(" ", ""))
                out.update(decode(run, self.model).split())
        out.discard("")
        return out


def features(words: set[str]) -> set[str]:
    """A restored word in full (with a sign of its end) and its first letters."""
    out = set()
    for w in words:
        out.add(f"{w}$")
        out.update(w[:n] for n in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1))
    return out


def _tail(n: int, k: int, p: float) -> float:
    """Log of the chance of k or more hits in n draws (a Chernoff bound)."""
    if k <= n * p:
        return 0.0
    q = k / n
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def fit_rules(docs: DataFrame, labels: DataFrame, model: list, label: str = "toxic") -> dict[str, float]:
    """Features that mark the label, each with its precision.

    Fitted on at most TRAIN_ROWS labelled texts (those with the smallest hash), repeats of a text once. First the
    features of positive texts that recur are counted, then how often those occur elsewhere; a greedy cover takes the
    feature that explains most positive texts still unexplained, as long as chance does not (Bonferroni at 1 %).
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # At most TRAIN_ROWS rows of 12 bytes: safe to broadcast at any size of the tables.
    train = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")

    def sets(frames: Iterator[pd.DataFrame], keep: frozenset | None, docs_too: bool) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                rows = [(doc, features(reader.words(text))) for doc, text in zip(part["doc_id"], part["text"])]
                rows = [(doc, got if keep is None else got & keep) for doc, got in rows]
                n = Counter(f for _, fs in rows for f in fs)
                if n and docs_too:
                    yield pd.DataFrame([(f, d) for d, fs in rows for f in fs], columns=["f", "doc"])
                elif n:
                    yield pd.DataFrame({"f": list(n), "n": list(n.values())})

    def counted(rows: DataFrame, keep: frozenset | None) -> DataFrame:
        return rows.mapInPandas(partial(sets, keep=keep, docs_too=False), "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = train.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min("doc_id").alias("doc_id"))
    # One row per text, TRAIN_ROWS at most: written once for the passes below.
    distinct = Scratch(docs.sparkSession, "toxicity").save(train.join(F.broadcast(texts.select("doc_id")), "doc_id"), "train")
    totals = {y: n for y, n in texts.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos:
        return {}
    base = pos / (pos + neg)
    # Fewer texts than this cannot be told from chance among a thousand features, even if no other text has the feature.
    least = max(3, math.ceil(0.001 * pos), math.ceil(math.log(1e5) / -math.log(base)) if neg else 3)
    often = {f: n for f, n in counted(distinct.where("y = 1"), None).where(F.col("n") >= least).collect()}  # of TRAIN_ROWS texts at most
    other = {f: n for f, n in counted(distinct.where("y = 0"), frozenset(often)).collect()}
    bar = math.log(0.01 / max(1, len(often)))
    strong = {}
    for f, n in often.items():
        m = n + other.get(f, 0)
        precision = (n + 0.5 * base) / (m + 0.5)
        if precision >= 0.9 and _tail(m, n, base if neg else 0.5) <= bar:
            strong[f] = precision
    del often, other
    if not strong:
        return {}
    met = distinct.where("y = 1").mapInPandas(partial(sets, keep=frozenset(strong), docs_too=True), f"f string, doc {kind}")
    found = {f: frozenset(d) for f, d in met.groupBy("f").agg(F.collect_set("doc")).collect()}
    rules, left = {}, set().union(*(found[f] for f in strong))
    while left:
        # Longer features first where they explain as much; then by name, so the result is the same everywhere.
        f = max(strong, key=lambda x: (len(found[x] & left), len(x), x))
        gain = found[f] & left
        if len(gain) < least:
            break
        rules[f] = strong[f]
        left -= gain
    return rules | {f: strong[f] for f in _own_words(strong, found)}


def _own_words(strong: dict[str, float], found: dict[str, frozenset]) -> list[str]:
    """Strong words that are marks in their own right.

    Words of one text that was copied with small changes recur together; a mark's texts are its own. So a word counts
    unless more than two other words have nearly the same texts.
    """
    words = sorted((f for f in strong if f.endswith("$")), key=lambda f: (-len(found[f]), f))
    number = {d: i for i, d in enumerate(sorted(set().union(*(found[f] for f in words)), key=str))} if words else {}
    bits = [sum(1 << number[d] for d in found[f]) for f in words]
    size = [b.bit_count() for b in bits]
    out = []
    for i, f in enumerate(words):
        alike = sum(1 for j in range(len(words)) if j != i and 2 * size[j] > size[i] and size[j] < 2 * size[i] and 2 * (bits[i] & bits[j]).bit_count() > (bits[i] | bits[j]).bit_count())
        if alike <= 2:
            out.append(f)
    return out


class _Scorer(dict):
    """Token to its restored form and the chance that it leaves of a text being clean (1.0 where no rule meets it)."""

    def __init__(self, rules: dict[str, float], model: list) -> None:
        self.rules, self.model = rules, model
        words = sorted({f.rstrip("$") for f in rules})
        self.hint = re.compile("|".join(map(re.escape, words))) if words else None
        self.marks = ahocorasick.Automaton()
        for w in words:
            self.marks.add_word(w, len(w))
        self.marks.make_automaton()
        self.runs: dict[tuple[str, float], list[str]] = {}

    def word(self, w: str) -> float:
        return min((1 - self.rules[f] for f in features({w}) if f in self.rules), default=1.0) if w else 1.0

    def __missing__(self, token: str) -> tuple[str, float]:
        word = _plain(token)
        read = restore(word, self.model)
        out = read.replace(" ", ""), min(self.word(w) for w in {word, read})
        if len(self) >= CACHE_ROWS:
            self.clear()
        if len(token) <= REMEMBERED:
            self[token] = out
        return out

    def decoded(self, run: str, join: float = COST_JOIN) -> list[str]:
        if (out := self.runs.get((run, join))) is None:
            out = decode(run, self.model, join).split()
            if len(self.runs) >= RUNS:
                self.runs.clear()
            self.runs[run, join] = out
        return out

    def cut(self, tokens: list[str], read: list[str]) -> Iterator[str]:
        """Runs of tokens that, joined, begin with a word or stem of a rule that no token holds by itself."""
        joined = "".join(read)
        hits = [(end - n + 1, end + 1) for end, n in self.marks.iter(joined)]
        if not hits:
            return
        ends = list(accumulate(map(len, read)))
        for begin, end in hits:
            i, j = bisect_right(ends, begin), bisect_left(ends, end)
            if i < j and ends[i] - len(read[i]) == begin:  # from the start of a token into another
                yield " ".join(filter(None, map(_plain, tokens[i : j + 1])))

    def score(self, text: str) -> float:
        if not self.rules:
            return PRIOR
        tokens = text.split()
        known = {t: self[t] for t in set(tokens)}
        found = set(known)
        for run, spelt in _fragments(text):
            joined = run.replace(" ", "")
            if spelt:
                found.add(joined)
            # Longer fragments are common in plain text: decoded where, joined, they hold a word or stem of a rule.
            if spelt or self.hint.search(joined):
                found.update(self.decoded(run))
        # So are words that stand beside each other: a word cut in pieces of any length is decoded where they spell a rule.
        for run in set(self.cut(tokens, [known[t][0] for t in tokens])):
            found.update(self.decoded(run, COST_CUT))
        return 1 - (1 - PRIOR) * math.prod(sorted(p for x in found if (p := self[x][1]) != 1.0))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Score every whole text.

    ``labels`` (doc_id, label) are the rows that may be learnt from; nothing else about a row enters its score. Returns
    ``(doc_id, score, predicted)``, one row per input row; predicted is 1 from a score of 0.7. Null texts count as
    empty and score the prior, as all texts do where nothing could be learnt. Labels may be null or repeated (the
    largest counts) or point nowhere. Extra columns are ignored; an empty table gives an empty result.
    """
    model = log_model(trigram_counts(docs))
    rules = fit_rules(docs, labels, model, label)
    return apply_rules(docs, rules, model)


def _score_udf(docs: DataFrame, rules: dict[str, float], model: list):
    sent = docs.sparkSession.sparkContext.broadcast((rules, model))  # SIZE cubed numbers and the few rules

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(*sent.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return run


def apply_rules(docs: DataFrame, rules: dict[str, float], model: list) -> DataFrame:
    out = docs.select("doc_id", _score_udf(docs, rules, model)(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CERTAIN).cast("int"))


def without(docs: DataFrame, rules: dict[str, float], model: list) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text is not predicted to bear the label."""
    return docs.where(_score_udf(docs, rules, model)(text_or_empty()) < CERTAIN)


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
