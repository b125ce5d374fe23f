"""Quality rules under weak supervision.

Eleven rules vote 1 (good) or -1 (bad) or abstain (0). A document's votes depend on a
hidden class, good or bad, each rule independently of the others; whether a rule
abstains says nothing of the class. The rules' accuracies, that is the probabilities
of a bad vote under either class where a rule votes at all, and the share of good
documents are estimated by expectation-maximisation over all documents. The posterior probability of the class good takes the place of all-must-pass filtering.

Expectation-maximisation needs no more than how often each pattern of votes occurs
(3 ** 11 patterns at most); that table alone goes to the driver. The posterior is a
sum of log-odds, computed in the JVM beside the votes.

Edge cases: with a null or empty text every rule abstains, so the posterior is the
share of good documents and the row is kept. Whole texts are read. Nulls in other
columns play no part; repeated rows get the same posterior; further columns pass
through. Of an empty table nothing is estimated: the priors stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bough.llm.shared import spill

#: Frequent function words of the four languages.
STOPWORDS = "the of and to in is that it for was with as be by on le la les des est et que une un du dans der die das und ist von mit den dem nicht el los las del se por con para en de"
KEEP = 0.5
_START = (0.4, 0.02)  # P(bad vote | class) for the classes bad and good, before anything is known


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def measures(text: Column) -> dict[str, Column]:
    """What the rules look at, by name. To be a projection of its own: the votes use each several times."""
    n = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    tokens = F.col("tokens")
    return {
        "n": n,
        "words": F.size(tokens),
        "symbols": count(r"[#$%&*|<>{}=~^\\_@]"),
        "upper": count(r"[A-ZÀÂÇÈÉÊËÎÏÔÙÛÜÄÖÑÁÍÓÚ]"),
        "bangs": count("[!?]"),
        "digits": count("[0-9]"),
        "repeated": n - F.length(F.regexp_replace(text, r"(?<![^ \n])([^ \n]++)(?: \1(?![^ \n]))+", "$1")),
        "stop": F.size(F.array_intersect(tokens, F.array(*map(F.lit, STOPWORDS.split())))),
        "clean": count(r"(?<![^ \n\t])[\p{L}\p{Nd}'-]++[.,;:!?]?(?![^ \n\t])"),
        "distinct": F.size(F.array_distinct(tokens)),
        "lines": F.size(F.split(text, "\n")),
        "ended": count(r"[.!?:\"](?= *+(?:\n|$))"),
    }


def votes(m: dict[str, Column]) -> dict[str, Column]:
    """The rules' votes by name, from the measures."""
    n, words = m["n"], m["words"]
    rate = lambda k, by: m[k] / by
    return {
        "length": _vote(words < 2, words >= 40),
        "symbols": _vote(rate("symbols", words) > 0.25, rate("symbols", words) < 0.05),
        "capitals": _vote((rate("upper", n) > 0.4) & (words >= 3), rate("upper", n) < 0.1),
        "word_length": _vote((n / words < 2.5) | (n / words > 15), (n / words >= 4) & (n / words <= 9)),
        "runs": _vote(rate("repeated", n) > 0.2, (rate("repeated", n) < 0.05) & (words >= 10)),
        "stopwords": _vote((m["stop"] == 0) & (words >= 30), m["stop"] >= 3),
        "bangs": _vote(rate("bangs", words) > 0.2, rate("bangs", words) < 0.05),
        "digits": _vote(rate("digits", n) > 0.3, rate("digits", n) < 0.1),
        "clean_words": _vote(rate("clean", words) < 0.6, rate("clean", words) > 0.8),
        "variety": _vote((rate("distinct", words) < 0.15) & (words >= 20), (rate("distinct", words) > 0.25) & (words >= 10)),
        "endings": _vote((rate("ended", m["lines"]) < 0.1) & (words >= 30), rate("ended", m["lines"]) > 0.7),
    }


NAMES = ("length", "symbols", "capitals", "word_length", "runs", "stopwords", "bangs", "digits", "clean_words", "variety", "endings")


def _voted(docs: DataFrame) -> DataFrame:
    """(row, votes): each row as a struct, and its votes as one."""
    text = F.col("row.text")
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.split(F.lower(docs["text"]), r"[ \n\t]+").alias("tokens"))
    measured = row.select("row", *(v.alias(k) for k, v in measures(text).items()))  # as columns: Catalyst would take a struct apart and compute its fields once for each use
    m = {k: F.col(k) for k in measures(text)}
    return measured.select("row", F.struct(*(F.when(m["n"] > 0, v).otherwise(F.lit(0)).cast("int").alias(k) for k, v in votes(m).items())).alias("votes"))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-10, start: tuple[float, float] = _START, share: float = 0.9) -> tuple[np.ndarray, float]:
    """patterns (m, rules) of votes -1, 0, 1 and how often each occurs; returns P(bad vote | class, a vote) as (2, rules), class 1 being good, and the share of good."""
    bad, good = (patterns == -1).astype(float), (patterns == 1).astype(float)
    first = np.repeat(np.array(start)[:, None], patterns.shape[1], axis=1)
    p, last = first.copy(), -np.inf
    counts = counts.astype(float)
    for _ in range(rounds if counts.sum() else 0):
        logs = np.stack([bad @ np.log(p[c]) + good @ np.log(1 - p[c]) for c in (0, 1)], axis=1) + np.log([1 - share, share])
        top = logs.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        post = np.exp(logs - norm[:, None]) * counts[:, None]
        p = (post.T @ bad + first) / (post.T @ (bad + good) + 1)  # one vote of the start keeps them off 0 and 1
        share = float(np.clip(post[:, 1].sum() / counts.sum(), 1e-3, 1 - 1e-3))
        now = float((norm * counts).sum() / counts.sum())
        if now - last < tolerance:
            break
        last = now
    return p, share


def fit(voted: DataFrame) -> tuple[np.ndarray, float]:
    """voted: a row of votes for each document."""
    rows = voted.groupBy(*NAMES).count().orderBy(*NAMES).collect()  # 3 ** 11 at most
    return expectation_maximisation(np.array([r[:-1] for r in rows], int).reshape(-1, len(NAMES)), np.array([r[-1] for r in rows], np.int64))


def posterior(table: np.ndarray, share: float, said: dict[str, Column]) -> Column:
    """P(good | votes)."""
    odds = F.lit(float(np.log(share / (1 - share))))
    for k, name in enumerate(NAMES):
        bad, good = (float(np.log(x[1, k] / x[0, k])) for x in (table, 1 - table))
        odds = odds + F.when(said[name] == -1, bad).when(said[name] == 1, good).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, each rule's vote, quality, keep) for every row."""
    voted = spill(_voted(docs.select("doc_id", "text")).select("row.doc_id", "votes.*"))
    table, share = fit(voted)
    return voted.withColumn("quality", posterior(table, share, {k: F.col(k) for k in NAMES})).withColumn("keep", F.col("quality") >= KEEP)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules, weighed together, hold for good."""
    voted = spill(_voted(docs))  # a filter pushed below the projection would compute every measure once for each use
    table, share = fit(voted.select("votes.*"))
    good = posterior(table, share, {k: F.col("votes")[k] for k in NAMES}) >= KEEP
    return voted.where(good).select(*(F.col("row")[c].alias(c) for c in docs.columns))
