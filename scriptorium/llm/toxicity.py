"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms
to Latin, and reads digits and signs inside words as the letters they stand for;
accents stay, since they tell words apart. Lexicon terms are whole words or word
beginnings with a log-odds weight learned from labelled rows. Hits inside an
exception phrase do not count. The score is a logistic function of the summed
weight and of that weight per word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i"}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
# Phrases in which an otherwise toxic word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "class clown", "loser pays")


class _Fold(dict):
    """str.translate table that fills itself: letters and digits stay (folded), the rest becomes a space."""

    def __missing__(self, code: int) -> str:
        c = unicodedata.normalize("NFKC", chr(code)).lower() if code >= 0xFF00 else chr(code)
        value = self[code] = c if len(c) == 1 and c.isalnum() else " "
        return value


_FOLD = _Fold({ord(a): b for a, b in LOOK_ALIKES.items()})
_FOLD.update({code: "" for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xAD, 0xFEFF)})
_LETTER_OF = SUBSTITUTES
_SIGNED = re.compile(r"(?<=[^\W\d_])[@$!](?=\w)|(?<!\w)[@$](?=[^\W\d_])")
_DIGIT = re.compile(r"\d")
_MIXED = re.compile(r"\b(?=\w*[^\W\d_])(?=\w*\d)\w+\b")


def fold(text: str) -> str:
    """Folded text with one space before and after it; words are runs between spaces."""
    low = text.lower()
    if "@" in low or "$" in low or "!" in low:
        low = _SIGNED.sub(lambda m: _LETTER_OF[m[0]], low)
    if _DIGIT.search(low):
        low = _MIXED.sub(lambda m: "".join(_LETTER_OF.get(c, c) for c in m[0]), low)
    return f" {low.translate(_FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """terms: (pattern, weight), a pattern being ' word ' or ' beginning'; coef: intercept, total, density."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: tuple[float, float, float] = (-4.0, 4.0, 1.0)


_AUTOMATA: dict[int, tuple] = {}


def _automaton(lexicon: Lexicon):
    key = hash((lexicon.terms, lexicon.exceptions))
    if key not in _AUTOMATA:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern, weight in lexicon.terms:
            automaton.add_word(pattern, (len(pattern), weight, False))
        for phrase in lexicon.exceptions:
            automaton.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
        automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = automaton
    return _AUTOMATA[key]


def matched(text: str, lexicon: Lexicon) -> tuple[float, int, int]:
    """(summed weight, hits, words) of a text; at one word start only its heaviest term counts."""
    folded = fold(text)
    words = len(folded.split())
    if not lexicon.terms:
        return 0.0, 0, words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight, exception) in _automaton(lexicon).iter(folded):
        start = end - length + 1
        if exception:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    kept = [w for at, w in best.items() if not any(a <= at < b for a, b in excused)] if excused else best.values()
    return float(sum(kept)), len(kept), words


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / (words + 20))], 1)


def _candidates(folded: str) -> set[str]:
    """Whole words and word beginnings of 3 to 10 letters."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(3, min(len(word), 10) + 1))
    return out


def learn_lexicon(sample: DataFrame, min_support: int = 4, min_log_odds: float = 2.5, min_evidence: float = 20.0, max_terms: int = 5000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon from (doc_id, text, y): terms far likelier in y = 1, and the logistic coefficients.

    Documents are counted in tasks and summed by term; only terms that pass the
    thresholds of support, log-odds and evidence (the log-likelihood ratio of the
    term's share of y = 1 against the sample's) reach the driver: the 20 * `max_terms` of
    most support, of which the `max_terms` of greatest weight stay. Of a word
    beginning and a longer term with nearly the same documents the longer stays.
    Without both labels the lexicon has no terms and scores all texts alike.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            terms = list(by[1].keys() | by[0].keys())
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([by[1][t] for t in some], pa.int64()), pa.array([by[0][t] for t in some], pa.int64())], names=["term", "pos", "neg"])
            for counts in by:
                counts.clear()

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                by[y].update(_candidates(fold(text.as_py() or "")))
                if len(by[0]) + len(by[1]) > 200_000:  # counts of one term are summed after the shuffle
                    yield from flush()
        yield from flush()

    n = {int(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return Lexicon((), exceptions, (math.log((n_pos + 0.5) / (n_neg + 0.5)), 0.0, 0.0))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    both, share = F.col("pos") + F.col("neg"), n_pos / (n_pos + n_neg)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(F.lit(0.0))
    evidence = 2 * (part(F.col("pos"), share) + part(F.col("neg"), 1 - share))
    rows = sample.select("text", "y").mapInArrow(counted, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= min_support).withColumn("odds", odds).filter((F.col("odds") >= min_log_odds) & (evidence >= min_evidence)).orderBy(F.desc("pos"), F.desc("odds"), "term").limit(20 * max_terms).collect()
    found = {r["term"]: (r["pos"], r["neg"], r["odds"]) for r in rows}
    closed = dict(found)
    for term, (pos, neg, _) in found.items():
        # A longer term that keeps the documents of its beginning replaces it.
        for shorter in {term.rstrip(" ")[:k] for k in range(4, len(term))} - {term}:
            if shorter in closed and pos >= 0.9 * found[shorter][0] and neg <= found[shorter][1]:
                del closed[shorter]
    kept, starts = [], set()
    for term, (_, _, weight) in sorted(closed.items(), key=lambda x: (len(x[0].rstrip(" ")), x[0])):
        if not any(term[:k] in starts for k in range(4, len(term))):
            kept.append((term, float(weight)))
            if not term.endswith(" "):
                starts.add(term)
    kept = sorted(kept, key=lambda x: (-x[1], x[0]))[:max_terms]
    lexicon = Lexicon(tuple(kept), exceptions)

    seen = np.array([tuple(r) for r in sample.select("y", "text").mapInArrow(_weighing(lexicon), "y int, total double, words long").collect()], float)
    coef = _logistic(_features(seen[:, 1], seen[:, 2]), seen[:, 0])
    return Lexicon(lexicon.terms, exceptions, tuple(coef))


def _weighing(lexicon: Lexicon):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matched(t.as_py() or "", lexicon) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64())], names=["y", "total", "words"])

    return weighed


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score (0 to 1), hits, weight, n_words of every text.

    Null and empty texts have no words and get the score of a text without hits; a
    null doc_id and repeated rows are kept; an empty table gives no rows. Only doc_id
    and text are read. Long texts are matched whole in one pass.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("hits", pa.int64()), ("weight", pa.float64()), ("n_words", pa.int64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef = np.array(lexicon.coef)
        for batch in batches:
            found = [matched(t.as_py() or "", lexicon) for t in batch.column("text")]
            total, words = np.array([x[0] for x in found], float), np.array([x[2] for x in found], float)
            score = 1 / (1 + np.exp(-np.clip(_features(total, words) @ coef, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array([x[1] for x in found], pa.int64()), pa.array(total), pa.array([x[2] for x in found], pa.int64())], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double, hits long, weight double, n_words long")


def fit_and_score(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, fold_by: int = 5) -> DataFrame:
    """`score_toxicity` with a lexicon learned from at most `max_rows` rows of `labels` outside the held-out fold."""
    train = _spark.crc32_remainder(F.col("doc_id"), fold_by) != 0
    return score_toxicity(docs, learn_lexicon(_spark.labelled_sample(docs, labels, "toxic", train, max_rows)))


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, whose text scores below `threshold`; rows pass through one scan, unshuffled.

    Each row goes by its own text, whatever its id; null and empty texts score as texts
    without hits; repeated rows all stay or all go; an empty table gives no rows.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef = np.array(lexicon.coef)
        for batch in batches:
            found = [matched(t.as_py() or "", lexicon) for t in batch.column("text")]
            x = _features(np.array([f[0] for f in found], float), np.array([f[2] for f in found], float)) @ coef
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def learned_without_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, fold_by: int = 5) -> DataFrame:
    """`without_toxic` with a lexicon learned as in `fit_and_score`."""
    train = _spark.crc32_remainder(F.col("doc_id"), fold_by) != 0
    return without_toxic(docs, learn_lexicon(_spark.labelled_sample(docs, labels, "toxic", train, max_rows)))
