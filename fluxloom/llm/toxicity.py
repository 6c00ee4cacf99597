"""Toxicity by Levenshtein automata over a lexicon trie and context-window scores.

The lexicon is learned: words that are frequent in toxic and rare in other labelled texts.
It becomes a trie; a Levenshtein automaton runs against all of it at once, state by state,
so a word is held against every term within the edits its length allows (one from MIN_FUZZY
letters, two from LONG) in a few steps. Words that are known from clean labelled texts don't
count as misspellings, and a term with many such words near it is weak as a misspelling. Each
hit counts by the strength of its term and by its window: quoted or reported hits, hits near
the second person or another hit, and others are summed apart. A logistic model weighs these
sums. It is also shown each toxic text of the sample as if its exact hits were misspelled, as
misspellings are rarer there than where they are meant to hide.

Lexicon and weights are fitted on the labelled rows whose crc32(id as text) mod `folds` is
not 0, at most about SAMPLE of them (chosen by hash), one of each group of near copies, as
copies of one text would pass for evidence from many; every text is scored. Everything else
that is learned is as large as this sample makes it.

Defined results: null and empty texts have no hit and get the score of a text without any;
several labels of one id count as the highest; a label of a repeated id counts for each of its
texts; without any label all scores are 0; repeated rows each get a row; an empty table gives an
empty result; other columns pass through, and one named like the output is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, materialize, restored, small_batches
from .token_counts import Memo

#: Labelled rows to learn from, about so many at most; nothing else bounds the lexicon.
SAMPLE = 20_000
#: States of the automaton that are kept before it begins anew.
STATES = 50_000
#: A term's least toxic documents, and its least share of them.
SUPPORT, PRECISION = 3, 0.7
MIN_FUZZY, LONG, WINDOW = 5, 9, 6
WORD = re.compile(r"[^\W_]+")
#: Marks and words that report somebody's speech, and words that address someone.
MARKS = re.compile("[\"“”„«»]")
REPORTING = frozenset("said says quote quoted quotes wrote called cited reported term word dijo cita palabra dit cite mot sagte zitat wort".split())
ADDRESSING = frozenset("you your u yourself tu vous toi te ton eres usted du dich dein ihr".split())
FEATURES = 7


class LexiconAutomaton:
    """The trie of the terms under the Levenshtein automata of all words, determinised as met.

    A state is a set of (trie node, edits made); a step by a letter matches it, replaces it,
    drops it, or inserts a letter of the trie."""

    def __init__(self, terms: dict[str, tuple[float, float]]):
        self.children, self.term = [{}], [None]
        for t in sorted(terms):
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t
        self.terms = terms
        self._begin()

    def _begin(self) -> None:
        """Forget all states but the first ones."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.starts = [self._number(self._state({(0, 0)}, k)) for k in (0, 1, 2)]

    def _number(self, state: tuple) -> int:
        """A state's number, -1 if nothing can follow."""
        if len(state) == 1:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            found = [(edits, -self.terms[t][0], t) for node, edits in state[1:] if (t := self.term[node]) and edits <= (len(t) >= MIN_FUZZY) + (len(t) >= LONG)]
            self.ends.append((min(found)[0], min(found)[2]) if found else None)
        return self.numbers[state]

    def _state(self, places: set[tuple[int, int]], most: int) -> tuple:
        best: dict[int, int] = {}
        todo = list(places)
        while todo:
            node, edits = todo.pop()
            if edits <= most and edits < best.get(node, 9):
                best[node] = edits
                todo += [(c, edits + 1) for c in self.children[node].values()]
        return (most, *sorted(best.items()))

    def _step(self, state: tuple, letter: str) -> tuple:
        most, places = state[0], set()
        for node, edits in state[1:]:
            children = self.children[node]
            if letter in children:
                places.add((children[letter], edits))
            if edits < most:
                places.add((node, edits + 1))
                places.update((c, edits + 1) for c in children.values())
        return self._state(places, most)

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term, the strongest of equals, or None."""
        if word in self.terms:
            return 0, word
        if len(word) < MIN_FUZZY - 1:
            return None
        if len(self.states) > STATES:
            self._begin()
        state = self.starts[2 if len(word) >= LONG else 1]
        for letter in word:
            step = self.steps[state].get(letter)
            if step is None:
                step = self.steps[state][letter] = self._number(self._step(self.states[state], letter))
            if step < 0:
                return None
            state = step
        return self.ends[state]


class Scorer:
    """terms: term -> its strength, and that of words near it."""

    def __init__(self, terms: dict[str, tuple[float, float]], known: frozenset[str] = frozenset()):
        self.automaton, self.terms, self.known = LexiconAutomaton(terms), terms, known
        self.memo = Memo(lambda words: [self._hit(w) for w in words])

    def _hit(self, word: str) -> tuple[int, float] | bool:
        """(edits, strength); False for none, as the memo keeps no None."""
        hit = None if word in self.known else self.automaton.find(word)
        strength = self.terms[hit[1]][hit[0] > 0] if hit else 0
        return (hit[0], strength) if strength > 0 else False

    def features(self, text: str | None) -> list[float]:
        """Sums of strengths: exact, misspelled, quoted, addressed or near another hit, the most,
        the number of hits by size of the text, and the number of different terms."""
        out = [0.0] * FEATURES
        if not text:
            return out
        low = text.lower()
        words = WORD.findall(low)
        self.memo.learn(words)
        hits = [self.memo[w] for w in words]
        if not any(hits):
            return out
        where = [k for k, h in enumerate(hits) if h]
        spans = [m.span() for m in WORD.finditer(low)]
        for k in where:
            edits, strength = hits[k]
            a, b = max(0, k - WINDOW), min(len(words), k + WINDOW + 1)
            near = words[a:b]
            before, after = low[spans[a][0] : spans[k][0]], low[spans[k][1] : spans[b - 1][1] + 1]
            if (MARKS.search(before) and MARKS.search(after)) or not REPORTING.isdisjoint(near):
                out[2] += strength
                continue
            out[1 if edits else 0] += strength * (1.0, 0.7, 0.5)[edits]
            if any(hits[j] for j in range(a, b) if j != k) or not ADDRESSING.isdisjoint(near):
                out[3] += strength
            out[4] = max(out[4], strength * (1.0, 0.7, 0.5)[edits])
        out[5] = 100.0 * len(where) / (len(words) + 20)
        out[6] = float(len({words[k] for k in where}))
        return [math.log1p(x) for x in out]


_SCORERS: dict[int, tuple] = {}


def scorer(model: tuple[dict, frozenset]) -> Scorer:
    """One scorer in each worker process for a model that was sent to it."""
    if id(model) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[id(model)] = model, Scorer(*model)
    return _SCORERS[id(model)][1]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model, the constant last, by Newton steps with a ridge. Features
    are evidence: one that would get a negative weight is left out."""
    w = _newton(np.c_[x, np.ones(len(x))], y, ridge, rounds)
    while (w[:-1] < 0).any():
        x = x * (w[:-1] > 0)
        w = _newton(np.c_[x, np.ones(len(x))], y, ridge, rounds)
        w[:-1][~x.any(axis=0)] = 0
    return w


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    pull = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, sample: int = SAMPLE) -> tuple[dict, frozenset, np.ndarray]:
    """Lexicon, known clean look-alikes, and weights."""
    spark = docs.sparkSession
    small_batches(spark)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != 0
    labels = labels.where(learn & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("label")).agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if not n:
        return {}, frozenset(), np.r_[np.zeros(FEATURES), -30.0]
    share = int(min(1.0, sample / n) * (1 << 30))
    chosen = labels.where(F.pmod(F.xxhash64("label"), F.lit(1 << 30)) <= share)  # about `sample` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label"))
    texts = materialize(texts.select(F.xxhash64("id", "text").alias("id"), "text", "toxic").dropDuplicates(["id"]))
    rows = texts.count()
    if rows > 2 * sample:  # ids with many texts
        texts = texts.where(F.pmod(F.xxhash64("id", F.lit("row")), F.lit(1 << 30)) <= int(sample / rows * (1 << 30)))
    texts = different(texts)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                own = set(WORD.findall((t or "").lower()))
                seen.update(own)
                if y:
                    toxic.update(own)
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values()), "t": [toxic[w] for w in seen]}, schema=pa.schema([("word", pa.string()), ("n", pa.int64()), ("t", pa.int64())]))

    known = materialize(texts.mapInArrow(words, "word string, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")))
    strong = known.where((F.col("t") >= SUPPORT) & (F.col("t") >= PRECISION * F.col("n")) & (F.length("word") >= 3))
    rows = strong.orderBy(F.desc("t"), "word").collect()  # words of the sample
    shipped = spark.sparkContext.broadcast({r["word"]: (0.0, 0.0) for r in rows})

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(shipped.value)
        for batch in batches:
            hits = [(w, n, hit[1]) for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True) if w not in shipped.value and (hit := automaton.find(w))]
            words, numbers, terms = zip(*hits, strict=True) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64()), pa.array(terms, pa.string())], names=["word", "n", "term"])

    clean = known.where(F.col("t") < 0.5 * F.col("n")).select("word", (F.col("n") - F.col("t")).alias("n"))
    near = materialize(clean.mapInArrow(alike, "word string, n long, term string"))
    lookalikes = frozenset(r["word"] for r in near.where("n > 1").select("word").collect())  # words of the sample
    misled = {r["term"]: r["n"] for r in near.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    share = texts.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    # Two imagined texts with the labels' own share keep rare terms weak.
    odds = lambda t, n: math.log((t + 2 * share) / (n + 2 * (1 - share) + 1e-9))
    terms = {r["word"]: (max(0.0, odds(r["t"], r["n"] - r["t"])), max(0.0, odds(r["t"], misled.get(r["word"], 0)))) for r in rows}
    found = with_features(texts, terms, lookalikes).select("_features", "toxic").toPandas()  # about `sample` rows
    x, y = np.array(found["_features"].tolist()).reshape(-1, FEATURES), found["toxic"].to_numpy(float)
    bent = x[(y > 0) & (x[:, 0] > 0)]
    bent[:, 1] = np.log1p(np.expm1(bent[:, 1]) + 0.7 * np.expm1(bent[:, 0]))
    bent[:, 0], bent[:, 4] = 0, np.log1p(0.7 * np.expm1(bent[:, 4]))
    return terms, lookalikes, logistic(np.r_[x, bent], np.r_[y, np.ones(len(bent))])


MINHASHES = 4


def different(texts: DataFrame) -> DataFrame:
    """One text of each group that shares a minhash of its word triples, of a bounded table with
    a column id; texts of fewer words share theirs if all words agree."""
    names = [f"m{k}" for k in range(MINHASHES)]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.zeros((batch.num_rows, MINHASHES), np.int64)
            for k, t in enumerate(batch["text"].to_pylist()):
                words = WORD.findall((t or "").lower())
                triples = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
                h = np.array([zlib.crc32(" ".join(x).encode()) for x in triples], np.uint64)
                for j in range(MINHASHES):
                    x = (h + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    least[k, j] = (x ^ (x >> np.uint64(29))).min().astype(np.int64)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], **{n: least[:, j] for j, n in enumerate(names)}})

    rows = texts.mapInArrow(hashes, "id long, " + ", ".join(f"{n} long" for n in names)).toPandas()
    seen, kept = [set() for _ in names], []
    for r in rows.sort_values("id").itertuples(index=False):
        if not any(h in s for h, s in zip(r[1:], seen, strict=True)):
            kept.append((int(r[0]),))
        for h, s in zip(r[1:], seen, strict=True):
            s.add(h)
    chosen = texts.sparkSession.createDataFrame(kept, "id long")
    return materialize(texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]))


def with_features(docs: DataFrame, terms: dict, known: frozenset, text: str = "text") -> DataFrame:
    """Add _features to a table of which no other column has that name."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((terms, known))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = scorer(shipped.value)
        for texts in batches:
            yield pd.Series([own.features(t) for t in texts])

    return docs.withColumn("_features", features(F.col(text)))


def score(docs: DataFrame, model: tuple[dict, frozenset, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is toxic."""
    docs, names = guarded(docs)
    terms, known, weights = model
    x = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1].tolist()):
        x = x + F.col("_features")[k] * F.lit(w)
    scored = with_features(docs, terms, known, names[text]).withColumn("_score", 1 / (1 + F.exp(-x)))
    return restored(scored, names, **{out: "_score"})
