"""Toxicity scores: a lexicon trie intersected with Levenshtein automata finds lexicon
terms and their misspellings, the words around a hit tell quotation from abuse, and a
logistic model turns the counts into a score.

The lexicon and the model are learned from a bounded sample of labelled texts; every text
is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import give_back, hashed, kept, ship, trimmed, words
from ledgerfold.session import stored

#: Bounds of the fit: labelled rows, and terms and stems of the lexicon.
SAMPLE, MOST_TERMS = 20_000, 1_000
#: A term must be seen in this many toxic texts, and mostly there.
LEAST_TEXTS, PURITY = 3, 0.75
#: Stems: so many first letters, shared by so many words.
STEM_LENGTHS, STEM_WORDS = range(4, 9), 3
#: Words on either side that are looked at for signs of a quotation.
WINDOW = 8
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Fixed: signs that words are someone else's.
QUOTES = re.compile("[\"“”„«»‹›]")
REPORTING = frozenset(
    "said says saying called calls calling quoted quotes quote wrote writes word words term terms slur insult insults "
    "dit disait appelle mot insulte sagte nannte wort schimpfwort dijo llama palabra insulto".split()
)
#: Words whose match a worker remembers.
MEMO = 50_000


def edits(term: str) -> int:
    """Misspellings allowed: none below five letters, one below nine, then two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """Terms and stems as one trie. A term matches words within ``edits(term)`` insertions,
    deletions and substitutions; a stem matches the words that begin with it.

    The automaton of all terms at once: a state is the set of (trie node, edits so far) that
    the letters read lead to. States and transitions are built when first met and kept, so
    a word costs one lookup per letter, and most words end after two or three.
    """

    terms: tuple[str, ...]
    stems: tuple[str, ...]
    children: list[dict[str, int]] = field(default_factory=list)
    limit: list[int] = field(default_factory=list)
    final: dict[int, str] = field(default_factory=dict)
    states: dict = field(default_factory=dict)

    def __post_init__(self):
        self.children, self.limit = [{}], [0]
        for term in sorted(self.terms):
            node, path = 0, [0]
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                node = self.children[node][letter]
                path.append(node)
            self.final[node] = term
            for n in path:  # the most edits of any term below
                self.limit[n] = max(self.limit[n], edits(term))
        self.letters = {c for kids in self.children for c in kids}
        self.stem_of = frozenset(self.stems)
        self.steps = {}
        self.start = self._closed({0: 0})
        self.memo: dict[str, tuple[int, str] | None] = {}

    def _closed(self, reached: dict[int, int]) -> frozenset:
        """With all deletions: letters of a term that the word leaves out."""
        todo = list(reached.items())
        while todo:
            node, done = todo.pop()
            if reached.get(node, 99) < done:
                continue
            for kid in self.children[node].values():
                if done + 1 <= self.limit[kid] and reached.get(kid, 99) > done + 1:
                    reached[kid] = done + 1
                    todo.append((kid, done + 1))
        return frozenset(reached.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        reached: dict[int, int] = {}

        def reach(node: int, done: int) -> None:
            if done <= self.limit[node] and reached.get(node, 99) > done:
                reached[node] = done

        for node, done in state:
            reach(node, done + 1)  # the word has a letter more
            for own, kid in self.children[node].items():
                reach(kid, done + (own != letter))
        return self._closed(reached)

    def match(self, word: str) -> tuple[int, str] | None:
        """(kind, term): kind is the number of edits, or 3 for a stem."""
        if word in self.memo:
            return self.memo[word]
        found, state = None, self.start
        for letter in word:
            step = (state, letter if letter in self.letters else "")
            state = self.steps.get(step)
            if state is None:
                if len(self.steps) >= MEMO:
                    self.steps.clear()
                state = self.steps[step] = self._step(*step)
            if not state:
                break
        for node, done in state:
            if node in self.final and done <= edits(self.final[node]):
                found = min(found or (9, ""), (done, self.final[node]))
        if found is None or found[0]:
            stem = next((word[:n] for n in STEM_LENGTHS if word[:n] in self.stem_of), None)
            found = (3, stem) if stem else found
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found
        return found


#: exact, one edit, two edits, stem; each outside and inside quotations; share of words.
N_FEATURES = 9


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """Hits by kind, apart for abuse and quotation, and the hits' share of all words. The
    context of a hit is ``WINDOW`` words on each side: an odd number of quotation marks
    before and any after it, or a reporting word there, makes it a quotation."""
    counts = [0.0] * N_FEATURES
    lower = (text or "").lower()
    found = WORD.findall(lower)
    memo = lexicon.memo
    kinds = {w: m for w in set(found) if (m := memo[w] if w in memo else lexicon.match(w))}
    if not kinds:
        return counts
    spans = [m.span() for m in WORD.finditer(lower)]
    for i, word in enumerate(found):
        if word in kinds:
            first, last = max(0, i - WINDOW), min(len(found), i + WINDOW + 1)
            before, after = lower[spans[first][0]:spans[i][0]], lower[spans[i][1]:spans[last - 1][1] + 1]
            quoted = (len(QUOTES.findall(before)) % 2 and QUOTES.search(after)) or not REPORTING.isdisjoint(found[first:i])
            counts[kinds[word][0] + 4 * bool(quoted)] += 1
    share = sum(counts) / len(found)
    return [math.log1p(c) for c in counts[:8]] + [math.log1p(100 * share)]


@dataclass
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        rows = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, N_FEATURES)
        return (1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights) + self.bias, -30, 30)))).tolist()


def _terms(sample: DataFrame) -> Lexicon:
    """Words and stems of the sample that stand in toxic texts far more often than chance
    would have it. Texts of one ``key`` and label count as one, so a word that only the
    copies of one toxic text hold is no term. With ``n`` words tested, a term that is as common elsewhere passes with
    a probability below 0.05 in all."""
    groups = sample.select("key", "toxic").distinct()
    totals = groups.agg(F.count("*"), F.sum("toxic")).first()
    share = (totals[1] or 0) / max(1, totals[0])
    if not 0 < share < 1:
        return Lexicon((), ())
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]{3,40})"), F.lit(1)))
    held = sample.select("key", "toxic", F.explode(found).alias("word")).distinct()
    counts = held.groupBy("word").agg(F.sum("toxic").alias("hits"), F.count("*").alias("texts"))
    counts = stored(counts, "word-counts")
    tested = counts.where(F.col("texts") >= LEAST_TEXTS).count()

    def telling(rows: DataFrame) -> DataFrame:
        p = F.col("hits") / F.col("texts")
        # Twice the log-likelihood ratio against the base rate; exp(-half of it) bounds the chance.
        gain = 2 * (F.col("hits") * F.log(p / share) + F.when(p < 1, (F.col("texts") - F.col("hits")) * F.log((1 - p) / (1 - share))).otherwise(0))
        least = 2 * math.log(max(2, tested) / 0.05)
        return rows.where((F.col("hits") >= LEAST_TEXTS) & (p >= PURITY) & (gain >= least)).withColumn("gain", gain)

    terms = [r["word"] for r in telling(counts).orderBy(F.desc("gain"), "word").limit(MOST_TERMS).collect()]
    heads = counts.select("word", "hits", "texts", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS])).alias("stem")).where("stem IS NOT NULL")
    heads = heads.groupBy("stem").agg(F.sum("hits").alias("hits"), F.sum("texts").alias("texts"), F.count("*").alias("words"))
    # A text may hold several words of a stem, so stems need as many words as well.
    found = telling(heads.where(F.col("words") >= STEM_WORDS)).orderBy(F.desc("gain"), "stem").limit(MOST_TERMS).collect()
    seen = {r["stem"]: (r["hits"], r["texts"]) for r in found}
    stems: list[str] = []
    for stem in sorted(seen, key=lambda s: (len(s), s)):
        if not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    # A stem grows by letters that cost it no text.
    stems = [max((s for s in seen if s.startswith(stem) and seen[s] == seen[stem]), key=len) for stem in stems]
    return Lexicon(tuple(t for t in terms if not any(t.startswith(s) for s in stems)), tuple(stems))


def _fit(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, with a ridge toward weights that count every
    kind of hit as toxic, quotations less; kinds that the sample lacks keep those."""
    prior = np.array([3.0, 1.5, 1.0, 3.0, 0.5, 0.25, 0.25, 0.5, 1.0, -2.0])
    x = np.hstack([rows, np.ones((len(rows), 1))])
    w, ridge = prior.copy(), np.array([0.5] * N_FEATURES + [0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + ridge * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the labelled texts whose ``crc32(doc_id) mod 5`` is not 0: of these the
    ``sample`` rows with the smallest hash of their id, equal texts once, toxic if any of
    their rows is. Without rows of both labels the model has no terms and scores
    everything alike."""
    ship(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` pairs of numbers: a bounded broadcast, so texts are not shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = stored(rows.where("text IS NOT NULL").select("text", "toxic"), "labelled")
    # Texts that share their smallest five-word hash are near copies for the choice of terms.
    five = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, 5))))
    rows = rows.withColumn("w", hashed(words(F.col("text")))).withColumn("key", F.coalesce(F.array_min(five), F.xxhash64("w")))
    rows = stored(rows.groupBy("text").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic")), "labelled")
    lexicon = _terms(rows)

    @arrow_udf("array<double>")
    @trimmed
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([features(t, lexicon) for t in texts.to_pylist()], pa.list_(pa.float64()))

    seen = rows.select(counted("text").alias("x"), F.col("toxic").cast("double")).toArrow()  # at most ``sample`` short rows
    if not seen.num_rows:
        return Model(lexicon, tuple([0.0] * N_FEATURES), -2.0)
    x = seen["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    weights, bias = _fit(x, seen["toxic"].to_numpy())
    give_back()
    return Model(lexicon, tuple(weights.tolist()), bias)


def scorer(model: Model):
    """The score of a text column, 0 to 1; null and empty texts have no hits."""
    terms, stems, weights, bias = model.lexicon.terms, model.lexicon.stems, model.weights, model.bias

    @arrow_udf("double")
    @trimmed
    def score(texts: pa.Array) -> pa.Array:
        own = _model(terms, stems, weights, bias)
        return pa.array([s for start in range(0, len(texts), 256) for s in own.scores(texts.slice(start, 256).to_pylist())], pa.float64())

    return score


def _model(terms, stems, weights, bias) -> Model:
    """Built once per worker process, with the automaton's states and the words seen."""
    models, key = kept(__name__), (terms, stems, weights, bias)
    if key not in models:
        models.clear()
        models[key] = Model(Lexicon(terms, stems), weights, bias)
    return models[key]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score and predicted (score >= 0.5).

    Null and empty texts are scored as texts without a hit; a null doc_id counts as an
    empty text for ``held_out``. Repeated rows are scored alike. Labels that are null, or
    of no document, teach nothing; of several labels of one document the highest counts.
    Only the text reaches the score.
    """
    score = scorer(learn(docs, labels))
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not scored as toxic, all columns kept."""
    score = scorer(learn(docs, labels))
    return docs.where(score(F.col("text")) < 0.5)
