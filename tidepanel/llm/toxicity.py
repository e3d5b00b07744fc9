"""Toxicity: misspelled terms of a learned lexicon, and windows that part quotation from abuse.

The lexicon holds the words whose document frequency among toxic training rows stands out most against clean ones.
It's kept as a trie and intersected with Levenshtein automata: a state of the product is a set of (trie node, edits),
made when first met, so one pass over a word's characters finds every term within its edits. Each hit gets a window of
words round it, and one of four contexts: plain, between quotation marks, near a word of reporting, or both. A text's hits
are summed, and once more for each context but the plain one; a logistic model learns how far these sums turn abuse into
quotation.

Learned from labels alone: the lexicon, the term weights, the contexts' weights and the model, from rows whose crc32(doc_id) mod 5 isn't 0, a
bounded sample of them (most_labels). Scores take nothing but the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Words that report speech, in the languages of the corpus, and quotation marks.
REPORTS = frozenset("said says called calls quote quoted quotes wrote word words term phrase reported according dit appelle mot mots cite sagte nannte wort zitat zitiert dijo llama palabra cita según".split())
QUOTES = frozenset("\"'«»“”„‚‘’`")


@dataclass(frozen=True)
class Settings:
    most_labels: int = 30_000
    most_terms: int = 400
    least_rows: int = 4
    least_odds: float = 2.5
    window: int = 5
    folds: int = 5


def edits_for(term: str) -> int:
    """Most edits of a misspelled term: short terms must match exactly."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """The trie of the terms with the automata on it; states are made when first met and forgotten in bulk."""

    def __init__(self, terms: list[str], most_states: int = 60_000):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most: list[int] = [0]
        for t, word in enumerate(terms):
            node = 0
            for c in (*word, None):
                self.most[node] = max(self.most[node], edits_for(word))
                if c is None:
                    self.term[node] = t
                    break
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = self.child[node][c]
        self.allowed = [edits_for(w) for w in terms]
        self.most_states = most_states
        self._reset()

    def _reset(self) -> None:
        self.states, self.sets, self.step, self.ends = {}, [], [], []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, pairs: dict[int, int]) -> tuple:
        """Adds what deletions of a term's characters reach; each node with its fewest edits."""
        todo = list(pairs)
        while todo:
            node = todo.pop()
            e = pairs[node] + 1
            for n in self.child[node].values():
                if e <= self.most[n] and e < pairs.get(n, 9):
                    pairs[n] = e
                    todo.append(n)
        return tuple(sorted(pairs.items()))

    def _state(self, pairs: tuple) -> int:
        n = self.states.get(pairs)
        if n is None:
            n = self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.step.append({})
            best = min(((e, self.term[k]) for k, e in pairs if self.term[k] >= 0 and e <= self.allowed[self.term[k]]), default=None)
            self.ends.append(best)
        return n

    def _next(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            if e < self.most[node]:
                out[node] = min(out.get(node, 9), e + 1)  # a character too many
            for x, n in self.child[node].items():
                f = e if x == c else e + 1
                if f <= self.most[n] and f < out.get(n, 9):
                    out[n] = f
        return self._state(self._closed(out)) if out else -1

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term within its edits of the word."""
        if len(self.sets) > self.most_states:
            self._reset()
        state = self.start
        for c in word:
            got = self.step[state].get(c)
            if got is None:
                got = self.step[state][c] = self._next(state, c)
            if got < 0:
                return None
            state = got
        return self.ends[state]


#: A constant; all hits; those between marks, near reporting, both; nearness of reporting; distinct terms, strongest hit, density, doubtful hits.
#: A context's weight is what it adds to that of all hits, so a context that no label tells of counts as any other.
FEATURES = 10


@dataclass(frozen=True)
class Model:
    terms: list[str]
    odds: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    trust: np.ndarray | None = None

    def quotation(self, context: int) -> float:
        """The share of a hit's weight that a context takes away, 0 to 1."""
        of_all = float(self.weights[1])
        return float(np.clip(-self.weights[1 + context] / of_all, 0, 1)) if context and of_all > 0 else 0.0


class Reader:
    """Hits and features of the texts of one task."""

    def __init__(self, model: Model, window: int, most_kept: int = 400_000):
        self.model, self.window = model, window
        self.lexicon = Lexicon(model.terms)
        #: No word of more bytes is within two edits of a term.
        self.longest = 4 * (max(map(len, model.terms), default=0) + 2)
        self.quotation = [model.quotation(c) for c in range(4)]
        self.known: dict[int, tuple | None] = {}
        self.most_kept = most_kept

    def hits(self, data, starts, ends):
        """The word numbers of hits with their edits and terms."""
        keys, first, back = np.unique(shared.span_hashes(shared.LOWER[data], starts, ends), return_index=True, return_inverse=True)
        known, found = self.known, {}
        for k, (key, i) in enumerate(zip(keys.tolist(), first.tolist(), strict=True)):
            got = known.get(key, 0)
            if got == 0:
                size = ends[i] - starts[i]
                got = None
                if size <= self.longest:
                    got = self.lexicon.find(data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").lower())
                if len(known) >= self.most_kept:
                    known.clear()
                known[key] = got
            if got is not None:
                found[k] = got
        if not found:
            return []
        is_hit = np.zeros(len(keys), bool)
        is_hit[list(found)] = True
        return [(w, *found[int(back[w])]) for w in np.flatnonzero(is_hit[back]).tolist()]

    def features(self, column) -> tuple[np.ndarray, list]:
        """One row of FEATURES per text, sums of hits' odds among them; and the hits (word number, term, edits, quotation)."""
        out = np.zeros((len(column), FEATURES))
        distinct: list[set] = [set() for _ in range(len(column))]
        out[:, 0] = 1.0
        said: list[list] = [[] for _ in range(len(column))]
        for lo, _, data, at in shared.text_slices(column):
            low = shared.LOWER[data]
            starts, ends, owner = shared.word_spans(low, at, shared.PLAIN)
            if not len(starts):
                continue
            per_text = np.bincount(owner, minlength=len(at) - 1)
            for w, edits, term in self.hits(data, starts, ends):
                row, odds = lo + int(owner[w]), float(self.model.odds[term])
                context, near = self._context(data, low, at, starts, ends, owner, w)
                if edits:
                    trust = 1.0 if self.model.trust is None else float(self.model.trust[term])
                    out[row, 9] += odds * (1.0 - trust)
                    odds *= trust
                out[row, 1] += odds
                if context:
                    out[row, 1 + context] += odds
                    out[row, 5] += odds * near
                out[row, 7] = max(out[row, 7], odds)
                out[row, 8] += odds / per_text[owner[w]]
                if odds > 1.0:
                    distinct[row].add(term)
                said[row].append((int(w - np.searchsorted(owner, owner[w])), self.model.terms[term], edits, self.quotation[context]))
        out[:, 6] = [np.log1p(len(x)) for x in distinct]
        out[:, [1, 2, 3, 4, 5, 9]] = np.log1p(out[:, [1, 2, 3, 4, 5, 9]])
        out[:, 8] = np.minimum(1.0, out[:, 8])
        return out, said

    def _context(self, data, low, at, starts, ends, owner, w) -> tuple[int, float]:
        """0 to 3 for plain, between marks, near reporting, both; and 1 over the distance to the nearest word of reporting."""
        text = owner[w]
        a, b = max(0, w - self.window), min(len(starts) - 1, w + self.window)
        while owner[a] != text:
            a += 1
        while owner[b] != text:
            b -= 1
        lead = data[max(at[text], starts[w] - 6) : starts[w]].tobytes().decode("utf-8", "ignore")
        tail = data[ends[w] : min(at[text + 1], ends[w] + 6)].tobytes().decode("utf-8", "ignore")
        between = not QUOTES.isdisjoint(lead) and not QUOTES.isdisjoint(tail)
        near = max((1 / abs(k - w) for k in range(a, b + 1) if k != w and low[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") in REPORTS), default=0.0)
        return int(between) + 2 * (near > 0), near


def held_out(folds: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def _frequencies(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many sampled rows of each kind a word occurs; each task sums first."""

    def run(batches):
        total: dict[str, list[int]] = {}

        def sums():
            words = list(total)
            counts = list(total.values())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=["word", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                starts, ends, _ = shared.word_spans(shared.LOWER[data], np.array([0, len(data)]), shared.PLAIN)
                raw = data.tobytes()
                for w in {raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}:
                    total.setdefault(w, [0, 0])[0 if toxic else 1] += 1
            if len(total) > 300_000:
                yield sums()
                total.clear()
        yield sums()

    return sample.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's steps; the constant isn't penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0, *[penalty] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _columns(docs: DataFrame, model: Model, s: Settings, text: str, details: bool):
    kept = docs.drop("score", "predicted", "hits", "features")
    names = kept.columns
    ddl = "score double, predicted int, hits array<struct<word: long, term: string, edits: int, quotation: double>>" if details else "features array<double>"
    schema = shared.widened(kept, ddl)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most most_terms words
    hit = pa.struct([("word", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quotation", pa.float64())])

    def run(batches):
        reader = Reader(shipped.value, s.window)
        for batch in batches:
            x, said = reader.features(batch.column(names.index(text)))
            if details:
                score = 1 / (1 + np.exp(-np.clip(x @ shipped.value.weights, -30, 30)))
                hits = pa.array([[dict(zip(("word", "term", "edits", "quotation"), h, strict=True)) for h in row] for row in said], pa.list_(hit))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), hits], names=[*names, "score", "predicted", "hits"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*names, "features"])

    return kept.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    """Lexicon, term weights and logistic model. labels: doc_id, toxic (0 or 1; null rows don't count)."""
    s = s or Settings()
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(s.folds))
    few = shared.stored(shared.bounded_sample(marked, "doc_id", s.most_labels).withColumnRenamed("doc_id", "marked_id"))
    # at most most_labels rows of 12 bytes, so the join may send it to every executor
    own = docs.select("doc_id", F.col("text"))
    sample = own.join(F.broadcast(few), own.doc_id == few.marked_id).select("text", "toxic")
    n = dict(few.groupBy("toxic").count().collect())
    toxic, clean = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    found = _frequencies(sample).where(F.col("toxic") >= s.least_rows).withColumn("odds", odds).where(F.col("odds") >= s.least_odds)
    rows = found.orderBy(F.desc(F.col("odds") * F.log1p(F.col("toxic"))), "word").limit(s.most_terms).select("word", "odds").collect()
    model = Model([r[0] for r in rows], np.array([r[1] for r in rows], float))
    if not toxic or not clean or not rows:
        return Model(model.terms, model.odds, np.array([-5.0] + [0.0] * (FEATURES - 1)))
    # a term's misspellings count less the more clean rows hold them
    hits = _columns(sample, model, s, "text", details=True).select("toxic", F.explode("hits").alias("h")).where("h.edits > 0")
    near = {r[0]: r[1:] for r in hits.groupBy("h.term").agg(F.sum(F.col("toxic").cast("long")), F.sum(1 - F.col("toxic").cast("long"))).collect()}
    trust = np.array([(near.get(t, (0, 0))[0] + 1.0) / (sum(near.get(t, (0, 0))) + 1.0) for t in model.terms])
    model = Model(model.terms, model.odds, model.weights, trust)
    train = _columns(sample, model, s, "text", details=False).select("features", "toxic").toPandas()  # at most most_labels rows
    return Model(model.terms, model.odds, _logistic(np.array(train.features.tolist()), (train.toxic == 1).to_numpy(float)), trust)


def score(docs: DataFrame, model: Model, s: Settings | None = None, text: str = "text") -> DataFrame:
    """docs plus `score` (0 to 1), `predicted` (score >= 0.5) and `hits` (word number, term, edits, quotation).

    A null or empty text has no hits and the score of a text without hits. Whole texts are read.
    """
    return _columns(docs, model, s or Settings(), text, details=True)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = Settings()
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), s)
    return score(docs, model, s).select("doc_id", F.coalesce(held_out(s.folds), F.lit(False)).alias("held_out"), "score", "predicted")
