"""LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are the words between white space (A-Z in lower case) and one end per text. Each token has a class: the most
frequent words one each, the others by their last bytes, the end its own. The model predicts the next class from the
two before: the context vector is C1 r(a) + C2 r(b), a class scores context . q(c) + bias(c), and a softmax over all
classes, taken as one matrix product for all contexts, gives normalised probabilities. Within a class a word has the
share of its count: (c + 1) / (N_class + V_class + 1), the 1 for words never seen.

The corpus gives two tables that Spark sums: the count of every distinct token, and the count of every class triple.
Training runs where the triples lie: in each round every task does noise-contrastive steps on its share from the common
parameters, and Spark averages what the tasks send. Only tables of fixed size reach the driver: the parameters, the
class sums, and the most_head most frequent words, whose counts tasks look up; all other words are joined by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .quality import kth_largest


@dataclass(frozen=True)
class Settings:
    classes: int = 128
    own_class: int = 95
    most_head: int = 100_000
    width: int = 20
    noise: int = 48
    batch: int = 1024
    steps: int = 250
    #: Parts of the triples that are trained on side by side in a round; fixed, so scores don't depend on the cluster.
    shards: int = 8
    rounds: int = 4
    rate: float = 0.08
    seed: int = 5

    @property
    def suffixes(self) -> int:
        return self.classes - 1 - self.own_class


#: The hash of the end token; span_hashes gives it to no word but by a collision of 64 bits.
END = np.uint64(0x0123456789ABCDEF)


def _tokens(data: np.ndarray, at: np.ndarray, s: Settings):
    """Hashes of a slice's tokens, ends included, the text of each, and the suffix class of each (END: -1)."""
    low = shared.LOWER[data]
    starts, ends, owner = shared.word_spans(low, at, shared.SPACED)
    words = shared.span_hashes(low, starts, ends)
    last = low[ends - 1].astype(np.uint32)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    suffix = ((last * np.uint32(257) + before) * np.uint32(2654435761) >> np.uint32(12)) % np.uint32(s.suffixes)
    texts = np.arange(len(at) - 1)
    where = np.concatenate([owner, texts])
    order = np.argsort(where, kind="stable")  # words in their order, then the end
    return np.concatenate([words, np.full(len(texts), END)])[order], where[order], np.concatenate([suffix.astype(np.int16), np.full(len(texts), -1, np.int16)])[order]


class _Sums:
    """Sums of counts by key within a task; gives its rows whenever it holds many."""

    def __init__(self, most: int = 3_000_000):
        self.parts, self.held, self.most = [], 0, most

    def add(self, keys: np.ndarray) -> bool:
        found, n = np.unique(keys, return_counts=True)
        self.parts.append((found, n))
        self.held += len(found)
        return self.held > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([p[0] for p in self.parts])
        n = np.concatenate([p[1] for p in self.parts])
        self.parts, self.held = [], 0
        found, back = np.unique(keys, return_inverse=True)
        return found, np.bincount(back, n, len(found)).astype(np.int64)


def token_counts(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """(token, suffix, n) of every distinct token of docs, ends included."""

    def run(batches):
        sums = _Sums()

        def rows():
            keys, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array((keys & ~np.uint64(63)).view(np.int64)), pa.array((keys & np.uint64(63)).astype(np.int32)), pa.array(n)], names=["token", "suffix", "n"])

        for batch in batches:
            for _, _, data, at in shared.text_slices(batch.column(0)):
                words, _, suffix = _tokens(data, at, s)
                # the token's low bits make room for its suffix class, so that one key holds both
                if sums.add((words & ~np.uint64(63)) | (suffix.astype(np.int64) & 63).view(np.uint64)):
                    yield rows()
        yield rows()

    return docs.select(text).mapInArrow(run, "token long, suffix int, n long").groupBy("token").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words: sorted hashes with counts and classes; sums of the suffix classes; N and V."""

    tokens: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    sums: np.ndarray
    kinds: np.ndarray
    total: int
    distinct: int

    def look_up(self, words: np.ndarray, suffix: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0 where the word isn't in the head) and classes."""
        keys = (words & ~np.uint64(63)).view(np.int64)
        if not len(self.tokens):
            return np.zeros(len(keys), np.int64), np.where(suffix < 0, 0, 1 + s.own_class + suffix).astype(np.int64)
        at = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
        found = self.tokens[at] == keys
        own = np.where(found, self.classes[at], -1)
        own = np.where(suffix < 0, 0, own)
        return np.where(found, self.counts[at], 0), np.where(own >= 0, own, 1 + s.own_class + suffix).astype(np.int64)


def _most(counts: DataFrame, most: int, distinct: int) -> DataFrame:
    """The `most` rows of the largest n. Rows under the smallest n that counts, and most of those with it, go before tasks send any."""
    if distinct > most:
        least = kth_largest(counts.select(F.col("n").cast("double").alias("n")), "n", most)
        above, ties = counts.agg(F.count_if(F.col("n") > least), F.count_if(F.col("n") == least)).first()
        place = F.pmod(F.xxhash64("token"), F.lit(1 << 40))
        counts = counts.where((F.col("n") > least) | (F.col("n") == least) & (place < int((1 << 40) * min(1.0, (2 * (most - above) + 1000) / ties))))
    return counts.orderBy(F.desc("n"), "token").limit(most)


def _head(counts: DataFrame, s: Settings) -> Head:
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = _most(counts, s.most_head, distinct or 0).toPandas()  # at most most_head rows
    end = int((END & ~np.uint64(63)).view(np.int64))
    classes = np.full(len(top), -1)
    words = np.flatnonzero(top.token.to_numpy() != end)[: s.own_class]
    classes[words] = 1 + np.arange(len(words))
    sums, kinds = np.zeros(s.classes), np.zeros(s.classes)
    for k, n, v in counts.where(F.col("token") != end).groupBy("suffix").agg(F.sum("n"), F.count("*")).collect():
        sums[1 + s.own_class + k], kinds[1 + s.own_class + k] = n, v
    for i in words:
        k = 1 + s.own_class + int(top.suffix.iloc[i])
        sums[k] -= top.n.iloc[i]
        kinds[k] -= 1
    order = np.argsort(top.token.to_numpy())
    return Head(top.token.to_numpy()[order], top.n.to_numpy()[order], classes[order], sums, kinds, int(total or 0), int(distinct or 0))


def _codes(classes: np.ndarray, owner: np.ndarray, s: Settings) -> np.ndarray:
    """The triple of each token: the two classes before it in its text (0 before the first), and its own."""
    before, second = np.zeros_like(classes), np.zeros_like(classes)
    before[1:] = np.where(owner[1:] == owner[:-1], classes[:-1], 0)
    second[2:] = np.where(owner[2:] == owner[:-2], classes[:-2], 0)
    return (second * s.classes + before) * s.classes + classes


def triple_counts(docs: DataFrame, head, s: Settings, text: str = "text") -> DataFrame:
    """(code, n) of every class triple of docs; at most classes ** 3 rows, whatever the input's size."""

    def run(batches):
        total = np.zeros(s.classes**3, np.int32)
        for batch in batches:
            for _, _, data, at in shared.text_slices(batch.column(0)):
                words, owner, suffix = _tokens(data, at, s)
                _, classes = head.value.look_up(words, suffix, s)
                codes, n = np.unique(_codes(classes, owner, s), return_counts=True)
                total[codes] += n.astype(np.int32)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], names=["code", "n"])

    return docs.select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Bilinear:
    """The model's parameters in one vector, and what is computed from them."""

    def __init__(self, s: Settings, flat: np.ndarray | None = None):
        self.s, v, d = s, s.classes, s.width
        sizes = (v * d, v * d, d * d, d * d, v)
        self.flat = np.zeros(sum(sizes)) if flat is None else flat
        cuts = np.cumsum((0, *sizes))
        r, q, c1, c2, self.bias = (self.flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.r, self.q, self.c1, self.c2 = r.reshape(v, d), q.reshape(v, d), c1.reshape(d, d), c2.reshape(d, d)

    def start(self, share: np.ndarray) -> Bilinear:
        rng = np.random.default_rng(self.s.seed)
        self.flat[:] = rng.normal(0, 0.1, len(self.flat))
        self.c1[:], self.c2[:] = np.eye(self.s.width), 0.5 * np.eye(self.s.width)
        self.bias[:] = np.log(share)
        return self

    def log10_table(self) -> np.ndarray:
        """log10 of the probability of each class after each two: one matrix product and one softmax."""
        v = self.s.classes
        context = (self.r @ self.c2.T)[:, None, :] + (self.r @ self.c1.T)[None, :, :]
        scores = context.reshape(v * v, -1) @ self.q.T + self.bias
        top = scores.max(axis=1, keepdims=True)
        scores -= top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
        return (scores / np.log(10)).reshape(-1)

    def train(self, codes: np.ndarray, n: np.ndarray, share: np.ndarray, seed: int) -> None:
        """Noise-contrastive steps (AdaGrad) on triples drawn by their counts; noise classes serve a whole batch."""
        s, v = self.s, self.s.classes
        rng = np.random.default_rng(seed)
        drawn = np.cumsum(n / n.sum())
        noise = np.cumsum(share)
        offset = np.log(s.noise * share)
        memory = np.full(len(self.flat), 1e-4)
        grad = Bilinear(s, np.zeros(len(self.flat)))
        for _ in range(s.steps):
            code = codes[np.minimum(np.searchsorted(drawn, rng.random(s.batch)), len(codes) - 1)]
            w, b, a = code % v, code // v % v, code // (v * v)
            z = np.minimum(np.searchsorted(noise, rng.random(s.noise)), v - 1)
            ra, rb = self.r[a], self.r[b]
            context = ra @ self.c2.T + rb @ self.c1.T
            real = (context * self.q[w]).sum(1) + self.bias[w] - offset[w]
            fake = context @ self.q[z].T + self.bias[z] - offset[z]
            up = -1 / (1 + np.exp(np.clip(real, -30, 30)))  # gradient of the loss by the score
            down = 1 / (1 + np.exp(-np.clip(fake, -30, 30)))
            grad.flat[:] = 0
            np.add.at(grad.q, w, up[:, None] * context)
            np.add.at(grad.q, z, down.T @ context)
            np.add.at(grad.bias, w, up)
            np.add.at(grad.bias, z, down.sum(0))
            gc = up[:, None] * self.q[w] + down @ self.q[z]
            grad.c1[:], grad.c2[:] = gc.T @ rb, gc.T @ ra
            np.add.at(grad.r, b, gc @ self.c1)
            np.add.at(grad.r, a, gc @ self.c2)
            grad.flat /= s.batch
            memory += grad.flat**2
            self.flat -= s.rate * grad.flat / np.sqrt(memory)


def _trainer(s: Settings, share: np.ndarray, turn: int, shipped):
    """A function that trains on one shard's triples, in order, from the shipped parameters; its seed is the shard's."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("code")  # at most one row a triple of classes
        codes, counts = table["code"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(float)
        own = Bilinear(s, shipped.value.copy())
        own.train(codes, counts, share, s.seed * 1000 + turn * 100_003 + table["shard"][0].as_py())
        return pa.table({"i": np.arange(len(own.flat), dtype=np.int32), "x": own.flat * counts.sum(), "weight": np.full(len(own.flat), counts.sum())})

    return run


def fit(triples: DataFrame, s: Settings) -> Bilinear:
    """Rounds of training on every task's share of the triples; Spark averages the parameters, weighted by tokens."""
    n = F.sum("n").alias("n")
    unigram = np.ones(s.classes)
    for k, count in triples.groupBy(F.pmod(F.col("code"), F.lit(s.classes)).alias("k")).agg(n).collect():  # one row a class
        unigram[k] += count
    share = unigram / unigram.sum()
    model = Bilinear(s).start(share)
    # shards by a fixed key, each in order: the result is the same on every cluster
    dealt = triples.select(F.pmod(F.xxhash64("code"), F.lit(s.shards)).alias("shard"), "code", "n")
    for turn in range(s.rounds):
        shipped = triples.sparkSession.sparkContext.broadcast(model.flat)  # of fixed size

        mean = dealt.groupBy("shard").applyInArrow(_trainer(s, share, turn, shipped), "i int, x double, weight double").groupBy("i").agg((F.sum("x") / F.sum("weight")).alias("x")).toPandas()
        if len(mean):
            flat = model.flat.copy()
            flat[mean.i.to_numpy()] = mean.x.to_numpy()
            model = Bilinear(s, flat)
    return model


def score(docs: DataFrame, learn: str, s: Settings | None = None, text: str = "text") -> DataFrame:
    """docs plus n_tokens, n_known, train_tokens, base_score and score; the rows for which `learn` holds are learned from.

    Null or empty texts are one end token. Rows come back as they were, repeated ones too. base_score takes the sum of
    log10((c + 1) / (N + V + 1)). Every token of every text counts, in training and in scoring.
    """
    s = s or Settings()
    kept = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    train = kept.where(learn)
    counts = shared.stored(token_counts(train, s, text))
    head = _head(counts, s)
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast(head)  # at most most_head rows
    triples = shared.stored(triple_counts(train, shipped, s, text))
    model = context.broadcast(fit(triples, s).flat)  # of fixed size
    inside = np.zeros(s.classes)
    inside[1 + s.own_class :] = np.log10(head.sums[1 + s.own_class :] + head.kinds[1 + s.own_class :] + 1)
    rest = [c for c in kept.columns if c != text]
    numbered = kept.select(F.struct(*rest, F.lit(None).alias(*shared.free_names(rest, "nothing"))).alias("rest"), F.col(text).alias("scored_text__"), F.monotonically_increasing_id().alias("row__"))
    schema = shared.widened(numbered.drop("scored_text__"), "n_tokens long, known__ long, logs__ double, plain__ double, tail__ array<long>, often__ array<int>")

    def run(batches):
        table = None
        for batch in batches:
            if table is None:
                table = Bilinear(s, model.value).log10_table()
            n = batch.num_rows
            tokens, known, logs, plain = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            tails, often, sizes = [], [], np.zeros(n, np.int64)
            for lo, hi, data, at in shared.text_slices(batch.column("scored_text__")):
                words, owner, suffix = _tokens(data, at, s)
                count, classes = shipped.value.look_up(words, suffix, s)
                log = np.log10(count + 1.0)
                m = hi - lo
                tokens[lo:hi] = np.bincount(owner, minlength=m)
                known[lo:hi] = np.bincount(owner, count > 0, m)
                logs[lo:hi] = np.bincount(owner, log, m)
                by_suffix = classes > s.own_class
                plain[lo:hi] = np.bincount(owner, table[_codes(classes, owner, s)] + np.where(by_suffix, log - inside[classes], 0), m)
                far = (count == 0) & (suffix >= 0)
                keys = (words[far] & ~np.uint64(63)).view(np.int64)
                whose = owner[far]
                order = np.lexsort((keys, whose))
                keys, whose = keys[order], whose[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])
                first = np.flatnonzero(new)
                tails.append(keys[first])
                often.append(np.diff(np.append(first, len(keys))).astype(np.int32))
                sizes[lo:hi] = np.bincount(whose[first], minlength=m)
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (tails, often)] if n else [pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("row__"), pa.array(tokens), pa.array(known), pa.array(logs), pa.array(plain), *lists], names=["rest", "row__", "n_tokens", "known__", "logs__", "plain__", "tail__", "often__"])

    held = shared.stored(numbered.mapInArrow(run, schema))
    tail = held.select("row__", F.explode(F.arrays_zip("tail__", "often__")).alias("t")).select("row__", F.col("t.tail__").alias("token"), F.col("t.often__").alias("often__"))
    far = tail.join(counts.select("token", F.log10(F.col("n") + 1.0).alias("log")), "token").groupBy("row__").agg(F.sum("often__").alias("more__"), F.sum(F.col("often__") * F.col("log")).alias("far__"))
    base = float(np.log10(head.total + head.distinct + 1))
    out = held.drop("tail__", "often__").join(far, "row__", "left")
    more, log = F.coalesce("more__", F.lit(0)), F.coalesce("far__", F.lit(0.0))
    return out.select(
        *(F.col(f"rest.`{c}`").alias(c) for c in rest),
        "n_tokens",
        (F.col("known__") + more).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("logs__") + log - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("plain__") + log).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base score and model score of every whole text of documents."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out.alias("held_out"))
    return score(docs, "not held_out")
