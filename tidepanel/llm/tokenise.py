"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer T is normaliser o pieces o byte fallback. Its states are the pieces; the arc a -> b reads the text of b,
writes b's id and weighs 1, or weighs infinity where the pair (a, b) isn't what the merge rules of the model leave
side by side. A byte-fallback arc reads one character that no piece covers and writes its bytes. A model of merges
leaves exactly one path of finite weight, so the shortest path in the tropical semiring (min, +) is its encoding; it is
taken from left to right over the lattice that a text composed with T gives: for every position, the lightest path
ending there and its last piece. In a model of unigrams any pair may follow and an arc weighs minus its score, so the
same pass is Viterbi's.

White space separates the lattice: no piece reads a space after another character, so a text falls into chunks
that share no arcs, and a chunk's path is kept for its next use (a bounded store in each Python worker).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
INFINITE = float("inf")


class Transducer:
    """The compiled transducer of a SentencePiece model; plain dictionaries, so it can be broadcast.

    Its size is that of the vocabulary. Normalisers: identity, with or without the dummy prefix.
    """

    def __init__(self, model: str = MODEL):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        probe = sp.normalize("a  ﬁ① b ")
        if probe.replace(" ", SPACE).lstrip(SPACE) != f"a{SPACE}{SPACE}ﬁ①{SPACE}b{SPACE}":
            raise ValueError("only models with the identity normaliser are compiled")
        self.prefix = sp.normalize("a").replace(" ", SPACE)[0] == SPACE
        n = sp.get_piece_size()
        self.piece, self.ids, self.byte, self.rank, self.score = [], {}, [0] * 256, {}, {}
        self.unknown = sp.unk_id()
        for i in range(n):
            text = sp.id_to_piece(i)
            self.piece.append(text)
            if sp.is_byte(i):
                self.byte[int(text[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[text] = i
                self.rank[text] = -sp.get_score(i)
        self.longest = max(map(len, self.ids))
        whole = {r for r in self.rank.values()}
        self.merges = all(r == int(r) for r in whole) and sum(len(t) > 1 for t in self.ids) <= len(whole) + 1
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(t) for t in self.ids):
            raise ValueError("a piece reads a space after another character")
        self.halves: dict[str, tuple[str, str]] = {}
        if self.merges:
            for t in sorted(self.ids, key=len):
                if len(t) > 1:
                    self._halve(t)
            # a piece that its own merges don't give can't be on a path
            self.ids = {t: i for t, i in self.ids.items() if len(t) == 1 or t in self.halves}
        self.trie: dict = {}
        for t, i in self.ids.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i
        self.written = [b"" if i in self.special else t.replace(SPACE, " ").encode() for i, t in enumerate(self.piece)]
        for x, i in enumerate(self.byte):
            if i:
                self.written[i] = bytes([x])
        alone = "" if any(len(t) > 1 and "\n" in t for t in self.ids) else "\n"
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n" if alone else ""))

    def _halve(self, text: str) -> None:
        """The last merge that makes a piece, by running the model's merges on the piece's own text."""
        parts, rank, last = list(text), self.rank, None
        while len(parts) > 1:
            best, at = INFINITE, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], INFINITE)
                if r < best:
                    best, at = r, k
            if at < 0:
                return
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(last)]
        self.halves[text] = last

    def allowed(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b side by side: no merge across their border comes before a side grows."""
        rank, halves = self.rank, self.halves
        left, right = [a], [b]  # from the whole piece down to the character at the border
        while left[-1] in halves:
            left.append(halves[left[-1]][1])
        while right[-1] in halves:
            right.append(halves[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            grow_left = rank[left[i - 1]] if i else INFINITE
            grow_right = rank[right[j - 1]] if j else INFINITE
            across = rank.get(left[i] + right[j], INFINITE)
            if across < grow_left and across <= grow_right and across < INFINITE:
                return False
            if not i and not j:
                return True
            if grow_left <= grow_right:
                i -= 1
            else:
                j -= 1


class Path:
    """Shortest paths through the transducer for the texts of one task."""

    def __init__(self, fst: Transducer, most_pairs: int = 1 << 20, most_chunks: int = 300_000):
        self.fst, self.most_pairs, self.pairs = fst, most_pairs, {}
        self.chunks, self.older, self.most_chunks = {}, {}, most_chunks

    def encode_chunk(self, text: str) -> list[int]:
        """The ids on the shortest path: from each position, the arcs that the trie of pieces finds there."""
        fst, pairs, n = self.fst, self.pairs, len(text)
        merges, root, rank, piece, unknown = fst.merges, fst.trie, fst.rank, fst.piece, 0
        weight, last, back = [0.0] + [INFINITE] * n, [unknown] * (n + 1), [0] * (n + 1)
        for start in range(n):
            here, p = weight[start], last[start]
            node, end = root, start
            while end < n:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                t = node.get("")
                if t is None:
                    continue
                if merges:
                    w = here + 1.0
                    if w >= weight[end]:
                        continue
                    if p:
                        key = p << 24 | t
                        ok = pairs.get(key)
                        if ok is None:
                            if len(pairs) >= self.most_pairs:
                                pairs.clear()
                            ok = pairs[key] = fst.allowed(piece[p], piece[t])
                        if not ok:
                            continue
                else:
                    w = here + rank[piece[t]]
                    if w >= weight[end]:
                        continue
                weight[end], last[end], back[end] = w, t, start
            if weight[start + 1] == INFINITE:  # byte fallback
                weight[start + 1], last[start + 1], back[start + 1] = here + (1.0 if merges else 1e6), unknown, start
        out, end = [], n
        while end:
            t, start = last[end], back[end]
            if t:
                out.append(t)
            else:
                out.extend(fst.byte[x] for x in reversed(text[start:end].encode()))
            end = start
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = text.replace(" ", SPACE)
        if self.fst.prefix:
            text = SPACE + text
        store, out = self.chunks, []
        for c in self.fst.chunk.findall(text):
            got = store.get(c)
            if got is None:
                got = self.older.get(c)
                if got is None:
                    got = np.array(self.encode_chunk(c), np.int32).tobytes()
                if len(c) <= 64:
                    if len(store) >= self.most_chunks:  # the older half goes
                        self.older, store = store, {}
                        self.chunks = store
                    store[c] = got
            out.append(got)
        return np.frombuffer(b"".join(out), np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        written = self.fst.written
        data = b"".join([written[i] for i in ids])
        return data[1:] if self.fst.prefix and data[:1] == b" " else data

    def decode(self, ids) -> str:
        """The inverted transducer: pieces write their text, runs of bytes their UTF-8; the dummy prefix goes."""
        return self.decode_bytes(list(ids)).decode("utf-8", "replace")


def _compiled(df: DataFrame, model: str):
    # Bounded: the broadcast holds one vocabulary, whose size the model file fixes.
    return df.sparkSession.sparkContext.broadcast(Transducer(model))


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs plus `ids` array<int>, `n_tokens` and `round_trip` (decoding gives the text with U+2581 read as a space).

    A null or empty text has no ids. Texts of any length are encoded whole, in time linear in their length. Columns of
    those names in docs are replaced; others, and repeated rows, stay as they are.
    """
    kept = docs.drop("ids", "n_tokens", "round_trip")
    fst = _compiled(docs, model)
    names = kept.columns
    schema = shared.widened(kept, "ids array<int>, n_tokens int, round_trip boolean")

    def run(batches):
        path = Path(fst.value)
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            ids = [path.encode(t or "") for t in texts]
            same = [path.decode_bytes(i.tolist()) == (t or "").replace(SPACE, " ").encode() for i, t in zip(ids, texts, strict=True)]
            at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            counts = pa.array(np.diff(at).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, counts, pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "round_trip"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded plus `decoded`, the text of an array of ids (null or empty array: empty text)."""
    kept = encoded.drop("decoded")
    fst = _compiled(encoded, model)
    names = kept.columns

    def run(batches):
        path = Path(fst.value)
        for batch in batches:
            texts = [path.decode(i or ()) for i in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return kept.mapInArrow(run, shared.widened(kept, "decoded string"))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, their number, and whether decoding gives the text back."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "ids", F.col("n_tokens").cast("long").alias("n_tokens"), "round_trip")
