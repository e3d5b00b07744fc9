"""License scans: fuzzy search for short notices.

The texts are read as words (A-Z in lower case, words of letters, digits and all characters over U+007F), joined by
one space. A notice of n characters may hold up to k edits (insertions, deletions, substitutions). Cut into k + 1
pieces, at least one piece of it stands unchanged in whatever lies within k edits (pigeonhole), so an Aho-Corasick
automaton over all pieces of all notices finds every candidate place; there the regex library's bounded-error matching
decides, counts the edits and gives the span.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared

#: Fixed values. Base notices: the words that must stand consecutively, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed values. Notices of the method itself, as words, with their labels and the most edits.
NOTICES = (
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 2),
    ("licensed under cc by", "cc-by", 2),
    ("creative commons attribution", "cc-by", 3),
    ("licensed under the apache license", "apache", 3),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("this work is dedicated to the public domain", "public-domain", 4),
    ("spdx license identifier", "spdx", 2),
)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of nearly one length: (where it starts, piece)."""
    cuts = np.linspace(0, len(notice), edits + 2).round().astype(int)
    return [(int(a), notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def _search(notices: tuple):
    import ahocorasick
    import regex

    seeds = ahocorasick.Automaton()
    at: dict[str, list] = {}
    for n, (text, _, edits) in enumerate(notices):
        for start, piece in pieces(text, edits):
            at.setdefault(piece, []).append((n, start))
    for piece, where in at.items():
        seeds.add_word(piece, (len(piece), where))
    seeds.make_automaton()
    match = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}") for text, _, edits in notices]
    return seeds, match


def find(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, edits, start, end) of every place of normalised text that lies within a notice's edits; ends exclusive.

    Of places of one notice that overlap, the one with the fewest edits stays.
    """
    seeds, match = _search(notices)
    windows: dict[int, list[list[int]]] = {}
    for last, (size, where) in seeds.iter(text):
        for n, start in where:
            whole, edits = len(notices[n][0]), notices[n][2]
            lo = max(0, last + 1 - size - start - edits)
            hi = last + 1 + whole - start - size + edits
            spans = windows.setdefault(n, [])
            if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
    out = []
    for n, spans in windows.items():
        done = -1
        for lo, hi in sorted(spans):
            lo = max(lo, done)
            least = len(notices[n][0]) - notices[n][2]
            parts = [(lo, min(hi, len(text)))]
            while parts:
                a, b = parts.pop()
                if b - a >= least and (m := match[n].search(text, a, b)):
                    out.append((n, sum(m.fuzzy_counts), m.start(), m.end()))
                    done = max(done, m.end())
                    parts += [(a, m.start()), (max(m.end(), a + 1), b)]
    return sorted(out, key=lambda x: (x[2], x[0]))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,notice:string,edits:int,first_word:long,last_word:long>>"


def _scan(text: str | None, base: tuple, notices: tuple, names: list[bytes]) -> tuple:
    data = np.frombuffer((text or "").encode(), np.uint8)
    data = shared.LOWER[data]
    starts, ends, _ = shared.word_spans(data, np.array([0, len(data)]), shared.PLAIN)
    n = len(starts)
    if not n:
        return 0, 0, None, None, "", "", 0.0, []
    line = np.full(int((ends - starts).sum()) + n - 1, 0x20, np.uint8)
    inside = shared.PLAIN[data]
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    keep = np.ones(len(line), bool)
    keep[at[1:] - 1] = False
    line[keep] = data[inside]
    joined = line.tobytes()
    word = functools.partial(np.searchsorted, at, side="right")
    places, base_labels = [], set()
    for phrase, label in base:
        key = phrase.encode()
        i = joined.find(key)
        while i >= 0:
            j = i + len(key)
            if (i == 0 or joined[i - 1] == 0x20) and (j == len(joined) or joined[j] == 0x20):
                places.append(int(word(i)) - 1)
                base_labels.add(label)
            i = joined.find(key, i + 1)
    labels, found, score = set(base_labels), [], 1.0 if places else 0.0
    if any(x in joined for x in names):
        readable = joined.decode()
        offset = None
        for k, edits, lo, hi in find(readable, notices):
            if offset is None:
                offset = np.cumsum(np.concatenate([[0], np.frombuffer(readable.encode("utf-32-le"), np.uint32) == 0x20]))
            text_, label, _ = notices[k]
            labels.add(label)
            found.append({"label": label, "notice": text_, "edits": edits, "first_word": int(offset[lo]), "last_word": int(offset[max(lo, hi - 1)])})
            score = max(score, 1.0 - edits / len(text_))
    return n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, found


def scan(docs: DataFrame, text: str = "text", base: tuple = BASE, notices: tuple = NOTICES) -> DataFrame:
    """docs (without the text) plus what SCHEMA names: words, base places, labels, score, and each fuzzy match's span.

    A null or empty text has no words, null places, empty labels and score 0. score is 1 where a base phrase or an
    unchanged notice stands, else 1 - edits / length of the closest notice found. Texts are read whole, one at a time.
    """
    extra = StructType.fromDDL(SCHEMA).names
    rest = [c for c in docs.columns if c != text and c not in extra]
    schema = shared.widened(docs.select(*rest), SCHEMA)
    names = sorted({p.encode() for t, _, e in notices for _, p in pieces(t, e)})
    match = pa.struct([("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(match)]

    def run(batches):
        for batch in batches:
            rows = [_scan(t, base, notices, names) for t in batch.column(len(rest)).to_pylist()]
            columns = [pa.array(r, kind) for r, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], names=[*rest, *extra])

    return docs.select(*rest, F.col(text).alias(*shared.free_names(rest, "scanned"))).mapInArrow(run, schema)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Words, base places and labels of every whole text of documents, with the method's own labels and score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
