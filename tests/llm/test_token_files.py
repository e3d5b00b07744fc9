"""Files of token ids: pieces equal whole texts, files read back, one document by its index entry, odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidepanel.llm import shared, token_files

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def plain(texts):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_pieces_equal_whole_texts():
    random.seed(4)
    parts = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "᠎", "​", "﻿", "\x1c", "\x00", "\x85", "it's", "'re", "don't", "A", "word", "12", "3.5", "語", "é", "é", "🙂", "...", "<|endoftext|>", "_", "퟿", ",", ".", "?!", "Ünïcode", "ªº", "\nNew", "end.\nNext,"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(3000)] + ["", " ", "  ", " a", "a ", "x" * 3000, "a  b   c    d", "\0 \0"]
    coder = token_files.Encoder(PATH, most=500)
    got = [list(np.frombuffer(x, coder.kind)) for lo in range(0, len(texts), 97) for x in coder.serialised(texts[lo : lo + 97])]
    assert coder.cut and got == plain(texts)


def test_files_round_trip(spark, tmp_path):
    long = " ".join(f"w{i} alpha" for i in range(40_000))
    rows = [(i, f"text number {i} of the shared kind, the same words over and over", "x", 1) for i in range(300, 0, -1)] + [(400, None, None, 2), (401, "", None, 3), (402, long, "y", 4), (None, "no id", "z", 5), (None, "no id", "z", 5), (7, "a second text of seven", "z", 6), (-5, "before", "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int")
    files = token_files.write(docs, PATH, str(tmp_path))
    got = token_files.read(files, str(tmp_path)).orderBy("start").collect()
    ids = dict(zip([r[:2] for r in rows], plain([r[1] for r in rows]), strict=True))
    sums = sorted((r[0] is not None, r[0] or 0, zlib.crc32(np.array(ids[r[:2]], "<u4").tobytes())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == sums
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    starts = np.cumsum([0, *[r.n_tokens for r in got]])
    assert [r.start for r in got] == list(starts[:-1]) and next(r for r in got if r.doc_id == 400).n_tokens == 1
    names = [r["name"] for r in files.collect()]
    one = [token_files.Reader(str(tmp_path), n).find(402) for n in names]
    assert [list(x) for x in one if x is not None] == [ids[402, long]]
    assert all(token_files.Reader(str(tmp_path), n).find(10**6) is None for n in names)
    dictionary = next(tmp_path.glob("*.dictionary"))
    dictionary.write_bytes(dictionary.read_bytes() + b"x")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.Reader(str(tmp_path), names[0])


def test_empty_and_few(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(none, PATH, f"file://{tmp_path}/a"), f"file://{tmp_path}/a").collect() == []
    one = spark.createDataFrame([(3, "hello")], "doc_id long, text string")
    got = token_files.read(token_files.write(one, PATH, f"{tmp_path}/b"), f"{tmp_path}/b").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(3, 0, 2)]


def test_files_of_bounded_size(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_DOCS", 10)
    out = token_files.Writer(str(tmp_path), 0, "<u2", b"")
    rows = [out.add(i, np.arange(i, dtype="<u2").tobytes()) for i in range(25)] + [out.close()]
    rows = [r for r in rows if r]
    assert [r[3] for r in rows] == [10, 10, 5] and sum(r[4] for r in rows) == sum(range(25))
    (tmp_path / f"{out.hash.hex()}.dictionary").write_bytes(b"")
    assert list(token_files.Reader(str(tmp_path), rows[1][2]).find(13)) == list(range(13))


def test_frames_share_the_dictionary():
    """A short document costs less with the dictionary than without."""
    import zstandard

    coder = token_files.Encoder(PATH)
    texts = [f"the price of item {i} rose by {i % 7} per cent in the week of the report" for i in range(800)]
    coded = coder.serialised(texts)
    shared_bytes = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(token_files.trained(coded[:400])))
    assert sum(len(shared_bytes.compress(x)) for x in coded[400:]) < 0.6 * sum(len(zstandard.compress(x)) for x in coded[400:])
    assert shared.free_names(["a"], "a") == ["a_"]
