import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerkeep.llm import token_blocks as tb
from ledgerkeep.llm.queries import word_tokenizer
from ledgerkeep.session import staging_path

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, start string, part int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_segments_round_trip(ids):
    raw = np.array(ids, dtype=np.uint32)
    payload = tb.pack(raw)
    assert np.array_equal(tb.unpack(payload), raw)
    for b, e in ((0, 1), (5, 130), (128, 256), (len(raw) - 3, len(raw) + 9)):
        b = max(b, 0)
        assert np.array_equal(tb.read_ids(payload, b, e), raw[b:e])


def test_outliers_become_exceptions():
    ids = np.full(128, 7, dtype=np.uint32)
    ids[[3, 90]] = 40_000
    assert len(tb.pack(ids)) < 12 + 4 + 6 + 2 * 5 + 1  # width zero, two exceptions


def brute(rows):
    model = tokenizers.Tokenizer.from_file(word_tokenizer())
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_documents(spark, monkeypatch):
    monkeypatch.setattr(tb, "SEGMENT_IDS", 50)
    texts = ["The quick fox", None, "", "x" * 5000, "It's  a test of\x0b<|endoftext|>white space é ́", "word " * 4000, "Straße ÉTÉ 漢字", "same", "same"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(8, "same"), (8, "same"), (-5, "low id")]
    path = staging_path(spark, "tokens")
    tb.write(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(4), path, word_tokenizer(), 2)
    got = tb.read_documents(spark, path).orderBy("start").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [tuple(r) for r in got] == brute(ordered)


def test_empty_table(spark):
    path = staging_path(spark, "tokens")
    tb.write(spark.createDataFrame([], SCHEMA), path, word_tokenizer(), 2)
    assert tb.read_documents(spark, path).collect() == []


def test_words_and_pieces_equal_the_tokenizer(monkeypatch):
    rng = random.Random(1)
    letters = list("aAbBsStTdDmM'\u2019.,!?-_ 019\u00b2\u00bd\u00aa\u00b5\u00df\u00e9\u00c9\u0300\u0130\u0131\u017f\u0149\u03a3\u03c3\u03c2\u01c5\uff21<|>\u00a0 \x1c\x85\x0b\u6f22\u200d")
    letters += ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    model = tokenizers.Tokenizer.from_file(word_tokenizer())
    for remembered in (tb.REMEMBERED, 50):  # the second: generations change with each call
        monkeypatch.setattr(tb, "REMEMBERED", remembered)
        words = tb.WordTokenizer(word_tokenizer())
        got = [x for i in range(0, len(texts), 90) for x in words.encode([t.encode() for t in texts[i : i + 90]])]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_calls():
    words = tb.WordTokenizer(word_tokenizer())
    assert words.encode([]) == [] and words.encode([b"", b" \n\t"]) == [b"", b""]
    assert [len(x) for x in words.encode([b"", b" a\n", b""])] == [0, 4, 0]


def test_remembered_words_take_little_memory():
    words = tb.WordTokenizer(word_tokenizer())
    words.encode([b"start"])
    texts = [" ".join(f"{a}{b}{c}," for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz").encode() for a in ("qu", "tro", "mi", "ska", "ble", "ow", "gri", "pe") * 8]
    texts = [t.replace(b",", b"x" * (i // 8) + b",") for i, t in enumerate(texts)]
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for t in texts:
        words.encode([t])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 150 * len({w for t in texts for w in t.split()})  # 240 bytes a word as Python objects, 79 as arrays
