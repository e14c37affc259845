import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(6)
    made = [None, "", " \n", "It's WE'LL ok", "a b\x85c\x1cd", "naïve ÀÉ ﬁ 你好 😀 क्षि é İSTANBUL ΣΑΣ", "<|endoftext|> x", "a <|endoftext|> x", "a<|startoftext|>B,<|endoftext|><|endoftext|>.", "<|ENDOFTEXT|>", "1234 5,6", "ŉ ß ªº µ ǅ", "x" * 3000, "the " * 9000]
    made += ["".join(rng.choice(["a", "The", "ing", " ", "\n", "\t ", "é", "1", "'s", "!", "||", "́", "‍", "Ω"]) for _ in range(rng.randrange(70))) for _ in range(200)]
    return made


def expected(plain, rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(tf, "PART_IDS", 3000)
    monkeypatch.setattr(tf, "FILE_IDS", 900)
    monkeypatch.setattr(tf, "BLOCK_IDS", 100)
    rows = [(1000 - n, t) for n, t in enumerate(texts())] + [(None, "null id")]
    got = tf.digests(tf.round_trip(docs(rows), PATH, 2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(plain, rows), key=str)


def test_folder_is_read_by_its_path_alone(spark, docs, plain, tmp_path):
    rows = [(n % 9, t) for n, t in enumerate(texts()[:40])]
    made = tf.encoded(docs(rows), PATH, 2).withColumn("row", F.monotonically_increasing_id())
    made.write.parquet(str(tmp_path / "ids"))
    folder = str(tmp_path / "tokens")
    manifest = tf.write(spark.read.parquet(str(tmp_path / "ids")), folder)
    found = spark.newSession()
    got = sorted(tf.digests(tf.read(found, folder)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    want = sorted((i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert manifest.agg(F.sum("n_docs"), F.sum("n_ids")).first() == (len(rows), sum(n for _, n in want))


def test_thousands_of_parts():
    rng = np.random.default_rng(4)
    bounds = np.sort(np.concatenate((rng.integers(0, 10**6, 4000), np.full(1000, 777))))
    ids = np.concatenate((rng.integers(-5, 10**6 + 5, 20_000), np.full(20_000, 777)))
    part = tf.placed(pa.array([None, *ids.tolist()], pa.int64()), np.arange(len(ids) + 1), bounds)
    assert part[0] == 0 and part.max() <= len(bounds)
    order = np.argsort(part, kind="stable")
    least, most = {}, {}
    for p, i in zip(part[1:].tolist(), ids.tolist(), strict=True):
        least[p], most[p] = min(i, least.get(p, i)), max(i, most.get(p, i))
    parts = sorted(least)
    assert all(most[a] <= least[b] for a, b in zip(parts, parts[1:], strict=False)) and len(order) == len(part)
    hot = np.bincount(part[1:][ids == 777])
    assert (hot > 0).sum() > 900 and hot.max() < 200


def test_hot_id_over_many_parts(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(tf, "PART_IDS", 60)
    rows = [(n if n % 3 else 50, f"word {n} and more") for n in range(150)]
    got = sorted(tf.digests(tf.round_trip(docs(rows), PATH, 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_repeats_and_empty(spark, docs, plain):
    rows = [(5, "a b"), (5, "a b"), (-3, None)]
    got = tf.digests(tf.round_trip(docs(rows), PATH, 2)).collect()
    assert sorted(map(tuple, got)) == expected(plain, rows)
    assert tf.digests(tf.round_trip(docs([]), PATH, 2)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 1000])
def test_pack(size):
    rng = np.random.default_rng(size)
    values = (rng.integers(0, 2**32, size, np.uint64) >> rng.integers(0, 32, size).astype(np.uint64)).astype(np.uint32)
    control, data = tf.pack(values)
    assert len(control) == -(-size // 4)
    back = tf.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.arange(size))
    assert back.tolist() == values.tolist()


def test_words_with_signs_and_capitals_get_the_ids_of_the_library():
    words = ["Straße,", "ÀÉÎ!?", "H̱.", "İ", "don't.", "'s,", "a,̈", "a.b,", "(x)", "...", "日本,", "A" * 300 + ".", "<|endoftext|>", "x", "X,", "Th###", "a_b", "A$$$", "é|", "--", "x</w>", "a<|", "|>", "<|", "q\\]^", "'", "x'", "``~"]
    own = tf.Words(PATH)
    for _ in range(2):  # the second time all are remembered
        ids, counts = own.encode(pa.array(words))
        found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert found == [x.ids for x in own.tokenizer.encode_batch(words, add_special_tokens=False)]
