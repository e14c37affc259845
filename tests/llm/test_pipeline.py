import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from quire.llm import simhash

BENCH = "the quick assessment asks which seven rivers cross the northern plain before they reach the sea and why"
KEY = "AKIA" + "Q7" * 10
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    texts = {
        1: prose(1),
        2: prose(1),
        3: prose(2) + " " + BENCH + " " + prose(3),
        4: prose(4) + " " + KEY + " " + prose(5, 30),
        5: None,
        6: "12345 ... 678",
        7: "",
        8: prose(6),
        9: prose(7, 30_000),
    }
    rows = [(i, t, "en" if i != 8 else None, f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    rows += [rows[7], (None, prose(8), "en", None, 1), (None, prose(9), "en", "s1", 1), (4, prose(10), "en", "s2", 1), (4, prose(11) + " token = abcdefabcdef", "en", "s2", 1)]
    sf_dir = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return sf_dir, rows


def brute(rows):
    """The pipeline over a list: one row of each group of near copies, no benchmark passage, secrets masked, digests of ids and bytes."""
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    prints = [simhash.fingerprint(r[1]) for r in kept]
    root = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(len(kept)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for r, g in zip(kept, root, strict=True):
        groups.setdefault(g, []).append(r)
    firsts = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, text, *_ in firsts:
        if BENCH in text:
            continue
        text = text.replace(KEY, "[secret]").replace("token = abcdefabcdef", "[secret]")
        ids = np.array(coder.encode_ordinary(text), "<u4").tobytes()
        out.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_run_agrees_with_brute_force(spark, made):
    sf_dir, rows = made
    assert sorted([tuple(r) for r in P.run(spark, sf_dir).collect()], key=str) == brute(rows)


def test_stages_keep_the_columns(spark, made):
    sf_dir, _ = made
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in P.STAGES[:-1]:
        assert apply(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString()


def test_empty_documents(spark, made):
    sf_dir, _ = made
    docs = spark.createDataFrame([], COLUMNS)
    for _, apply in P.STAGES:
        assert apply(spark, docs, sf_dir).count() == 0
