import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import language as lg


def plain_vector(text):
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    letters = f" {letters} " if letters else ""
    out = np.zeros(lg.DIMENSIONS)
    for k in range(len(letters) - 2):
        a, b, c = ((0 if x == " " else int(lg.letters(x)[1])) for x in letters[k : k + 3])
        out += np.roll(lg.LETTER[a], 2).astype(int) * np.roll(lg.LETTER[b], 1) * lg.LETTER[c]
    return out


def test_vectors_against_a_loop():
    texts = ["The cat, the hat!", "é 1 ß", "x", "Straße 你好 𐐀𐐨", "", "12 34"]
    assert np.allclose(lg.bundled(texts), [plain_vector(t) for t in texts])


def test_prediction_against_a_loop(spark, docs):
    corpus = {"en": "the cat and the dog went there with other things", "de": "der hund und die katze gehen dort mit anderen dingen", "xx": "zzqq wwzz qqww zqzq"}
    rows, langs = [], []
    for n in range(60):
        lang = sorted(corpus)[n % 3]
        words = corpus[lang].split()
        rows.append((n, " ".join(words[n % 5 :] + words[: n % 4])))
        langs.append(lang)
    rows += [(100, None), (101, ""), (102, "12 %"), (None, "the dog"), (5, rows[5][1]), (200, "the cat " * 20000)]
    langs += ["en", "en", None, "en", langs[5], None]
    data = spark.createDataFrame([(i, t, g, "s", True, 0.5) for (i, t), g in zip(rows, langs, strict=True)], "doc_id long, text string, lang string, source string, held_out boolean, score double")
    got = sorted((tuple(r) for r in lg.predict(data).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    made = {}
    for g in sorted(corpus):
        v = sum(plain_vector(t or "") for (i, t), x in dict.fromkeys(zip(rows, langs, strict=True)) if x == g and i is not None and not held(i))
        v = v + (plain_vector(rows[5][1]) if g == langs[5] and not held(5) else 0)  # the repeated row counts twice
        made[g] = v / np.linalg.norm(v)
    want = []
    for i, t in rows:
        v = plain_vector(t or "") if i != 200 else plain_vector("the cat " * 20)
        scores = {g: v @ p / max(1e-9, np.linalg.norm(v)) for g, p in made.items()}
        best = max(sorted(scores), key=scores.get)
        lettered = any(c.isalpha() for c in t or "")
        want.append((i, held(i), best if lettered else "und", min(1, max(0, scores[best])) if lettered else 0.0))
    want.sort(key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-3)
    kept = lg.keep_known(data)
    assert kept.columns == data.columns and kept.count() == sum(r[2] != "und" for r in want)


def test_held_out_accuracy(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lg.predict(data).join(data.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, all_ = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert all_ > 150 and right > 0.98


def test_nothing_to_learn(spark, docs):
    assert {r.lang_pred for r in lg.predict(docs([(1, "a b")], lang=None)).collect()} == {"und"}
    assert lg.predict(docs([])).count() == 0


OTHERS = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
]


def test_texts_of_no_learned_language_go(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("lang <> 'fr'")
    left_out = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").filter("lang = 'fr' and n_chars > 200")
    rng = np.random.default_rng(1)
    signs = list("abcdefghijklmnopqrstuvwxyz")
    planted = OTHERS + [" ".join("".join(rng.choice(signs, 6)) for _ in range(n)) for n in (30, 100, 1000)]
    planted += ["".join(rng.choice(signs + [c.upper() for c in signs] + list("0123456789+/"), 800)), "17 x 4 250 " + "1093 88 " * 50]
    first = len(planted)
    planted += [r.text for r in left_out.collect()]
    # Unlabelled, so that nothing is learned from the planted rows.
    new = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(planted)], data.schema)
    kept = [r.doc_id for r in lg.keep_known(data.unionByName(new)).select("doc_id").collect()]
    assert sum(i >= 0 for i in kept) >= 0.995 * data.count()
    assert not [i for i in kept if -first <= i < 0]
    assert sum(i < 0 for i in kept) <= 0.02 * (len(planted) - first)


def test_memory_of_many_letters():
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 2000))) for _ in range(512)]
    made = rng.normal(size=(4, lg.DIMENSIONS)).astype(np.float32)
    tracemalloc.start()
    names = [lg.judged(some, list("abcd"), made) for some in lg.rounds(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, names)) == len(texts) and peak < 400 << 20


def test_long_texts_are_counted_in_blocks(monkeypatch):
    texts = ["the cat, the hat! " * 50, "x", "Straße 你好 𐐀𐐨 " * 9]
    whole = lg.counted(texts)
    monkeypatch.setattr(lg, "ROUND_CHARS", 37)
    for a, b in zip(whole, lg.counted(texts), strict=True):
        assert a.tolist() == b.tolist()


def test_sparse_and_dense_sums_are_equal(monkeypatch):
    counted = lg.counted([f"word{chr(97 + k % 26)} other{chr(97 + k % 7)} thing" for k in range(90)])
    dense = lg.bundle(*counted, 90)
    monkeypatch.setattr(lg, "SPARSE", 0)
    monkeypatch.setattr(lg, "CODES", 50)
    assert (lg.bundle(*counted, 90) == dense).all()


def test_equal_cosines_give_the_first_name(spark):
    rows = [(n, "the same words in both", lang) for n, lang in enumerate(["bb", "aa"] * 8)] + [(99, "the same words", None)]
    out = lg.predict(spark.createDataFrame([(*r, "s", 0.5) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 or r[0] == 99], "doc_id long, text string, lang string, langs string, score double"))
    counts = {r.lang_pred for r in out.collect()}
    assert counts == {"aa"}
