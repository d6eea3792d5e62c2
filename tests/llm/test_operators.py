"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bbit_minhash, byte_cnn, dp_packing, html_extract, mil_quality, png_media, token_shards, toxicity, warc_zstd, winnow
from lodestrata.llm.words import tokenizer_file

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


CASES = [
    (1, prose(1, 120), "en"), (2, prose(1, 120), "en"), (3, prose(1, 119) + " end", None), (4, None, "en"), (5, "", "de"), (6, "one", "de"), (7, "one", "de"), (8, "  \n\t ", "en"),
    (9, prose(2, 30000), "en"), (10, prose(3, 40).upper() + ". É" * 3, "fr"), (None, prose(4, 30), "en"), (None, None, None), (11, "\u0000x \U0001f600", "en"), (11, "\u0000x \U0001f600", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, 1.0, 2, b"x", "k") for i, t, lang in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_words int, media binary, _id string").repartition(3)


def brute_windows(words, item):
    n = min(10, len(item))
    return [item[i : i + n] for i in range(len(item) - n + 1)] if item else []


def test_decontamination_against_brute_force(spark, docs):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    long = prose(2, 30000).split()
    items = [(1, " ".join(long[500:515])), (2, "one"), (3, None), (4, prose(1, 9)), (5, "x " * 3), (6, " ".join(long[29990:])), (None, "one"), (2, "one"), (7, prose(3, 40))]
    frame = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, fp int")
    got = winnow.contamination(docs, frame)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = []
    for i, t, _ in CASES:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            for win in brute_windows(w, cut(text)) if item is not None else []:
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert winnow.contamination(docs, frame.limit(0)).where("contaminated").count() == 0
    assert winnow.contamination(docs.limit(0), frame).count() == 0
    kept = winnow.clean(docs, frame)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = dict(enumerate([prose(s, 100) for s in range(6)]))
    for k in range(6, 60):  # copies with edits, chains of them, a large group around one text
        words = texts[int(rng.integers(0, k)) if k % 3 else 0].split()
        for _ in range(int(rng.integers(0, 12))):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(WORDS))
        texts[k] = " ".join(words)
    texts |= {60: None, 61: "", 62: "one", 63: "ONE", 64: " "}
    frame = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, component_id int").repartition(3)
    got = {r["doc_id"]: r for r in bbit_minhash.near_duplicates(frame, k=2).collect()}

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (comp[i] == i) for i, r in got.items())


def test_near_duplicates_of_odd_rows(spark, docs):
    got = bbit_minhash.near_duplicates(docs).collect()
    by = {r["doc_id"]: (r["component_id"], r["kept"]) for r in got}
    assert len(got) == len(CASES) and by[1] == by[3][:1] + (True,) if by[3][0] == 3 else by[2] == (1, False)
    assert by[4] == (4, True) and by[7] == (6, False) and by[None] == (None, True)
    assert bbit_minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = bbit_minhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 11").count() == 1


def test_packing_gives_back_every_document(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    rows = dp_packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), with_ids=True, window=256).collect()
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t, _ in CASES if i is not None}
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] * 4 == len(got.get(r["doc_id"], b"")) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert got == want and {r["doc_tokens"] * 4 for r in rows if r["doc_id"] == 9} == {len(want[9])}
    assert dp_packing.pack(docs).where("doc_id is null and start = 0").count() == 2 and dp_packing.pack(docs.limit(0)).count() == 0


def test_shards_are_read_from_any_slot(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = token_shards.materialise(docs, folder, length=32, per_shard=100).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    got = list(token_shards.read_slots(folder, 37, 150, 32, 100))
    assert [zlib.crc32(g.tobytes()) for g in got] == [r["ids_crc32"] for r in rows[37:187]]
    assert all(r["byte_offset"] == r["slot"] % 100 * 64 for r in rows) and {4, 5} <= {d for r in rows for d in r["doc_ids"]}
    assert token_shards.materialise(docs.limit(0)).count() == 0


def test_media_columns(spark, docs):
    got = png_media.media_features(png_media.to_media(docs)).collect()
    assert len(got) == len(CASES)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in CASES:
        if i is not None:
            n, payload = png_media.payload_of(t)
            r = by[i]
            assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[1][1:] == by[2][1:] and by[4][1:] == by[5][1:]
    assert png_media.media_features(png_media.to_media(docs.limit(0))).count() == 0


def test_archives(spark):
    big = "<p>" + "y" * 300_000
    pages = [(1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "u\r\nv", "x" * 99), (4, "http://a", "x" * 99), (5, "", None), (6, "é", ""), (7, "z", big), (8, "z", big), (1, "http://a", "x" * 200), (None, None, "x" * 200)]
    frame = spark.createDataFrame([(*p, "w") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = warc_zstd.read_archives(warc_zstd.write_archives(frame)).collect()
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        first = {200: 1, len(big): 7}.get(len(b)) if i is not None else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first and first != i else "response", first if first and first != i else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc_zstd.read_archives(warc_zstd.write_archives(frame.limit(0))).count() == 0


def test_html_rows(spark):
    pages = [(1, "u", "<article><p>One  two"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>One  two"), (3, "v", "<p>" * 20000 + "<b>x")]
    frame = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    got = html_extract.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, got.select("page_id", "text", "n_chars").collect())) == sorted(map(str, spark.createDataFrame([(1, "One two", 7), (2, "", 0), (None, "", 0), (1, "One two", 7), (3, "", 0)], "page_id long, text string, n_chars long").collect()))
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_classifiers_take_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, (i or 0) % 2, "x") for i in range(1, 12)] + [(None, 1, 0, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    for some in (labels, labels.limit(0)):
        graded = toxicity.grade(docs, toxicity.train(docs, some))
        assert graded.columns == ["doc_id", "severity", "grade", "toxic"] and graded.count() == len(CASES)
        kept = toxicity.without_toxic(docs, toxicity.train(docs, some))
        assert kept.columns == docs.columns and kept.count() == graded.where("not toxic").count()
        scored = mil_quality.score(docs, mil_quality.train(docs, some))
        assert scored.count() == len(CASES) and scored.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    found = byte_cnn.identify(docs, byte_cnn.train(docs))
    assert found.where("lang_pred = 'und'").select("doc_id").distinct().count() == 4  # 4, 5, 8 and the null id
    assert byte_cnn.identified_only(docs, byte_cnn.train(docs), least=0.0).columns == docs.columns
    empty = docs.limit(0)
    assert toxicity.grade(empty, toxicity.train(empty, labels)).count() == mil_quality.score(empty, mil_quality.train(empty, labels)).count() == byte_cnn.identify(empty, byte_cnn.train(empty)).count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    rows = [(i, "aaaa " * 20 if zlib.crc32(str(i).encode()) % 4 == 2 else "bbbb " * 20, "secret" if zlib.crc32(str(i).encode()) % 4 == 2 else "known") for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r[0] for r in byte_cnn.identify(frame, byte_cnn.train(frame)).select("lang_pred").distinct().collect()} == {"known"}
    assert frame.select(F.count_if(~byte_cnn.may_learn(F.col("doc_id")))).first()[0] == sum(lang == "secret" for _, _, lang in rows)


def test_sample_is_the_least_by_hash(spark):
    from lodestrata.llm.common import bounded_sample

    docs = spark.range(0, 30000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 2).alias("y"))
    order = {c: [r[0] for r in docs.where(f"y = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()] for c in (0, 1)}
    got = sorted(bounded_sample(docs, docs, "doc_id", "text", "y", 20, 10**6, (0, 1, 2)).collect())
    assert [r[0] for r in got] == sorted(order[0] + order[1]) and all(t == str(i) and y == i % 2 for i, t, y in got)
    few = sorted(r[0] for r in bounded_sample(docs, docs, "doc_id", "text", "y", 20, 60).collect())  # characters run out
    want = []
    for ids in order.values():
        used = np.cumsum([len(str(i)) for i in ids])
        want += [i for i, u in zip(ids, used) if u <= 60]
    assert few == sorted(want) and len(few) < 40
    long = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("x"), 100)).otherwise(F.col("text")))
    assert {r[0] % 2 for r in bounded_sample(long, docs, "doc_id", "text", "y", 20, 900).collect()} == {1}  # the others are over a tenth
