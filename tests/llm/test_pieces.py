"""Parts of the operators without Spark, against brute force and round trips."""

import io
import zlib

import numpy as np
import pytest

from lodestrata.llm import bbit_minhash, byte_cnn, dp_packing, html_extract, mil_quality, png_media, token_shards, toxicity, warc_zstd


def test_png_round_trips_and_notices_damage():
    rng = np.random.default_rng(0)
    for n in (0, 1, 64, 65, 9000):
        text = "".join(rng.choice(list("ab é\n€"), n))
        size, payload = png_media.payload_of(text)
        media = png_media.encode(payload)
        assert size == len(text.encode()) and len(payload) % 64 == 0 and len(payload) >= 64
        assert png_media.decode(media).tobytes() == payload
        assert len(png_media.cosine_hash(png_media.decode(media))) == 16
    broken = bytearray(media)
    broken[60] ^= 1
    for bad in (bytes(broken), media[:-5], media + b"x", b"", b"not a png at all"):
        with pytest.raises((ValueError, zlib.error)):
            png_media.decode(bad)


def test_png_reader_undoes_all_filters():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (12, 9)).astype(np.uint8)
    kinds = [0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 4]
    raw = np.zeros((12, 10), np.uint8)
    for r, kind in enumerate(kinds):
        up = want[r - 1].astype(int) if r else np.zeros(9, int)
        x = want[r].astype(int)
        left, corner = np.concatenate([[0], x[:-1]]), np.concatenate([[0], up[:-1]])
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        raw[r, 0], raw[r, 1:] = kind, (x - guess) % 256
    assert (png_media.unfiltered(raw) == want).all()


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        got = token_shards.feistel(np.arange(n), n)
        assert sorted(got.tolist()) == list(range(n))
    assert (token_shards.feistel(np.arange(1000), 1000, 1) != token_shards.feistel(np.arange(1000), 1000, 2)).any()


def test_cuts_are_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 9))])
        pen = rng.integers(0, 5, len(at)).astype(float)
        pen[-1] = 0
        window = 8
        best = {0: 0.0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + window - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= window)
        cuts = [0, *dp_packing.best_cuts(at, pen, window)]
        assert all(at[b] - at[a] <= window for a, b in zip(cuts, cuts[1:]))
        assert sum(window - (at[b] - at[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) == pytest.approx(best[len(at) - 1])


def test_packer_gives_every_id_once():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 999, n).astype(np.int32) for n in (1, 5, 3000, 1, 1, 700, 40, 9000, 2)]
    packer = dp_packing.Packer(window=64, block=512)
    rows = []
    for k, ids in enumerate(docs):
        rows += packer.add(k, ids, np.arange(7, len(ids), 7))
    rows += packer.finish()
    for k, ids in enumerate(docs):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        assert b"".join(r[7] for r in own) == ids.astype("<u4").tobytes()
        assert [r[1] for r in own] == np.cumsum([0, *[r[2] for r in own]])[:-1].tolist() and {r[4] for r in own} == {len(ids)}
    by = {}
    for r in rows:
        assert r[6] == by.get(r[5], 0)
        by[r[5]] = r[6] + r[2]
    pad = sum(64 - n for n in by.values() if n & (n - 1))
    assert max(by.values()) <= 64 and pad < 0.06 * sum(map(len, docs))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    sign = bbit_minhash.Signer()
    base = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    other = np.unique(np.concatenate([base[:810], rng.integers(0, 2**63, 90).astype(np.uint64)]))
    (a, x), (b, y) = sign(base), sign(other)
    assert set(a) & set(b)
    d = np.array(x, np.int64).view(np.uint64) ^ np.array(y, np.int64).view(np.uint64)
    unlike = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum()
    estimate = ((1 - unlike / bbit_minhash.HASHES) - 0.25) / 0.75
    assert abs(estimate - len(np.intersect1d(base, other)) / len(np.union1d(base, other))) < 0.15


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>Home</a></nav>
    <div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>First   line of the text.<br><p>Second &lt;part&gt;
    of it.</p><div class="share-links">Share</div><form><input><button>Go</button></form><p>Third.<!-- gone -->
    <section class="comments"><p>I disagree.</p></section></article><aside>Other</aside><footer>&copy; 2020 The end</footer>"""
    assert html_extract.main_text(page) == "Head & more\nFirst line of the text.\nSecond <part> of it.\nThird."
    long = "The house of the man was on the hill and it was for all that he had been in it not a good one. " * 3
    plain = f"<html><body><ul><li><a href=a>one</a><li><a href=b>two</a></ul><p>{long}<p>Short one here.<p>{long}<div id=footer>the and of to in it is</div>"
    assert html_extract.main_text(plain) == "\n".join([long.strip(), "Short one here.", long.strip()])
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""
    assert html_extract.main_text("<article><script>x") == ""


def test_archive_round_trip_and_damage():
    pages = [(i, f"http://x/{i}\r\n", (f"<p>page {i % 7}</p>" * 20).encode()) for i in range(60)]
    dictionary = warc_zstd.train_dictionary([p for _, _, p in pages] * 20)
    for d in (dictionary, b""):
        w = warc_zstd.Writer(d)
        for i, url, p in pages:
            import hashlib

            w.add(warc_zstd.record(i, url, p, hashlib.sha256(p).hexdigest(), i % 7 if i >= 7 else None))
        data = w.buffer.getvalue()
        got = [warc_zstd.parse(r) for r in warc_zstd.read(io.BytesIO(data), 64)]
        assert len(got) == 60 and [h["warc-type"] for h, _ in got] == ["response"] * 7 + ["revisit"] * 53
        assert [warc_zstd.page_of(h, b)[0] for h, b in got] == [len(p) for _, _, p in pages]
        with pytest.raises(warc_zstd.ArchiveError):
            list(warc_zstd.read(io.BytesIO(data[:-3])))
    raw = warc_zstd.record(1, None, b"x" * 200, "0" * 64, None)
    for bad in (raw[:-2], raw.replace(b"WARC/1.1", b"WARK/1.1"), raw.replace(b"xxx", b"xyx"), b""):
        with pytest.raises(warc_zstd.ArchiveError):
            warc_zstd.parse(bad)
    with pytest.raises(warc_zstd.ArchiveError):  # the payload's digest
        warc_zstd.page_of(*warc_zstd.parse(raw))


def test_small_classifiers_learn():
    rng = np.random.default_rng(5)
    mild = [" ".join(rng.choice(["house", "tree", "river", "stone", "field"], 30)) for _ in range(300)]
    texts = [m + (" vileword" * (1 + i % 5) if i % 2 else "") for i, m in enumerate(mild)]
    model = toxicity.fit(texts, [i % 2 for i in range(300)])
    score = model.scorer()
    assert score("a house vileword tree")[1] > 0.5 > score("a house and a tree")[1] and score(None)[1] < 0.5 and (np.diff(model.thresholds) >= 0).all()
    assert toxicity.fit(texts, [0] * 300).scorer()("vileword")[1] < 0.5
    good, bad = [" ".join(rng.choice(["Some", "words", "of", "prose."], 80)) for _ in range(60)], ["BUY!! $$$ ### NOW!! %%% " * 20 for _ in range(60)]
    m = mil_quality.fit(good + bad, [1] * 60 + [0] * 60, epochs=8)
    s = m.score([good[0], bad[0], None, ""])
    assert s[0] > 0.7 > 0.3 > s[1] and s[2] == s[3] and ((0 <= s) & (s <= 1)).all()
    de, en = ["der die das und ich nicht schön über straße " * 20] * 20, ["the and of with that this house tree river " * 20] * 20
    p = byte_cnn.fit(de + en, ["de"] * 20 + ["en"] * 20).predictor()
    assert [x for x, _ in p([de[0], en[0], None, "123 !", ""])] == ["de", "en", "und", "und", "und"]
