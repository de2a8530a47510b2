"""Brute-force versions, round trips and odd inputs of the training-data operators."""

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltadoc.llm import bitplane, dartminhash, langid, media, mixing, packing, permindex, quality, tokens, urltree, warc

ODD = [(1, "Hello, world. It's fine."), (2, None), (3, ""), (4, "x " * 30000), (5, "ß É 日本語 İ ΑΣ."), (5, "again"), (None, "no id"), (6, "Hello, world. It's fine.")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, None if k == 3 else f"s{k % 2}", "kept") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def plain_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_equal_the_tokenizers():
    letters = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", *"aAé'.,!_1 2\n\tİßſΣ́$#-"]
    rng = random.Random(3)
    assert plain_ids("hello <|endoftext|> world") == [3306, 49407, 1002, 2]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t for _, t in ODD]
    encode = tokens.Encoder(tokens.vocabulary_path(), cache_pieces=500)
    for a in range(0, len(texts), 200):
        for text, got in zip(texts[a : a + 200], encode(texts[a : a + 200])):
            assert np.frombuffer(got, "<u4").tolist() == plain_ids(text), text


# 1: packing


def test_first_fit_decreasing_equals_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if k == len(room):
                room.append(100)
            want[i] = (k, 100 - room[k])
            room[k] -= sizes[i]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(sizes))]


def test_pack_places_each_id_once(odd, none):
    rows = packing.pack(packing.pieces(odd), group_pieces=4).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    for i, t in ODD:
        ids = np.array(plain_ids(t), "<u4")
        at = 0
        for start, length, crc in sorted(by_doc[i, len(ids)]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert packing.pack(packing.pieces(none)).count() == 0


# 2: Ogg


def test_ogg_round_trip_and_damage():
    rng = np.random.default_rng(2)
    for frames in [*range(1, 45), 339, 340, 341, 700]:
        payload = rng.bytes(192 * frames)
        assert media.decode(media.encode(payload)) == payload
    data = bytearray(media.encode(rng.bytes(192 * 2000)))
    whole = media.demultiplex(bytes(data))
    assert [len(s.packets) for s in whole.values()] == [26, 26] and not any(s.lost for s in whole.values())
    assert all(b - a == len(p) for s in whole.values() for a, b, p in zip(s.starts(), s.ends, s.packets) if b is not None)
    data[100_000] ^= 1
    hurt = media.demultiplex(bytes(data))
    assert sorted(s.lost for s in hurt.values()) == [0, 1] and sum(len(s.packets) for s in hurt.values()) < 52
    with pytest.raises(ValueError):
        media.decode(bytes(data))
    with pytest.raises(ValueError):
        media.decode(b"")


def test_ogg_checksum_is_the_bitwise_one():
    def slow(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
        return crc

    for data in (b"", b"OggS", bytes(range(256))):
        assert media.checksum(data) == slow(data)


def test_media_columns(odd, none, spark):
    rows = media.from_media(media.to_media(odd)).collect()
    assert len(rows) == len(ODD) and not any(r.error for r in rows)
    equal = [(r.media_sha256, r.feature, r.payload_sha256) for r in rows if r.doc_id in (1, 6)]
    assert equal[0] == equal[1]
    assert {r.payload_bytes for r in rows if r.n_bytes == 0} == {192}
    assert media.to_media(none).count() == 0
    bad = spark.createDataFrame([(1, 2, None), (2, 2, bytearray(b"OggS"))], "doc_id long, n_bytes long, media binary")
    assert [bool(r.error) for r in media.from_media(bad).collect()] == [True, True]


# 3: WARC


def test_warc_records_are_linked():
    page = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One</p><p>Two <b>three</b></p><a href='/x'>L</a><script>no</script></body></html>"
    source = warc.response("http://h/p", page)
    meta, text, _ = warc.derive(next(warc.read_records(bytes(source))))
    its = source.get("WARC-Record-ID")
    assert meta.get("WARC-Refers-To") == text.get("WARC-Refers-To") == its and meta.get("WARC-Concurrent-To") == text.get("WARC-Record-ID")
    assert text.block.decode().split("\n") == ["One", "Two three", "L"]
    fields = meta.block.decode().split("\r\n")
    assert "title: A & B" in fields and "outlink: /x" in fields and f"source-payload-digest: {source.get('WARC-Payload-Digest')}" in fields
    assert "http-header-content-type: text/html; charset=utf-8" in fields
    for r in (meta, text):
        again = next(warc.read_records(r.compressed()))
        assert again.block == r.block and again.get("WARC-Block-Digest") == warc.digest(r.block)
    both = list(warc.read_records(meta.compressed() + text.compressed()))
    assert [r.get("WARC-Type") for r in both] == ["metadata", "conversion"]
    with pytest.raises(ValueError):
        list(warc.read_records(bytes(source)[:-40]))


def test_warc_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "u", "<p>" + "x" * 100000), (3, "u", "a\nb")], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 8 and not any(r.error for r in rows)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "page_id long, record binary")
    assert all(r.error for r in warc.derivatives(bad).collect())


# 4 and 5: models


def test_langid_held_out(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.fit(docs)
    rows = langid.identify(docs, net).where(langid.held_out("doc_id", 4, 2)).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    found = {(r.doc_id, r.text): r for r in langid.identify(odd, net).collect()}
    assert found[2, None].lang_pred == found[3, ""].lang_pred == "und" and len(found) == len(ODD)
    assert langid.identify(none, net).count() == 0
    assert langid.fit(none).predict(["text", None]) == [("und", 0.0)] * 2


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    net = langid.train(rng.integers(0, 256, (40, 32), dtype=np.uint8), rng.integers(0, 2, 40), ["a", "b"], epochs=1)
    x = rng.integers(0, 256, (5, 32), dtype=np.uint8)
    want = []
    for w, kernel in net.kernels.items():
        acc = np.stack([sum(net.embedding[x[:, i + k]] @ kernel[k] for k in range(w)) for i in range(32 - w + 1)], axis=1) + net.biases[w]
        want.append(acc.max(axis=1))
    assert np.allclose(net.answers(x), np.maximum(np.concatenate(want, axis=1), 0), atol=1e-4)


def test_gradients_are_the_losses():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 256, (6, 20), dtype=np.uint8), rng.integers(0, 3, 6)
    net = langid.train(x, y, ["a", "b", "c"], epochs=0, filters=4)
    for p in net.params():
        p[...] = rng.normal(0, 0.5, p.shape)

    def loss():
        net._tables = None
        return -np.log(net.probabilities(x)[np.arange(6), y]).mean()

    got = langid._gradients(net, x, y, np.ones(6, np.float32))
    for p, g in zip(net.params(), got):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        assert abs((up - loss()) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3
        p[at] = old


def test_quality_held_out(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality.fit(docs, labels)
    rows = quality.score(docs, ranker).join(labels, "doc_id").where(quality.held_out("doc_id", 3, 1)).collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert quality.score(odd, ranker).count() == len(ODD) and quality.score(none, ranker).count() == 0
    assert all(r.score == 0.5 and r.predicted == 1 for r in quality.score(odd, quality.fit(docs, labels.limit(0))).collect())


def test_pairwise_loss_is_at_its_least():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, len(quality.MEASURES)))
    label = (x[:, 0] + rng.normal(0, 0.5, 200) > 0.5).astype(int)
    r = quality.bradley_terry(x, label)
    u = r.strengths(x)
    assert abs((u < r.threshold).mean() - (label == 0).mean()) < 0.01 and u[label == 1].mean() > u[label == 0].mean()


# 6: search


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [1.0]), (9005, [None] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = permindex.usable(table).cache()
    assert use.count() == 1500
    got = {}
    for r in permindex.nearest(use, use.where("vec_id % 20 = 0"), k=20, block_rows=500, group_rows=40, least=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q, found in got.items():
        score = np.einsum("ij,j->i", x, x[q])
        score[q] = -np.inf
        want = sorted(range(1500), key=lambda i: (-score[i], i))[:20]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-9 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(want))
    assert len(got) == 75 and hit / 1500 >= 0.9
    assert permindex.nearest(use.limit(0), use.limit(0)).count() == 0


# 7: URLs


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/1", "https://x.net?q", "no scheme", None, "http://example.com/de/5#t", "http://notexample.com/de/5", "https://b.org/fr/1", "http://c.org/en/", "u://net/", "http://é.COM/a/b/c/d/e/f"]
    rows = {r.page_id: r for r in urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (rows[1].host, rows[1].path, rows[1].rule) == ("x.net", "", None)
    assert (rows[2].host, rows[2].path, rows[3].host, rows[3].path) == ("", "", "", "")
    assert [rows[k].rule for k in (4, 5, 6, 7, 8)] == ["example.com/de/", None, "org/fr/", None, "net/"]
    assert len(rows) == len(urls) and rows[9].template == "/*/*/*/*/*/*"


def test_impure_templates_are_rejected(spark):
    urls = [(k, f"http://h.com/{'ads' if k % 2 else 'news'}/{k}") for k in range(60)] + [(100 + k, f"http://g.com/{'abc'[k % 3]}/{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "page_id long, bad int")
    rows = {r.page_id: r for r in urltree.judge(spark.createDataFrame(urls, "page_id long, url string"), rules=(), labels=labels).collect()}
    assert all(rows[k].verdict == ("block" if k % 2 else "allow") for k in range(60))
    assert rows[1].template == "/ads/<n>" and len({rows[100 + k].template for k in range(60)}) == 1
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# 8: near copies


def brute_classes(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, docs[0][1].upper())]
    got = {r.doc_id: r.class_id for r in dartminhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(docs)


def test_near_copies_odd_rows(odd, none):
    rows = dartminhash.near_copies(odd).collect()
    assert len(rows) == len(ODD) and {r.class_id for r in rows if r.doc_id in (1, 6)} == {1} and [r.class_id for r in rows if r.doc_id is None] == [None]
    assert dartminhash.near_copies(none).count() == 0


def test_weighted_signatures_agree_as_weighted_jaccard():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    element = dartminhash.mix(np.arange(60, dtype=np.uint64)) & np.uint64((1 << 48) - 1)
    doc = np.repeat([0, 1], 60)
    weight = np.concatenate([a, b]).astype(float)
    keep = weight > 0
    same = [(s[0] == s[1]).mean() for s in (dartminhash.throw(doc[keep], np.tile(element, 2)[keep], weight[keep], 2, seed=k) for k in range(1, 40))]
    assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


# 9: planes


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(9)
    docs = [(k if k % 5 else None, rng.integers(0, 49408, n).astype("<u4").tobytes()) for k, n in enumerate([1, 0, 300, 7, 64, 65, 1000, 2])]
    writer = bitplane.ShardWriter(3, 11, mode, block_ids=64)
    for d in docs:
        writer.add(*d)
    shard = bitplane.ShardReader(writer.finish())
    assert [(i, x.tobytes()) for i, _, x in shard.documents()] == docs
    whole = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    for a, b in ((0, 0), (0, 1), (63, 65), (100, 1200), (0, len(whole))):
        assert shard.ids(a, b).tolist() == whole[a:b].tolist()
    hurt = bytearray(bitplane.ShardReader(writer.finish())._data)
    hurt[40] ^= 255
    with pytest.raises(Exception):
        [*bitplane.ShardReader(bytes(hurt)).documents()]


def test_shards_keep_order(odd, none, spark, tmp_path):
    for n, path in ((odd, tmp_path / "a"), (none, tmp_path / "b")):
        made = bitplane.write_shards(n, str(path), shard_ids=3000).collect()
        if n is none:
            assert made == []
            continue
        rows = bitplane.read_shards(spark, str(path)).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    rows.sort(key=lambda r: (r.part, r.first_id))
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == [(i, plain_ids(t)) for i, t in order]


# 10: mixing


def brute_mix(docs, block=mixing.BLOCK):
    import hashlib
    import math
    import re

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, d in zip(size, docs) if d[2] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, 1.5 * sum(size), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * own[s]}
        for s in full or open_:
            target[s] = 2.0 * own[s] if s in full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    total = sum(target.values())
    edges, at = [], 0.0
    for s in names:
        edges.append((at / total, (at + target[s]) / total, s))
        at += target[s]
    times, rank = {}, {s: 0 for s in names}
    for slot in range(1, int(1.05 * 1.5 * sum(size) / block) + 50 * (len(names) + 1) + 1):
        u = slot * mixing.GOLDEN % 1
        s = next((s for a, b, s in edges if a <= u < b), names[-1])
        if rank[s] < math.floor(target[s] / block + 0.5):
            k = rank[s] % math.ceil(own[s] / block)
            times[s, k] = times.get((s, k), 0) + 1
        rank[s] += 1
    taken = {}
    for s in names:
        line = sorted((hashlib.md5(f"{i}:7".encode()).hexdigest(), n, i) for n, (i, _, t) in zip(size, docs) if t == s)
        at = 0
        for _, n, i in line:
            taken[i] = sum(times.get((s, w // block), 0) for w in range(at, at + n))
            at += n
    return {i: (n, own[s], target[s], taken[i]) for n, (i, _, s) in zip(size, docs)}


def test_mix_equals_brute_force(spark):
    rng = random.Random(10)
    docs = [(k, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(300)]
    want = brute_mix(docs, 16)
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block=16, chunk_rows=20).collect()}
    assert {i: (r.size, r.source_size, r.taken) for i, r in got.items()} == {i: (a, b, d) for i, (a, b, _, d) in want.items()}
    assert all(abs(got[i].target - t) < 1e-6 for i, (_, _, t, _) in want.items())
    assert all(r.taken <= 2 * r.size for r in got.values())


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(none).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = p.by_quality(spark, docs, sf_dir).cache()
    ranker = quality.fit(docs, labels)
    want = {r.doc_id for r in docs.collect() if ranker.scores(np.array([quality.measures(r.text)]))[0] >= 0.5}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    spoken = p.by_language(spark, good, sf_dir).cache()
    net = langid.fit(good)
    keep = {r.doc_id for r in good.collect() if (f := net.predict([r.text])[0])[0] != "und" and f[1] >= p.LEAST_LANGUAGE}
    assert {r.doc_id for r in spoken.collect()} == keep and spoken.columns == docs.columns
    lone = p.without_copies(spark, spoken, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in spoken.collect()]
    assert sorted(r.doc_id for r in lone.collect()) == sorted(set(brute_classes(rows).values())) and lone.columns == docs.columns
    mixed = p.mixed(spark, lone, sf_dir).cache()
    taken = brute_mix([(r.doc_id, r.text, r.source) for r in lone.collect()])
    want = sorted(i for i, (n, _, _, t) in taken.items() for _ in range(int(t / max(n, 1) + 0.5)))
    assert sorted(r.doc_id for r in mixed.collect()) == want and mixed.columns == docs.columns
    packed = p.packed(spark, mixed, sf_dir).collect()
    assert sum(r.length for r in packed) == sum(len(plain_ids(r.text)) for r in mixed.collect())


def test_pipeline_odd_rows(spark, sf_dir):
    import corpus_pipeline as p

    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some plain words here", "en", None, 5), (3, "some plain words here", "en", None, 5), (None, "no id at all", "fr", "b", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (rows, rows.limit(0)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= 2 * docs.count()
        assert p.STAGES[-1][1](spark, docs, sf_dir).count() >= 0


def test_slices_cover_all_rows():
    texts = pa.array(["a" * n for n in (5, 0, 30, 2, 2, 2)] + [None])
    parts = list(tokens.slices(texts, 6))
    assert [x for _, _, t in parts for x in t] == texts.to_pylist() and parts[-1][1] == len(texts)


def test_queries_on_tables(spark, sf_dir):
    from deltadoc.llm.queries import QUERIES

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_ogg", "op4_langid", "op5_quality", "op8_dartminhash", "op9_bitplane", "op10_mixing"):
        rows = QUERIES[name](spark, sf_dir)
        assert rows.select("doc_id").distinct().count() == n, name
    starts = QUERIES["op9_bitplane"](spark, sf_dir).orderBy("doc_id").collect()
    at = 0
    for r in starts:
        assert r.start == at
        at += r.n_tokens
    mixed = QUERIES["op10_mixing"](spark, sf_dir).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 2 * mixing.BLOCK for r in mixed)
