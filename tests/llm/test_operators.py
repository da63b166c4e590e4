"""Operators on odd tables and against brute force."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlode.llm import cotrain, forest, jaccard, langid, media, mixing, pieces, sharding
from tests_llm_brute import brute_jaccard, words


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in done]
        left = total - sum(done.values())
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > epochs * sizes[s]]
        if not over:
            return done | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        done |= {s: epochs * sizes[s] for s in over}


def test_mix_of_odd_table(odd, clashing, empty):
    rows = mixing.mix(odd).collect()
    sizes = {}
    for r in odd.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    want = brute_targets(sizes)
    assert len(rows) == odd.count() and all(math.isclose(r.target, want[r.source], abs_tol=1e-6) for r in rows)
    assert all(r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"] for r in rows)
    key = lambda r: str((r.doc_id, r.source, r["size"], r.taken))
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(clashing).collect()))
    assert mixing.mix(empty).count() == 0


def test_mix_comes_near_its_targets_and_returns_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))), f"s{min(9, int(rng.expovariate(0.5)))}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 30 for s in taken)
    counts = {r.doc_id: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.repeats for r in got if r.repeats}
    assert mixing.mixed_documents(df).columns == df.columns


def test_salted_join_equals_broadcast(spark):
    from quarterlode.llm.common import salted_join

    big = spark.createDataFrame([(i, None if i % 7 == 0 else "a" if i % 3 else "b") for i in range(200)], "i long, k string")
    side = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    one, two = (sorted(map(str, salted_join(big, side, "k", F.xxhash64("i"), s, "left").collect())) for s in (True, False))
    assert one == two and len(one) == 200


# Sharding


def test_shards(odd, clashing, empty):
    leaves, grown = sharding.tree(16), sharding.tree(17)
    rows = sharding.shard(odd, leaves, grown=grown).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in rows) == sorted(str((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in odd.collect()) and texts
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(clashing, leaves, grown=grown).collect()))
    assert sharding.shard(empty, leaves).count() == 0


def test_shards_move_only_into_what_changed(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    for n in (16, 17, 20):
        rows = ids.select("doc_id", sharding.descend(F.col("doc_id"), sharding.tree(n)).alias("a"), sharding.descend(F.col("doc_id"), sharding.tree(n + 1)).alias("b")).collect()
        moved = [r for r in rows if r.a != r.b]
        assert {r.b for r in moved} == {n} and abs(len(moved) - 20_000 / (n + 1)) < 250
    heavy = tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in sharding.tree(16))
    rows = ids.select(sharding.descend(F.col("doc_id"), sharding.tree(16)).alias("a"), sharding.descend(F.col("doc_id"), heavy).alias("b")).where("a <> b").collect()
    assert all(r.b // 8 == 0 for r in rows) and sum(r.b == 5 for r in rows) > 1000
    got = sharding.shard(ids, sharding.tree(16)).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("d")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in got)


# Media


def test_media_round_trip(spark, odd, empty):
    texts = {r.doc_id: r.text for r in odd.where("doc_id is not null").collect()}
    stored = media.text_media(odd.select("doc_id", "text")).collect()
    for r in stored:
        found = media.scan(bytes(r.content))
        raw = (texts.get(r.doc_id) or "").encode() if r.doc_id is not None else None
        assert found[0][1:] == (0, len(r.content))
        payload = media.unpack(found[0][0], bytes(r.content))
        assert len(payload) % 64 == 0 and len(payload) > 0 and (raw is None or payload.rstrip(b"\0") == raw.rstrip(b"\0") and len(payload) == (len(raw) + 63) // 64 * 64 + 64 * (not raw))
    assert media.text_media(empty.select("doc_id", "text")).count() == 0


def test_sniffing_corrects_types_and_carves(spark):
    payload = bytes(range(64)) * 3
    made = {k: f(payload) for k, f in media.PACK.items()}
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x02\x44\x01\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x11\xff\x00\x22\xff\xd9"
    zipped = b"PK\x03\x04" + b"x" * 10 + b"PK\x05\x06" + b"\0" * 8 + struct.pack("<IIH", 0, 14, 0)
    rows = [("text/plain", v, k, 1) for k, v in made.items()] + [("image/gif", gif, "image/gif", 1), ("image/png", jpeg, "image/jpeg", 1), (None, zipped, "application/zip", 1)]
    rows += [("image/png", made["image/png"][:-3], media.UNKNOWN, 0), ("text/plain", b"RIFF and BM and PK", "text/plain", 0), ("x", b"\xff\xfejunk" + made["audio/wav"] + b"\x80" + gif, media.UNKNOWN, 2), ("text/plain", b"", "text/plain", 0), ("x", None, None, 0)]
    df = spark.createDataFrame([(i, r[0], r[1], "own") for i, r in enumerate(rows)], "i int, declared string, content binary, media string")
    for r in media.sniff(df).collect():
        declared, content, kind, n = rows[r.i]
        assert r.true_type == kind and len(r.media) == n and r.corrected == (None if content is None else kind != declared), (r.i, r.true_type)
        assert all(bytes(m.data) == content[m.start : m.start + m.length] for m in r.media)


def test_media_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", "x", "é" * 40, "y" * 64, "z" * 65, "BM and RIFF GIF89a", "x", "w " * 40_000]
    rows = [(i, t, "own") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, content string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op3_media(spark, str(tmp_path)).collect()}
    pack = {"audio/wav": media.pack_wav, "image/bmp": media.pack_bmp, "image/x-portable-graymap": media.pack_pgm, "image/png": media.pack_png}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        payload = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        stored = pack[r.feature.split(";")[0]](payload)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want, i
    assert len(got) == len(texts) and got[2][1:] == got[7][1:]


def test_stored_texts_with_clashing_columns(spark, odd, clashing):
    own = clashing.withColumns({c: F.lit("own") for c in ("n_bytes", "declared", "content")})
    made = media.text_media(own)
    assert made.columns == [*(c for c in clashing.columns if c != "text"), "n_bytes", "declared", "content"]
    assert sorted(bytes(r.content) for r in made.collect()) == sorted(bytes(r.content) for r in media.text_media(odd.select("doc_id", "text")).collect())
    assert media.sniff(made).where("corrected and size(media) = 1").count() == odd.count()
    renamed = media.text_media(odd.select("doc_id", F.col("text").alias("content")), text="content")
    assert renamed.columns == ["doc_id", "n_bytes", "declared", "content"] and renamed.where("n_bytes > 0").count() > 0


@pytest.mark.parametrize("piece", [b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff\xda\x00\x02", b"GIF89a!!!!!!!!", b"\x89PNG\r\n\x1a\n", b"RIFF", b"BM", b"OggS\0"])
def test_payloads_full_of_signatures_take_linear_time(piece):
    import time

    begin = time.process_time()
    assert media.scan(piece * (1_000_000 // len(piece))) in ([], media.scan(piece * (1_000_000 // len(piece))))
    assert time.process_time() - begin < 20


# Languages


def test_languages(spark, sf_dir, odd, clashing, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify(docs.where(langid.held_out(F.col("doc_id"))), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97 and all(0 <= r.score <= 1 for r in rows)
    found = langid.identify(clashing, model)
    assert found.columns == [*[c for c in clashing.columns if c != "score"], "lang_pred", "score", "lang_sure"]
    for r in found.collect():
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


# Pieces


def test_pieces_equal_the_library(spark, sf_dir, odd, clashing, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    extra = [("  a  b " * 5,), ("\r\n\t\x0b",), ("\U0001f9ff" * 30,), ("é" * 3000,), ("　x　",), ("a▁b ▁ c",), ("<0x41></s><unk>",), ("Ⱥ" + " " * 200 + "z",), ("\x00\x01 \x7f",), (None,)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").union(odd.select("text")).union(spark.createDataFrame(extra, "text string"))
    for r in pieces.encode(docs, pieces.default_model()).collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.piece_ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids), r.text
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert pieces.encode(empty, pieces.default_model()).count() == 0
    assert pieces.encode(clashing, pieces.default_model(), ids=False).where("n_tokens > 1").count() == odd.count()


# Jaccard join


def near_copies(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghklm" for b in ("ab", "ed", "in", "O", "ús")]
    common, texts = [rng.choice(vocabulary) for _ in range(60)], []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 8, 12, 30, 80, 200)))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = common
        for _ in range(rng.choice((1, 1, 2, 6, 15))):
            copy = base[:]
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True)) + [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, texts[0]), (20_003, texts[0])]


@pytest.mark.parametrize("seed, size, percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_jaccard_equals_brute_force(spark, seed, size, percent):
    rows = near_copies(seed)
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute_jaccard(rows, size, percent)))


def test_jaccard_odd_tables(odd, clashing, empty):
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jaccard.join_components(odd).collect())
    assert got == sorted(map(str, brute_jaccard([(r.doc_id, r.text) for r in odd.collect()], 5, 80)))
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.where("doc_id in (1, 2)").collect()) == [1]
    assert jaccard.join_components(empty).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_one_document_of_each_group_stays(spark, seed):
    rng = random.Random(seed)
    rows = near_copies(seed, 150)
    rows = [(rng.choice(range(60)), t) for _, t in rows] + [(1, rows[0][1]), (2, rows[0][1]), (2, "quite another text of six words"), (5, rows[0][1]), (5, rows[0][1]), (None, "a text without an id of words"), (7, None), (7, None), (7, "")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, f"own {i}") for i, (d, t) in enumerate(rows)], "doc_id long, text string, node string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(df, size=3, percent=70).collect()]
    # Groups by links of whole rows, not by ids.
    marked = [((i, d), t) for i, (d, t) in enumerate(rows)]
    group = {i: c for (i, _), (_, _, c) in zip((m[0] for m in marked), brute_jaccard([(i, t) for i, (_, t) in enumerate(rows)], 3, 70))}
    groups = {}
    for i, (d, t) in enumerate(rows):
        if words(t):
            groups.setdefault(group[i], []).append((d, t))
    assert sum(not words(t) for _, t in got) == sum(not words(t) for _, t in rows)
    kept = [(d, t) for d, t in got if words(t)]
    assert len(kept) == len(groups)
    for own in groups.values():
        mine = [x for x in kept if x in own]
        assert len(mine) == 1 and mine[0][0] == min((d for d, _ in own), key=lambda d: (d is None, d or 0))


def test_hot_keys_change_nothing(spark, monkeypatch):
    rows = near_copies(7, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "HOT_TIMES", 2)
    got = jaccard.join_components(df, size=4, percent=85).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute_jaccard(rows, 4, 85)))


def test_weak_sets_are_found_by_their_shingles(spark):
    rows = near_copies(4, 80)
    src = spark.createDataFrame(rows, "doc_id long, _text string")
    sets = {r.doc_id: r for r in jaccard.join_components(src, text="_text", size=3, percent=70).collect()}
    base = spark.createDataFrame([(r.doc_id, r.n_shingles, r.set_id, r.n_shingles > 0) for r in sets.values()], "doc_id long, n_shingles long, set_id long, weak boolean")
    found = {(r.a, r.b) for r in jaccard._weak_pairs(src, base, 3, 70).collect()}
    text = {d: words("".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) for d, t in rows}
    shingles = {d: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for d, w in text.items() if len(w) >= 3}
    linked = {tuple(sorted((sets[x].set_id, sets[y].set_id))) for x, y in itertools.combinations(shingles, 2) if sets[x].set_id != sets[y].set_id and 100 * len(shingles[x] & shingles[y]) >= 70 * len(shingles[x] | shingles[y])}
    assert linked and linked <= found
    assert jaccard._weak_pairs(src, base.withColumn("weak", F.lit(False)), 3, 70) is None


# Embeddings


def test_forest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 32))
    x[300:600] = x[:300] + 0.2 * rng.standard_normal((300, 32))
    x[600:700] = x[0] + 0.15 * rng.standard_normal((100, 32))
    x[700:720] = x[5] * np.arange(1, 21)[:, None]
    x[720:760] = x[720]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(50):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    odd = [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [float("nan")] + [1.0] * 31), (5004, [None] + [1.0] * 31), (5005, [float("inf")] * 32), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "leaf": F.lit("x"), "v": F.lit(2)})
    got = {r.vec_id: r for r in forest.near_duplicates(df, leaf_rows=100).collect()}
    assert len(got) == len(x) + len(odd)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist() and [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(5000, 5006)) and got[5007].component_id == 5006 and not got[5007].kept
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_finds_the_pairs_of_a_dense_group(spark):
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, group = unit(rng.standard_normal(64)), 1200  # more than ten leaves
    x = unit(np.concatenate([0.93**0.5 * centre + 0.07**0.5 * unit(rng.standard_normal((group, 64))), rng.standard_normal((2400, 64))]))
    x[group : group + 200] = unit(x[-200:] + 0.045 * rng.standard_normal((200, 64)))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(df, leaf_rows=100).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all()
    assert found[:group].sum() == near[:group].sum() and found[group:].sum() >= 0.995 * near[group:].sum()


def test_forest_recall_with_its_own_parameters(spark):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, planted = 24_000, 3_000
    x = unit(rng.standard_normal((n, 64)))
    noise = unit(rng.standard_normal((planted, 64)) - 0)
    noise = unit(noise - (noise * x[:planted]).sum(1, keepdims=True) * x[:planted])
    cosine = rng.uniform(0.902, 0.93, (planted, 1))
    x[-planted:] = cosine * x[:planted] + np.sqrt(1 - cosine**2) * noise
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>").repartition(8)
    got = {r.vec_id: r for r in forest.near_duplicates(df).collect()}
    x = unit(x.astype(np.float32).astype(np.float64))
    links = np.zeros(n, int)
    for at in range(0, n, 2_000):
        links[at : at + 2_000] = (x[at : at + 2_000] @ x.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum() and links.sum() >= 2 * planted
    assert all(got[n - planted + i].component_id <= i for i in range(planted) if found[n - planted + i])


# Classifier


def test_labelled_documents_are_in_no_round(spark):
    """Counts of what the rounds saw against brute force: every document outside the labelled sample, each once."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("quality is not null").select("doc_id").distinct()
    model = cotrain.fit(docs, labels, rounds=0)
    given = cotrain._round(docs, known, model, "text")
    rest = docs.join(known, "doc_id", "left_anti").toArrow()
    own = cotrain.text_view(rest["text"].combine_chunks()), cotrain.metadata_view(*(rest[c].to_pylist() for c in ("lang", "source", "n_chars")))
    p = cotrain.sigmoid(model.logits(own))
    for v in (0, 1):
        for label, sure in ((1.0, p[:, 1 - v] >= cotrain.SURE), (0.0, p[:, 1 - v] <= 1 - cotrain.SURE)):
            mine = [] if given[v] is None else given[v][2][given[v][1] == label]
            assert sum(mine) == sure.sum()
            if sure.sum():
                x = given[v][0][given[v][1] == label]
                assert np.allclose((x * np.array(mine)[:, None]).sum(0), own[v][sure].sum(0), rtol=1e-4, atol=1e-3)


def test_repeated_labels_and_ids(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (6, 0), (None, 1), (8, None)], "doc_id long, quality int")
    hashes, y, *_ = cotrain._labelled(odd, labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label")).withColumn("h", F.xxhash64("doc_id", F.lit(17))), "text")
    assert len(hashes) == 3 and sorted(y) == [0.0, 1.0, 1.0]


def test_cotraining(spark, odd, clashing, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    third = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    model = cotrain.fit(docs.where(~third), labels.where(~third))
    rows = cotrain.score(docs.where(third), model).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) >= 0.9
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.97
    scored = cotrain.score(clashing, model)
    assert scored.columns == [*clashing.columns, "kept"]
    assert all((r.score > 0) == bool(words(r.text)) for r in scored.collect())
    assert cotrain.score(empty, model).count() == 0
    none = cotrain.fit(odd, labels.limit(0))
    assert none.views is None and cotrain.score(odd, none).where("kept").count() == sum(bool(words(r.text)) for r in odd.collect())


def test_mix_with_keys_far_from_uniform(spark):
    """A source of poor quality keeps its order and budget, whatever its keys look like."""
    rng = random.Random(8)
    rows = [(i, "; ".join(f"{rng.randint(0, 99)},{rng.randint(0, 9)}" for _ in range(rng.randint(1, 20))), "table") for i in range(4000)] + [(5000 + i, "plain words here", "prose") for i in range(300)] + [(9000, "same ; row 1", "table")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.decide(df, epochs=1, share=0.4).collect()
    for source in ("table", "prose"):
        own = sorted((r for r in got if r.source == source), key=lambda r: (r.key, r.doc_id, r["size"]))
        before = 0
        for r in own:
            assert r.chosen == (before + r["size"] / 2 <= r.rest), r
            before += r["size"]
    assert 100 < sum(r.chosen for r in got if r.source == "table") < 3950


def plain_costs(text, model):
    import re

    import zstandard as z

    clean = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    out = {}
    for name, parts in model.items():
        total = 0
        for d in parts:
            c = z.ZstdCompressor(level=7, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            total += sum(len(c.compress(clean[i : i + langid.PIECE].encode())) for i in range(0, len(clean), langid.PIECE)) / len(parts)
        out[name] = total
    return out


def test_languages_equal_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("text", "my text")
    model = langid.fit(docs, text="my text")
    got = {r.doc_id: r for r in langid.identify(docs, model, text="my text").collect()}
    assert len(model) >= 3 and langid.identify(docs, model, text="my text").columns[: len(docs.columns)] == docs.columns
    for doc_id, text in ((r.doc_id, r["my text"]) for r in docs.collect()):
        if text is None or not any(map(str.isalpha, text)):
            assert got[doc_id].lang_pred == "und" and got[doc_id].score == 0
            continue
        order = sorted((c, name) for name, c in plain_costs(text, model).items())
        assert got[doc_id].lang_pred == order[0][1] and math.isclose(got[doc_id].score, (order[1][0] - order[0][0]) / order[1][0])


def test_segments_with_byte_pieces_that_decode_to_themselves_take_the_short_way():
    known = pieces.Pieces(pieces.default_model())
    text = "a \U00012345 b ▁c  " + "x\U00012345" * 60
    parts = pieces.segments_of(text)
    known.prepare([parts])
    ids = known.library.encode(text, add_bos=True, add_eos=True)
    assert known.text_ids(parts) == (b"".join(i.to_bytes(4, "little") for i in ids), known.library.decode(ids)) and not known.odd
