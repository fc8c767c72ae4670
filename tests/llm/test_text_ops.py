import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import LONG, documents, holds, rows
from pyspark.sql import functions as F

from tidebook.llm import fingerprint, jaccard_join, lang_id, license_scan, media, packing, queries, staging, toxicity, wordhash

SAMPLES = ["", None, "one", "a b c", "The the THE the the", "é ü\x0bß x\ny  z w", "ab\x1ccd ef gh ij kl", "w " * 9000]


def split(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def shingle_set(text, k):
    w = split(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_shingles_equal_split_words():
    rng = random.Random(1)
    texts = SAMPLES + [" ".join(rng.choice(["the", "and", "of", "To", "x"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    for k in (1, 4, 5):
        by_hash = {}
        for t, h in zip(texts, wordhash.shingles(texts, k), strict=True):
            w = split(t)
            seq = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
            assert len(h) == len(seq)
            for x, g in zip(h.tolist(), seq, strict=True):
                assert by_hash.setdefault(x, g) == g
        assert len(set(by_hash.values())) == len(by_hash)


# --- licences ---


def test_licences(spark):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code\nonly"), (3, "a/b/c/y.py", "Licensed under CC BY-NC 4.0.\ncode"), (4, "z/q.py", None), (5, "a/b/LICENSE", "nothing known"), (6, None, "")],
        "doc_id long, path string, text string",
    )
    got = {r["doc_id"]: (r["license"], r["kind"], r["license_dir"]) for r in license_scan.scan(files).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "a"), 3: ("CC-BY-NC-4.0", "header", None), 4: (None, "none", None), 5: ("MIT", "inherited", "a"), 6: (None, "none", None)}
    root = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b.c", "")], "doc_id long, path string, text string")
    assert {r["license_dir"] for r in license_scan.scan(root).where("doc_id = 2").collect()} == {""}


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.
"""


def test_licence_bodies_and_wrapped_headers(spark):
    body = {n: "Copyright (c) 2020 The Authors\n\n" + t for n, t in license_scan.BODIES}
    files = [(n, f"{n}/LICENSE", t) for n, t in body.items()] + [(n + " x", f"{n}/src/a.c", "int x;") for n in body]
    files += [("header", "h/a.py", "import os\n" + GPL_HEADER + "x = 1\n"), ("wrapped", "h/b.c", "/* Licensed under the\r\n * Apache License, Version 2.0.\r\n */"), ("prose", "p/LICENSE", "the permission of the king and of the people " * 40)]
    got = {r["doc_id"]: (r["license"], r["kind"]) for r in license_scan.scan(spark.createDataFrame(files, "doc_id string, path string, text string")).collect()}
    want = {n: (n, "file") for n in body} | {n + " x": (n, "inherited") for n in body}
    assert got == want | {"header": ("GPL-3.0", "header"), "wrapped": ("Apache-2.0", "header"), "prose": (None, "none")}


def test_no_plan_of_the_licence_scan_holds_several_steps(spark, monkeypatch):
    plans, cut = [], license_scan.cut
    monkeypatch.setattr(license_scan, "cut", lambda df, *a: (plans.append(df), cut(df, *a))[1])
    files = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", GPL_HEADER)], "doc_id long, path string, text string")
    plans.append(license_scan.scan(files))
    texts = [df._jdf.queryExecution().optimizedPlan().toString() for df in plans]
    assert max(len(re.findall(r"\b(?:Join|Aggregate|Generate|Window) ", t)) for t in texts) <= 10
    # Tables that grow with the input are merged, whatever the size of their files.
    assert sum("strategy=merge" in t for t in texts) == 2
    assert sum(t.count("strategy=broadcast") for t in texts) == 1


def test_licences_of_odd_rows(spark):
    holds(lambda d: license_scan.scan(license_scan.as_files(d)), documents(spark))


def test_every_template_is_its_own_best(spark):
    df = spark.createDataFrame([(t,) for _, t in license_scan.TEMPLATES], "line string")
    got = {r["line"]: r["best"] for r in license_scan.best_templates(df).collect()}
    assert {t: got[t]["license"] for _, t in license_scan.TEMPLATES} == {t: n for n, t in license_scan.TEMPLATES}
    assert all(abs(b["score"] - 1) < 1e-6 for b in got.values())


# --- languages ---


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.where("held_out")
    assert held.count() > 150
    assert held.where("lang_pred = lang").count() / held.count() > 0.97
    assert out.where("not held_out").count() + held.count() == docs.count()
    assert out.where("rejected and lang_pred = lang").count() <= 0.01 * docs.count()


def test_language_of_odd_rows(spark):
    model = lang_id.fit(["the cat and the dog went home", "le chat et le chien sont la"] * 20, ["en", "fr"] * 20)
    got = {r[0]: r for r in holds(lambda d: lang_id.identify(d, model), documents(spark))}
    assert all(got[i][1:3] == ("und", 0.0) and got[i][3] for i in (2, 3, 4, 6))
    assert got[5][1] in ("en", "fr") and 0 <= got[5][2] <= 1
    nothing = lang_id.fit([], [])
    assert {r["lang_pred"] for r in lang_id.identify(documents(spark), nothing).collect()} == {"und"}
    assert lang_id.train(documents(spark).limit(0)).langs == []


def plain_trigrams(text):
    """Trigrams of lower-cased letters, other runs as one space, hashed as the model does."""
    low = [(x.lower() if len(x.lower()) == 1 else x) if x.isalpha() else " " for x in text or ""]
    runs = re.sub(" +", " ", "".join(low).strip(" "))
    if not runs:
        return []
    padded = [0] + [ord(c) if c != " " else 0 for c in runs] + [0]
    out = []
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if b:
            h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % (1 << 64)
            h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            out.append(h >> (64 - 15))
    return out


def test_language_equals_a_plain_reading():
    """Pooling, softmax, temperature and rejection, one number at a time."""
    rng = random.Random(9)
    langs = {"en": "the of and to in is that it was for", "fr": "le de et la les des un une est pour", "xx": "zu qa wo ti ke ma nu"}
    texts, labels = zip(*[(" ".join(rng.choice(w.split()) for _ in range(rng.randrange(1, 30))), k) for k, w in langs.items() for _ in range(60)], strict=True)
    model = lang_id.fit(list(texts), list(labels))
    assert model.langs == sorted(langs) and 0 < model.temperature <= 5 and 0.3 <= model.threshold <= 0.9
    odd = ["", None, "123", "Le Chat, et la 2e!", "İstanbul ß", "x", "zu  zu\n\nzu"]
    for text, grams in zip(odd + list(texts[::7]), lang_id.subwords(odd + list(texts[::7])), strict=True):
        assert grams.tolist() == plain_trigrams(text)
        got = model.predict(grams)
        if not plain_trigrams(text):
            assert got == ("und", 0.0, True)
            continue
        z = [(sum(float(model.rows[g][k]) for g in grams.tolist()) / len(grams) + model.bias[k]) / model.temperature for k in range(3)]
        e = [np.exp(x - max(z)) for x in z]
        best = max(range(3), key=lambda k: e[k])
        assert got[0] == model.langs[best] and abs(got[1] - e[best] / sum(e)) < 1e-9 and got[2] == (e[best] / sum(e) < model.threshold)


def test_calibration_by_hand():
    """The temperature has the least loss of those tried, and the threshold accepts few errors."""
    rng = np.random.default_rng(3)
    model = lang_id.Model(["a", "b"], np.zeros((lang_id.TABLE, 2), np.float32), np.zeros(2), 1.0, 0.0)
    y = rng.integers(0, 2, 300)
    model.rows[0], model.rows[1], model.rows[2] = (2, 0), (0, 2), (0.3, 0)
    grams = [np.array([2]) if rng.random() < 0.2 else np.array([k]) for k in y]
    lang_id._calibrate(model, grams, y, rng)

    def loss(t):
        p = [np.exp(model.rows[g[0]] / t) for g in grams]
        return -np.mean([np.log(x[k] / x.sum()) for x, k in zip(p, y, strict=True)])

    assert all(loss(model.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.05, 5, 60))
    kept = [(int(model.rows[g[0]].argmax()), k) for g, k in zip(grams, y, strict=True) if not model.predict(g)[2]]
    assert kept and sum(a != b for a, b in kept) <= 0.02 * len(kept)


def test_dirty_language_columns_are_bounded(spark):
    df = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('some words of row ', id) text", "case when id % 2 = 0 then 'en' else concat('x', id) end lang")
    model = lang_id.train(df, rows_per_language=50, most_languages=5)
    assert len(model.langs) == 5 and "en" in model.langs
    assert lang_id.train(df.withColumn("lang", F.lit(None).cast("string"))).langs == []


def test_subwords_do_not_depend_on_neighbours():
    texts = ["ab c", "", None, "Déjà vu", "12", "x"]
    together = [g.tolist() for g in lang_id.subwords(texts)]
    assert together == [next(lang_id.subwords([t])).tolist() for t in texts]
    assert [len(g) for g in together] == [3, 0, 0, 6, 0, 1]
    assert together[1] == together[2] == together[4] == []


# --- fingerprints ---


def test_fingerprints_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs, rows_per_slice=17).collect()}
    assert len(got) == len(want)
    errors = []
    for k, (i, t) in enumerate(want):
        nxt = want[(k + 1) % len(want)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == fingerprint.packed(fingerprint.signature(next(wordhash.shingles([e], 5))))
        a, b = shingle_set(t, 5), shingle_set(e, 5)
        errors.append(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).mean() < 0.03 and np.abs(errors).max() < 0.15


def test_fingerprint_likeness_is_unbiased():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        found = []
        for _ in range(60):
            n = int(rng.integers(20, 2000))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            both = int(n * 2 * share / (1 + share))
            found.append(fingerprint.likeness(fingerprint.signature(wordhash.mix(pool[:n])), fingerprint.signature(wordhash.mix(pool[n - both : 2 * n - both]))) - both / (2 * n - both))
        assert abs(np.mean(found)) < 0.02


def test_fingerprints_of_odd_rows(spark):
    got = holds(lambda d: fingerprint.fingerprints(d, rows_per_slice=3), documents(spark))
    by_text = {}
    for r in got:
        by_text.setdefault((r[1], r[3]), set()).add(r[3])
    empty = [r for r in got if r[1] == 0]
    assert {r[3] for r in empty} == {""} and len(empty) == 2
    one = fingerprint.fingerprints(documents(spark, [(5, "abcdef", None, None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_fingerprints_of_hot_numbers(spark):
    """Rows without doc_id, or all of one, are dealt among slices by their texts; results are those of the order by (doc_id, hash, text)."""
    base = spark.range(1500).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else 9007199254740993 + id end doc_id", "concat('text ', id % 700, ' of words that go on ', id % 700, ' and on') text").repartition(5)
    sliced = fingerprint._sliced(base.withColumnRenamed("text", "text_"), 50)
    most = sliced.groupBy("slice_").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 150 and most[1] > 20
    rows = base.withColumn("h", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))
    want = Counter()
    for k, r in enumerate(rows):
        t, nxt = r["text"], rows[(k + 1) % len(rows)]["text"]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    got = fingerprint.fingerprints(base, rows_per_slice=50)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_chars", "edited_sha256").collect()) == want


# --- join ---


def brute_links(texts, k=4, percent=85):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    return {(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def brute_components(texts, k=4, percent=85):
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in sorted(brute_links(texts, k, percent)):
        x, y = sorted((root(i), root(j)))
        comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def families():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = {}
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for f in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 7, 8, 9, 10, 14, 30, 90, 200, 900]))]
        if f % 5 == 0:
            base += passage
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            texts[len(texts)] = (" " if rng.random() < 0.5 else "\t").join(w)
    texts[len(texts)] = ""
    return texts


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_join_equals_brute_force(spark, k, percent):
    texts = families()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(df, percent, k).collect()}
    assert got == brute_components(texts, k, percent)


def test_links_equal_brute_force(spark):
    texts = families()
    df = spark.createDataFrame([*texts.items(), (None, texts[0]), (None, "of no number at all"), (3, texts[3])], "doc_id long, text string")
    links, members = jaccard_join.join_links(df)
    rid = {r["doc_id"]: r["rid"] for r in members.where("doc_id is not null").collect()}
    assert members.count() == df.count() and set(rid) == set(texts)
    # Equal sets share a representative; each link between representatives is there once.
    want = {(i, j) for i, j in brute_links(texts) if rid[i] == i and rid[j] == j}
    assert sorted(tuple(r) for r in links.collect()) == sorted(want)
    assert all(shingle_set(texts[i], 4) == shingle_set(texts[r], 4) for i, r in rid.items() if texts[i])


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_that_defeat_polynomial_hashes(spark):
    words = [thue_morse(2048, 0), thue_morse(2048, 1)]
    (a, b), (c, d) = wordhash.shingle_pairs(words, 4)
    assert a[0] != c[0] and b[0] != d[0]
    df = spark.createDataFrame([(1, words[0]), (2, words[1]), (3, words[0].upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_exact_sets_equal_split_words():
    rng = random.Random(2)
    texts = [t or "" for t in SAMPLES] + [" ".join(rng.choice(["the", "and", "of", "To", "x"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    for k in (1, 2, 4, 5):
        sets, want = wordhash.exact_sets(texts, k), [shingle_set(t, k) for t in texts]
        for i in range(0, len(texts), 7):
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])
    assert [len(x) for x in wordhash.exact_sets(["", " "], 4)] == [0, 0]


def test_join_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 200)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(80)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(60, 100):
        # Halves in common: blocks without links, which their hub doesn't settle.
        texts[i] = " ".join(base[:40] + [f"m{i % 9}_{k}" for k in range(40)][: 40 - i % 4])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_components(df).collect()}
    assert got == brute_components(texts)


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(4)
    pts = rng.integers(0, 6, (300, 16)).astype(np.int32)
    ns = pts.sum(1)
    tree = jaccard_join.RTree(pts, ns, 85)
    for i in range(50):
        bound = np.minimum(pts, pts[i]).sum(1)
        want = np.flatnonzero(jaccard_join.alike(bound, ns, ns[i]) & (100 * ns >= 85 * ns[i]) & (100 * ns[i] >= 85 * ns))
        assert sorted(tree.search(pts[i], ns[i]).tolist()) == want.tolist()


@pytest.mark.parametrize("percent,least", [(85, 6), (80, 4)])
def test_bands_keep_an_equal_group(percent, least):
    bands = jaccard_join.Bands(percent)
    assert bands.of(least - 1) == [] and bands.least == least
    for n in range(least, 3000, 7):
        for m in range(n, 100 * n // percent + 1):
            shared = [b for b in bands.of(n) if b in bands.of(m)]
            assert shared
            for b in shared:
                differ = (n + m) * (100 - percent) // (100 + percent)
                assert bands.groups[b] - differ > bands.spare(b, n) + bands.spare(b, m)


def test_join_of_odd_rows(spark):
    got = holds(lambda d: jaccard_join.join_components(d).select("doc_id", "n_shingles", "component_id"), documents(spark))
    assert (8, 7, 1) in got and got.count((1, 7, 1)) == 2
    assert (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got and (None, 6, None) in got
    # A number with two texts joins what each of them joins.
    two = documents(spark, [(1, "a b c d e", *[None] * 3), (2, "a b c d e", *[None] * 3), (2, "v w x y z", *[None] * 3), (3, "v w x y z", *[None] * 3)])
    assert {r["component_id"] for r in jaccard_join.join_components(two).collect()} == {1}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    want = {}
    for a, b in edges:
        for x in (a, b):
            want.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(want[a], want[b])
            changed |= want[a] != m or want[b] != m
            want[a] = want[b] = m
    got = {r["node"]: r["component"] for r in staging.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= {k for k, v in want.items() if list(want.values()).count(v) == 1}
    assert staging.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- media ---


def test_media_round_trip(spark):
    docs = documents(spark)
    got = holds(media.text_media, docs)
    want = {}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        want.setdefault(r["doc_id"], (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert {r[0]: r[1:5] for r in got} == want
    assert all(r[9] == f"text of document {'?' if r[0] is None else r[0]}" for r in got)
    for payload in (bytes(64), bytes(range(256)) * 3, b"z" * 64 * 1000):
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload
    broken = bytearray(media.encode_png(bytes(64)))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_media_equals_a_plain_reading(spark, sf):
    """The stored form, read by hand, and its features; place and caption stay with their document."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    got = queries.op6_media_columns(spark, sf).where(F.col("doc_id").isin(list(docs))).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.encode_png(payload)
        n = int.from_bytes(stored[33:37], "big")
        lines = zlib.decompress(stored[41 : 41 + n])
        assert stored[37:41] == b"IDAT" and b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == payload
        assert int.from_bytes(stored[16:20], "big") == 64 and int.from_bytes(stored[20:24], "big") * 64 == len(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        height, mean = len(payload) // 64, sum(payload) / len(payload)
        std = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        bands = []
        for i in range(8):
            a, b = i * height // 8, (i + 1) * height // 8 if i < 7 else height
            part = payload[64 * a : 64 * max(b, a + 1)]
            for j in range(8):
                own = [x for k, x in enumerate(part) if k % 64 // 8 == j]
                bands.append(sum(own) / len(own))
        size, m, s, bits = re.fullmatch(r"grey8 (\S+) mean=(\S+) std=(\S+) ahash=([0-9a-f]{16})", r["feature"]).groups()
        assert size == f"64x{height}" and abs(float(m) - mean) < 1e-3 and abs(float(s) - std) < 1e-3
        level = sum(bands) / 64
        assert all((v > level) == (c == "1") or abs(v - level) < 1e-6 for v, c in zip(bands, f"{int(bits, 16):064b}", strict=True))
        assert (r["pos"], r["n_items"], r["caption"]) == (1, 3, f"text of document {r['doc_id']}")


def test_interleaving():
    page = '<p>One &amp; two</p><figure><img src="media:d1" alt="x"><figcaption>A  cap</figcaption></figure><p>Three</p><img src=d2 alt="alt"><script>no</script><p>Four'
    got = [(i["pos"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.interleave_html(page)]
    assert got == [(0, "text", "One & two", None, None), (1, "media", None, "d1", "A cap"), (2, "text", "Three", None, None), (3, "media", None, "d2", "alt"), (4, "text", "Four", None, None)]
    assert media.interleave_html(None) == media.interleave_html("") == []


def test_resolve_keeps_positions(spark):
    pages = spark.createDataFrame([(1, '<p>t</p><img src="a"><img src="zz">'), (2, '<img src="a">'), (3, None)], "page_id long, html string")
    known = spark.createDataFrame([("a", 7)], "digest string, payload int")
    got = rows(media.resolve(media.interleave(pages).drop("html"), known).select("page_id", "item.pos", "digest", "payload"))
    assert got == [(1, 0, None, None), (1, 1, "a", 7), (1, 2, "zz", None), (2, 0, "a", 7), (3, None, None, None)]


# --- toxicity ---


def test_toxicity(spark):
    out = queries.op7_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = out.where("held_out").selectExpr("count_if(predicted = 1 and toxic = 1)", "count_if(toxic = 1)", "count_if(predicted = 1)").first()
    assert held[0] / held[1] > 0.9 and held[0] / max(1, held[2]) > 0.95


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "day", "we", "talk", "here"]) for _ in range(30)) for _ in range(120)]
    labels = [int(i % 3 == 0) for i in range(120)]
    texts = [t + " you nasty fool" * y for t, y in zip(texts, labels, strict=True)]
    model = toxicity.fit(texts, labels)
    got = {r[0]: r[1:] for r in holds(lambda d: toxicity.score(d, model), documents(spark))}
    assert got[2] == got[3] and all(0 <= s <= 1 for s, _ in got.values())
    assert model.scores(["you nasty fool, we talk", "we talk here all day long"]).round().tolist() == [1.0, 0.0]
    assert toxicity.fit([], []).scores(["x", None]).tolist() == [0.0, 0.0]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (8, 5)], "doc_id long, toxic int")
    assert toxicity.train(documents(spark), labels) is not None
    assert toxicity.train(documents(spark).limit(0), labels.limit(0)).trees is None


def plain_tree(x, g, h, rows, depth):
    """The best split by trying every cut of every feature, with the gain of the logistic loss."""
    gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
    if not depth or len(rows) < 8:
        return toxicity.RATE * gs / (hs + 1)
    best = (1e-6, None, None)
    for f in range(len(x[0])):
        for cut in sorted({x[i][f] for i in range(len(x))})[:-1]:
            gl, hl = (sum(v[i] for i in rows if x[i][f] <= cut) for v in (g, h))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            if hl >= 0.05 and hs - hl >= 0.05 and gain > best[0] + 1e-12:
                best = (gain, f, cut)
    if best[1] is None:
        return toxicity.RATE * gs / (hs + 1)
    _, f, cut = best
    return f, cut, plain_tree(x, g, h, [i for i in rows if x[i][f] <= cut], depth - 1), plain_tree(x, g, h, [i for i in rows if x[i][f] > cut], depth - 1)


def test_trees_equal_trying_every_split(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(60) < 0.2)).astype(float)
    raw = np.full(60, np.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-raw))
        tree = plain_tree(x.tolist(), (y - p).tolist(), (p * (1 - p)).tolist(), list(range(60)), toxicity.DEPTH)

        def value(row, t):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        raw = raw + [value(row, tree) for row in x.tolist()]
    assert np.allclose(toxicity.Boosted().fit(x, y).raw(x), raw, atol=1e-9)


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(8)
    raw = rng.permutation(40).astype(float)
    y = (rng.random(40) < raw / 40).astype(float)
    xs, ps = toxicity.isotonic(raw, y)
    own = y[np.argsort(raw)]
    for k in range(40):
        fit = max(min(own[a : b + 1].mean() for b in range(k, 40)) for a in range(k + 1))
        assert abs(np.interp(k, xs, ps) - fit) < 0.011


def test_training_texts_are_bounded_whatever_the_ids(spark):
    docs = spark.range(3000).selectExpr("5L as doc_id", "concat('words of row ', id, ' here') as text")
    seen = []
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int")
    fit, toxicity.fit = toxicity.fit, lambda t, y: seen.append(len(t))
    try:
        toxicity.train(docs, labels, rows_per_class=100)
    finally:
        toxicity.fit = fit
    assert 50 < seen[0] < 200


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=400)
    xs, ps = toxicity.isotonic(raw, (rng.random(400) < 1 / (1 + np.exp(-3 * raw))).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ps) >= 0).all() and 0 < ps[0] < ps[-1] < 1


# --- packing ---


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(docs, queries.tokenizer_path()).collect()
    assert rows(packing.pack(docs.withColumn("n", F.lit(1)), queries.tokenizer_path())) == sorted(map(tuple, got), key=repr)
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).count() == 0
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(pieces) == set(want)
    for i, ps in pieces.items():
        ids = want[i][0]
        assert sum(p["length"] for p in ps) == len(ids) * len(want[i])
        assert sorted({p["start"] for p in ps})[0] == 0
        for p in ps:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing_of_a_whole_table(spark, sf):
    """Every piece by a plain rule: documents are covered without gap or overlap, sequences too, and ids are the tokenizer's."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert len(want) == docs.count()
    pieces, sequences, groups, pad = {}, {}, {}, 0
    for p in queries.op9_packing(spark, sf).collect():
        ids = want[p["doc_id"]]
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        groups.setdefault((p["sequence_id"] >> 33, p["tier"]), {}).setdefault(p["step_group"], Counter())[p["sequence_id"]] += p["length"]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for own, whole in [(pieces[i], len(ids)) for i, ids in want.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == whole if whole else at <= 2048
        pad += 0 if whole or at & (at - 1) == 0 else 2048 - at
    assert pad == 0
    # Step groups of a tier in a part hold equal numbers of tokens, up to a half at its end.
    for (_, tier), own in groups.items():
        sizes = sorted(sum(g.values()) for g in own.values())
        assert sizes[-1] <= packing.STEP * 2048 and (tier < 256 or len(sizes) == 1 or sizes[0] >= sizes[-1] / 2 - tier)


def test_packer_places_every_token_once():
    rng = random.Random(6)
    packer, done, sizes = packing.Packer(), [], {}
    for i in range(3000):
        sizes[i] = rng.choice([1, 5, 30, 300, 900, 1025, 2047, 2048, 2049, 7000])
        done += packer.take(i, sizes[i])
        assert all(sum(n for n, _, _ in p) == packer.waiting[t] < packing.POOL * t for t, p in packer.pool.items())
    cut = sum(s > 0 and s % 2048 > 0 for _, s, *_ in done)
    done += packer.close()
    for i, n in sizes.items():
        own = sorted((s, m) for d, s, m, *_ in done if d == i)
        assert own[0][0] == 0 and all(s + m == t for (s, m), (t, _) in zip(own, own[1:])) and sum(own[-1]) == n
    filled = Counter()
    for _, _, m, seq, at, tier in done:
        assert at == filled[seq, tier]
        filled[seq, tier] += m
    assert all(n == tier for (_, tier), n in filled.items())
    # A window cuts one piece at most, and most windows none.
    assert cut < len(filled) / 2


def test_steps_are_even():
    for n in (0, 1, 15, 16, 17, 31, 32, 33, 100):
        steps, groups = packing.Steps(4), Counter()
        rows = [r for i in range(n) for r in steps.take(512, [(i,)])] + steps.close()
        assert [r[0] for r in rows] == list(range(n))
        groups.update(r[1] for r in rows)
        assert all(g <= 16 for g in groups.values()) and (n < 16 or min(groups.values()) >= 8)


def test_fast_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [LONG[:3000], "a\u00a0b\u2003c\r\n\t x'll 12345 \U0001f469\u200d\U0001f680", "x<|endoftext|>y", "  \n\n  "]
    for t, ids in zip(texts, packing._encoder(queries.tokenizer_path())(texts), strict=True):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "\u2003", "\u0085", "a", "!", "7", "\u0301", " x", "x" + " " * 8190, " \x1c"])
def test_ids_of_very_long_runs(unit):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    text = unit * (1_000_000 // len(unit)) + "x"
    assert packing._encoder(queries.tokenizer_path())([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_both_tokenizers_split_every_character_alike():
    from tokenizers import Tokenizer

    tok, fast = Tokenizer.from_file(queries.tokenizer_path()), packing._encoder(queries.tokenizer_path())
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200), *range(0x32000, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 14):
        texts = ["a{0}1{0}!{0} x".format(chr(c)) for c in points[at : at + (1 << 14)]]
        for ids, e in zip(fast(texts), tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == e.ids
