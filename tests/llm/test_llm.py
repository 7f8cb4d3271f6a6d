"""The training-data operators against brute force, on small tables with the awkward rows in them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symlake.llm import chat, embed_dedup, html, langid, licenses, minhash, mixing, packing, pii, registry, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_pii", "op3_mixing", "op5_chat_format", "op8_license_scan"])
def test_query_equals_its_sql(spark, name):
    assert compare.differ(registry.queries()[name](spark, SF), compare.connect(SF), registry.oracle_sql()[name]) == ""


DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, epoch int"
TEXTS = [None, "", "   ", "one", "one", "alpha beta gamma delta epsilon zeta " * 5, "alpha beta gamma delta epsilon zeta " * 5 + "eta", "Mail a@b.co%x@y.z or 1.2.3.4.5.6.7.8, 4111 1111-1111 1111, +1 (212) 555-0100. 999.1.1.1 é😀 q@r.st", "!!! 123", "x" * 50_000, "Licensed under CC BY-NC 4.0.\nAll rights reserved. cc by", "word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 3 else None, None, "clash", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", None, "s1", None, "clash", 1), (5, TEXTS[5], "en", "s1", None, "clash", 1)]
    return spark.createDataFrame(rows, DOCS).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").toPandas().replace({np.nan: None})


def components(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_brute_force(docs, rows, width):
    words, nodes, links = {}, set(), []
    have = []
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        have.append((None if i is None else int(i), {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    for i, (a, x) in enumerate(have):
        if a is not None:
            nodes.add(a)
            links += [(a, b) for b, y in have[:i] if b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = components(nodes, links)
    got = minhash.near_duplicates(docs, width).collect()
    assert len(got) == len(have) and not words
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((a, len(x)) for a, x in have)
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_cuts_large_buckets(docs, rows, spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "CELL", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    test_minhash_equals_brute_force(docs, rows, 2)
    # A chain: each text is near its neighbours only, and many share a bucket.
    words = [f"w{i}" for i in range(400)]
    chain = spark.createDataFrame([(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(60)], "doc_id long, text string")
    got = minhash.near_duplicates(chain, 2).collect()
    assert {r["component_id"] for r in got} == {0} and minhash.near_duplicates(chain.limit(0)).count() == 0


def test_cell_pairs_lose_no_similar_pair():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 2**63, 200).astype(np.uint64)
        sets += [np.unique(base)] + [np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in (10, 20, 60)]
    sketch = minhash._sketches(minhash.super_minhash(sets))
    n = len(sets)
    cell = pa.table({"i": [0] * n, "j": [1] * n, "rep": range(n), "n": [len(s) for s in sets], "part": range(n), "block": [k % 2 for k in range(n)], "sketch": sketch})
    found = set(zip(*(c.to_pylist() for c in minhash._cell_pairs(80)(cell).columns), strict=True))
    want = {(a, b) for b in range(n) for a in range(b) if (a + b) % 2 and minhash._similar(sets[a], sets[b], 80)}
    assert want and want <= found and len(found) < 4 * len(want)


def test_pii(docs, rows):
    def luhn(s):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0

    def base(x):
        out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(g := re.sub("[ -]", "", m.group())) <= 19 and luhn(g)]
        out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)

    got = pii.digests(pii.find(docs)).collect()
    counts = lambda b: tuple(b.count(f"{k}:") for k in pii.KINDS)
    want = [(None if i is None else int(i), base(t or "")) for i, t in zip(rows.doc_id, rows.text, strict=True)]
    assert Counter((r["doc_id"], r["base_sha256"], (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"])) for r in got) == Counter((i, hashlib.sha256(b.encode()).hexdigest(), counts(b)) for i, b in want)
    text = dict(want)
    assert all(r["spans"].split(",term")[0] == text[r["doc_id"]] for r in got if text[r["doc_id"]] and r["doc_id"] != 5) and pii.find(docs.limit(0)).count() == 0


def test_pii_marks_many_matches_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pii, "MATCHES", 4)
    monkeypatch.setattr(pii, "CHARS", 10)
    text = "é😀 " + " ".join(f"Mail Who{i}x at u{i}@h.example or 10.0.0.{i}" for i in range(50)) + " ok"
    rows = [(1, text), (None, None), (3, "Mail at or ok"), (3, "Mail at or ok")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))).collect()}
    spans = got[1]["spans"]
    assert [(s["kind"], s["value"]) for s in spans if s["kind"] != "term"] == [("email", f"u{i}@h.example") for i in range(50)] + [("ip", f"10.0.0.{i}") for i in range(50)]
    assert all(text[s["start"] : s["end"]] == s["value"] for s in spans) and [s["value"] for s in spans if s["kind"] == "term"] == ["é"] + [f"Who{i}x" for i in range(50)]
    assert got[1]["redacted"] == "😀 " + " ".join(["Mail [NAME] at [EMAIL] or [IP]"] * 50) + " ok" or got[1]["redacted"].endswith(" ".join(["Mail [NAME] at [EMAIL] or [IP]"] * 50) + " ok")
    assert got[3]["redacted"] == "Mail at or ok" and got[None]["redacted"] == ""




def test_pii_terms_that_reveal(spark):
    contexts = ["call", "reach", "find", "ask", "visit"]
    rows = [(i, f"Please {c} {'never ' * i}Zorblax now at zed@corp.example for more") for i, c in enumerate(contexts)] + [(i, f"Please call number {i} for more now") for i in range(10, 60)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(any(s["kind"] == "term" and s["value"] == "Zorblax" for s in r["spans"]) for r in found[:5])
    assert found[0]["redacted"] == "Please call [NAME] now at [EMAIL] for more"
    assert all(not r["spans"] and r["redacted"] == r["text"] for r in found[5:])


def test_pii_terms_reveal_rare_entities(spark):
    far = "and so on with nothing new " * 20
    rows = [(0, f"Quibbleford wrote. {far} Mail ann@one.example"), (1, f"Zanzibarius rang. {far} Mail bob@two.example"), (2, f"Zanzibarius wrote. {far} Mail bob@two.example")]
    rows += [(3 + i, f"Vexillor {far} Mail eve@six.example") for i in range(9)] + [(12, f"Vexillor {far}")] + [(20 + i, f"They wrote and rang. Mail {far}") for i in range(80)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = {i: [s["value"] for s in r["spans"] if s["kind"] == "term"] for i, r in got.items()}
    # An entity in one document and in two, terms far from it; the last document holds a telling term and no entity.
    assert terms[0] == ["Quibbleford"] and terms[1] == terms[2] == ["Zanzibarius"] and terms[3] == terms[12] == ["Vexillor"]
    assert got[12]["redacted"] == f"[NAME] {far}" and all(not terms[20 + i] for i in range(80)) and len(got) == len(rows)


def test_packing(docs, rows):
    library = packing.WordTokenizer(packing.default_vocabulary()).library
    want = Counter()
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(None if i is None else int(i), k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r["length"] for r in got])) + 1


def test_tokenizer_equals_the_library():
    t = packing.WordTokenizer(packing.default_vocabulary())
    for x in ["", " ", "Don't <|endoftext|> stop", "naïve ÉCOLE 12³ x²y z w", "a\x1cb \x01 c", "中文字 Ωσς İ ǅ", "é + é", "🙂🙂 a_b __ 3.14"]:
        assert t(x).tolist() == t.library.encode(x, add_special_tokens=False).ids, x


def test_bounds_and_packing_meet():
    n = np.array([1500] * 5 + [1100] * 4 + [500] * 7 + [10] * 3)
    bins, offsets, used = packing.best_fit_decreasing(n)
    assert packing.lower_bound(n) <= used == 9 and packing.lower_bound(np.array([1500] * 3)) == 3


def test_language_id(docs, spark):
    model = langid.learn(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang", "text", langid.held_out().alias("h")), "doc_id").filter("doc_id >= 1000").collect()
    held = [r for r in got if r["h"]]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    und = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert und[0] == und[1] == und[8] == "und" and und[3] != "und"
    none = docs.limit(0)
    assert langid.identify(docs, langid.learn(none)).filter("lang_pred <> 'und'").count() == 0 and langid.identify(none, model).count() == 0


def test_language_id_learns_every_language(spark):
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [["".join(rng.choice(list(letters), 6)) for _ in range(4)] for _ in range(70)]
    rows = [(100 * k + i, " ".join(w), f"l{k:02}") for k, w in enumerate(words) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model[0]) == 70
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_no_word_zeroes_all_languages():
    lattice = langid.Lattice(langid.default_vocabulary())
    p = np.random.default_rng(0).random((lattice.size, 2))
    p /= p.sum(axis=0)
    one, many = lattice.log_probabilities(["\u1200", "\u1200" * 64], p)
    assert np.isfinite(many).all() and np.allclose(many - one, 63 * np.log(langid._UNKNOWN))


def test_long_runs_sum_all_segmentations():
    lattice = langid.Lattice(langid.default_vocabulary())
    rng = np.random.default_rng(0)
    p = rng.random((lattice.size, 3))
    p /= p.sum(axis=0)
    for n in (1, 30, 64):
        w = "".join(rng.choice(list("abcdeßnrst\u1200"), n))
        assert np.allclose(lattice.log_probabilities([w], p)[0], lattice.long_log_probability(w, p, segment=7))
    w = "".join(rng.choice(list("abcdeßnrst"), 700))
    points = np.frombuffer(("▁" + w).encode("utf-32-le"), np.uint32).reshape(1, -1)
    alpha, logs = lattice.forward(points, p)
    matrix = np.log(alpha[-1, 0]) + (0 if logs is None else logs[-1, 0]) - points.shape[1] * np.log(langid._SCALE)
    assert np.allclose(lattice.log_probabilities([w], p)[0], matrix)


def test_language_id_samples_rows_without_an_id(spark):
    rows = [(None, f"{'der die das und' if i % 2 else 'the and that with'} {i}", "de" if i % 2 else "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(docs, sample_docs=100)
    got = langid.identify_rows(docs, model).collect()
    assert len(got) == len(rows) and sum(r["lang"] == r["lang_pred"] for r in got) == len(rows)


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(langid.default_vocabulary())
    p = np.random.default_rng(0).random((lattice.size, 2))
    p /= p.sum(axis=0)

    def total(s):
        out = 0.0 if s else 1.0
        for n in range(1, len(s) + 1):
            at = lattice.find(np.array([lattice._key(s[:n])], np.uint64))[0]
            piece = lattice.values[at] if at >= 0 else -1
            if piece >= 0 or n == 1:
                out += (p[piece, 0] if piece >= 0 else langid._UNKNOWN) * total(s[n:])
        return out

    for w in ("was", "straße", "xqzé"):
        assert np.isclose(np.log(total("▁" + w)), lattice.log_probabilities([w], p)[0, 0])


VECTORS = "vec_id long, embedding array<float>, label int, times string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.25 * np.linalg.norm(x[0]) / 4
    x[160:170] = x[5]
    rows = [(i, v.tolist(), 0, "clash") for i, v in enumerate(x.astype(np.float32))]
    rows += [(400, None, 0, ""), (401, [], 0, ""), (402, [0.0] * 16, 0, ""), (403, [float("nan")] * 16, 0, ""), (404, [None] + [1.0] * 15, 0, ""), (405, [float("inf")] * 16, 0, ""), (500, [1.0] * 8, 0, ""), (None, x[5].tolist(), 0, ""), (299, x[299].tolist(), 0, "")]
    return spark.createDataFrame(rows, VECTORS)


def test_near_duplicate_vectors(vectors):
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in good]
    links = [(a, b, x is y) for k, (a, x) in enumerate(unit) for b, y in unit[:k] if len(x) == len(y) and x @ y >= 0.95]
    want = components({i for i, _ in rows if i is not None}, [(a, b) for a, b, _ in links])
    n = Counter(x for a, b, _ in links for x in (a, b))
    got = embed_dedup.near_duplicate_vectors(vectors).collect()
    assert len(got) == len(rows)
    once = [r for r in got if r["vec_id"] not in (None, 299)]
    assert all((r["n_links"], r["component_id"]) == (n[r["vec_id"]], want[r["vec_id"]]) for r in once) and max(n.values()) > 20
    assert [r["n_links"] for r in got if r["vec_id"] == 299] == [1, 1] and embed_dedup.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_tile_recomputes_only_what_is_uncertain():
    x = np.random.default_rng(2).normal(size=(400, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = unit @ unit.T
    links, _, full = embed_dedup.link_tile(x, np.ones(400, int), np.arange(400), np.arange(400), True, 0.3)
    assert links.tolist() == ((true >= 0.3).sum(axis=1) - 1).tolist() and 0 < full < 4000


def test_top_k(vectors):
    rows = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"], float)).astype(int)) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    got = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    queries = {i: v for i, v in rows if i % 100 == 0}
    assert found == {q: sorted((-int(v @ w), i) for i, w in rows if i != q and len(w) == len(v))[:10] for q, v in queries.items() if len(v) == 16}
    x = np.random.default_rng(3).integers(-500, 500, (3000, 12))
    a, b, s = topk.block_top_k(x[:20], x, np.arange(3000), np.arange(20), 7)
    for q in range(20):
        assert list(zip((-s[a == q]).tolist(), b[a == q].tolist(), strict=True)) == sorted((-int(v), i) for i, v in enumerate(x @ x[q]) if i != q)[:7]


def test_licenses(docs, rows):
    got = licenses.scan(docs).collect()
    text = {None if i is None else int(i): t for i, t in zip(rows.doc_id, rows.text, strict=True)}
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[r["doc_id"]] or ""))
        places = {k: [i for i in range(len(w)) if w[i : i + len(k.split())] == k.split()] for k in licenses.PHRASES}
        at = sorted(sum(places.values(), []))
        labels = {v for k, v in licenses.PHRASES.items() if places[k]}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(labels)))
        own, share = set(), 0.0
        for label, notice, telling in licenses.NOTICES:
            n = re.findall("[a-z0-9]+", notice.lower())
            width = next(k for k in range(len(n), 2 * len(n) + 2) if 5 * len(n) <= 4 * k)
            for i in range(len(w)):
                held = set(w[i : i + width]) & set(n)
                if 5 * len(held) >= 4 * len(set(n)) and set(telling.split()) <= held:
                    own.add(label)
                    share = max(share, len(held) / len(set(n)))
        assert r["labels"] == ",".join(sorted(labels | own)) and r["score"] == (1.0 if at else share)


def test_licenses_in_wrapped_notices(spark):
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction, including\n */"
    gpl = "# This program is free software: you can redistribute it and/or modify\r\n# it under the terms of the GNU General Public License as published by\r\n# the Free Software Foundation"
    words = next(n for label, n, _ in licenses.NOTICES if label == "bsd" and len(n) > 50).split()
    rows = [(1, mit, "x"), (2, gpl, "x"), (3, "a b c\n" * 30 + mit + "\nx y z" * 30, "x"), (4, "\n".join(f"{w} {'filler ' * 12}" for w in words), "x"), (5, " ".join(words), "x"), (6, "plain\ntext", "x"), (6, None, "x"), (None, "", "x")]
    # The telling word decides between notices that share the rest.
    rows += [(7, "Licensed under CC BY 4.0.", "x"), (8, "This software is released under the GPL license", "x"), (9, "Licensed under the Mozilla Public License version 2.0", "x"), (10, "Licensed under CC BY-NC 4.0.", "x"), (11, "under the license", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["labels"] for i in range(1, 12)] == ["mit", "gpl", "mit", "", "bsd", "", "cc-by", "gpl", "mpl-2.0", "cc-by,cc-by-nc", ""] and got[1]["score"] == got[3]["score"] == 1
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], "label string, notice string, telling string")
    assert {r["labels"] for r in licenses.scan(docs, none).collect()} == {"", "gpl", "cc-by"}
    many = spark.createDataFrame([(f"l{i}", f"wholly own words{i} of list{i} number{i}", "") for i in range(300)] + [("wider", "x y z " * 20, "")], "label string, notice string, telling string")
    assert {r["labels"] for r in licenses.scan(spark.createDataFrame([(1, "own words7 of LIST7, number7\n and wholly else")], "doc_id long, text string"), many).collect()} == {"l7"}


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), "hot" if i < 600 else f"s{i % 5}" if i % 11 else None) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert {r["doc_id"] for r in got} == set(range(1000))  # no document is lost
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    for r in got:
        taken[r["source"]] += r["mix_tokens"]
    w = {r["source"]: r for r in mixing.weights(spark.createDataFrame(list(sizes.items()), "source string, tokens long")).collect()}
    assert abs(sum(r["w"] for r in w.values()) - 1) < 1e-9 and max(taken[s] / sizes[s] for s in sizes) <= mixing.REPEATS
    assert all(0 <= w[s]["quota"] - taken[s] < 7 for s in sizes)
    # The repetition limit binds here; without it, the entropy is met.
    free = mixing.weights(spark.createDataFrame(list(sizes.items()), "source string, tokens long"), repeats=100.0).collect()
    h = -sum(r["w"] * np.log(r["w"]) for r in free)
    assert h >= 0.95 * np.log(len(sizes)) - 1e-9
    half = Counter()
    for r in mixing.mix(docs, budget=1000).collect():
        half[r["source"]] += r["mix_tokens"]
    assert 950 <= sum(half.values()) <= 1000 and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_holds_quotas_among_equal_rows(spark):
    rows = [(None, "a\tb\nc", "s", 7)] * 100 + [(None, "a  b c", "s", k % 2) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place int")
    for budget in (3, 55, 166, 258, 330, 400, 700):
        got = mixing.mix(docs, budget=budget).collect()
        assert {r["mix_tokens"] for r in got} == {3} and len(got) == budget // 3, budget
        assert max(Counter(r["epoch"] for r in got).values()) <= 110
    assert mixing.tokens_of(F.lit("")) is not None and docs.limit(0).transform(lambda d: mixing.mix(d, budget=5)).count() == 0
    null = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["mix_tokens"]) for r in mixing.mix(null).collect()) == [(1, 1), (2, 1)]


PAGE = """<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class="cookie-notice">we use</div>
<article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>Four</p><div class="ad">buy</div><form>f</form><section class="comments">said</section></article><footer>&copy;</footer>"""


def test_html(spark):
    wrap = lambda x: f"<html><body><div>Home About us Contact and all the other long links here</div><div>{x}</div></body>"
    rows = [(1, "http://h.example/1", PAGE), (2, None, None), (3, "x", "")] + [(10 + i, f"http://other.example/{i}", wrap(f"story{i} that page {i} alone tells")) for i in range(5)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Head & more\n\nOne two three\n\nFour" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[12]["text"] == "story2 that page 2 alone tells"


def test_html_markup_and_names(spark):
    cases = {
        '<article><p class="overflow-hidden">two</p><p title="the hidden cost">a</p><a href="/hidden/x">b</a><p id="search">s</p><p class="alert">t</p></article>': "two\n\na\n\nb\n\ns\n\nt",
        '<article><p hidden>no</p><p>yes</p><div class="ad">no</div><div id="comments"><p>no</p></div><p style="color:red; display: none">no</p><p aria-hidden="true">no</p></article>': "yes",
        """<article><p class="a"">x "quoted" y</p><p>&am<b>p;</b></p><p data-x='a>b' class="c>d">1 &lt; 2</p></article>""": 'x "quoted" y\n\n&amp;\n\n1 < 2',
        "<article>": "", "<p>a": "a", "</p></div><article>\0b\t\n c</article>": "\0b c", "<script>x</script><!-- a": "",
    }
    rows = [(i, "http://h.example/", h, "clash", 1) for i, h in enumerate(cases)] + [(0, "http://h.example/", next(iter(cases)), "clash", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and all(r["text"] == ([*cases.values()][r["page_id"]] if r["page_id"] is not None else "") for r in got)
    assert html.extract(pages.limit(0)).count() == 0
    # A copied article stays, also where it is on many pages of a host.
    copies = spark.createDataFrame([(i, "http://h.example/", f"<nav>a b c d e f g h i j</nav><article>{'one two three four five six seven eight nine ten'}</article>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(copies).collect()} == {"one two three four five six seven eight nine ten"}


def test_html_repeats_are_counted_over_a_whole_host(spark, monkeypatch):
    bar = "Home About us Contact and all the other long links here"
    rows = [(i, f"http://h.example/{i}", f"<div>{bar if i < 4 else f'other{i}'}</div><div>{' '.join(f'w{i}x{k}' for k in range(40))}</div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    monkeypatch.setattr(html, "GROUP_CHARS", 300)
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == whole
    assert all("Home" not in t for t in whole.values()) and all(f"w{i}x39" in t for i, t in whole.items())


def test_repeats_are_those_of_brute_force():
    rng = np.random.default_rng(4)
    pages = [[str(x) for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(12)]
    seen = defaultdict(set)
    for i, p in enumerate(pages):
        for k in range(len(p) - 3):
            seen[tuple(p[k : k + 4])].add(i)
    for p, got in zip(pages, html.repeated_tokens(pages, 4, 3), strict=True):
        want = np.zeros(len(p), bool)
        for k in range(len(p) - 3):
            if len(seen[tuple(p[k : k + 4])]) >= 3:
                want[k : k + 4] = True
        assert got.tolist() == want.tolist()


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\| <|"
    rows = [(1, 0, "system", "s"), (1, 2, "assistant", said), (1, 1, "user", None), (2, 0, "assistant", "a"), (2, 1, "assistant", "b\n"), (None, None, None, "x"), (-1, 0, "user\nrole", said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    order = {1: [("system", "s"), ("user", ""), ("assistant", said)], 2: [("assistant", "a"), ("assistant", "b\n")], None: [("", "x")], -1: [("user\nrole", said)]}
    assert set(got) == set(order)
    for c, want in order.items():
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(t for r, t in want if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(want), sha("".join(f"{r}\n{t}\n" for r, t in want)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_renders_a_long_conversation_once(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", "x<|im_end|>\n" * (i % 5) + "<\\|") for i in range(60)] + [(2, 0, None, None), (1, 3, "assistant", "again")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    framed = "HEAD{{ nothing }}" + chat.CHATML + "TAIL"
    twice = "{% for m in messages %}{{ m.role }}{% endfor %}" + chat.CHATML

    def joined(template):
        parts = defaultdict(str)
        for r in sorted(chat.format_conversations(turns, template).collect(), key=lambda r: (r["conv_id"], r["chunk"])):
            parts[r["conv_id"]] += r["text"]
        return parts

    digests = lambda: sorted(tuple(r) for r in chat.conversation_digests(chat.format_conversations(turns)).collect())
    whole, said = [joined(t) for t in (framed, twice)], digests()
    n = chat.format_conversations(turns).count()
    monkeypatch.setattr(chat, "CHUNK_CHARS", 40)
    assert [joined(t) for t in (framed, twice)] == whole and digests() == said and chat.format_conversations(turns).count() > n + 10
    assert whole[0][1].startswith("HEAD<|im_start|>user") and whole[0][1].count("HEAD") == whole[0][1].count("TAIL") == 1
    assert {r[0]: r[5] for r in said} == {c: len(t) for c, t in joined(chat.CHATML).items()}
    assert chat.format_conversations(turns.limit(0)).count() == 0 and chat.conversation_digests(chat.format_conversations(turns.limit(0))).count() == 0
    assert [chat.read_once(chat.parse(t)) for t in (framed, twice, "{% if messages %}x{% endif %}", "{% for a in b %}{% for m in messages %}x{% endfor %}{% endfor %}")] == [True, False, False, False]


def test_template_language():
    show = lambda t, **v: "".join(x for x, _ in chat.compile_template(t)(v))
    assert show("{% for x in xs %}{% if x.n == 1 %}one{% elif x.n > 2 %}big{% else %}{{ x['n'] }}{% endif %},{% endfor %}{# c #}", xs=[{"n": 1}, {"n": 2}, {"n": 3}]) == "one,2,big,"
    assert chat.fold(chat.parse("a{{ 'x' ~ 'y' }}{% if 1 == 1 %}z{% else %}{{ q }}{% endif %}")) == (chat.Text("axyz"),)
    for bad in ("{% if x %}", "{{ x.__class__() }}", "{{ x|nope }}", "{% endfor %}", "{{ }}", "{% boo %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    for x in ("<|", "<\\|", "<\\\\|a<||", ""):
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)


def test_pipeline(spark):
    import corpus_pipeline

    frame, ids = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, SF)
        assert frame.columns == list(corpus_pipeline.COLUMNS), name
        frame = frame.checkpoint()
        now = {r[0] for r in frame.select("doc_id").collect()}
        assert now and (ids is None or now <= ids if name != "mix_sources" else now == ids)
        ids = now
    packed = corpus_pipeline.pack(spark, frame, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids


def test_pipeline_keeps_documents_without_an_id(spark):
    import corpus_pipeline

    one = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    rows = one.unionByName(one.limit(40).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("entirely other words here "), "text"))).checkpoint()
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.language_id(spark, rows, SF), SF)
    want = {r[0] for r in rows.filter("doc_id is null").select("text").collect()}
    assert {r[0] for r in kept.filter("doc_id is null").select("text").collect()} == want and len(want) > 30


def test_pipeline_identifies_each_document_once(spark, monkeypatch):
    import corpus_pipeline

    seen, words_of = spark.sparkContext.accumulator(0), langid.words_of
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, model = docs.count(), langid.learn(docs)

    def counted(text):
        seen.add(1)
        return words_of(text)

    monkeypatch.setattr(langid, "words_of", counted)
    monkeypatch.setattr(langid, "learn", lambda docs: model)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    assert corpus_pipeline.run(spark, SF).count() >= n // 2 and seen.value == n


def test_stages_take_awkward_rows(spark):
    import corpus_pipeline

    rows = [(i, t, None, None, None, "clash", "x") for i, t in enumerate(TEXTS)] + [(None, None, None, None, None, None, None), (None, "no id", "en", "s", 1, "c", "x"), (4, "one", None, None, None, "clash", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, place string").checkpoint()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert name == "pack" or got.columns == list(corpus_pipeline.COLUMNS)
        assert got.count() > 0 and stage(spark, docs.limit(0), SF).count() == 0, name


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
