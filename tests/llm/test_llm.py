"""The operators for training data against brute force on small tables, with the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from fleetlens.llm import ann, bpe, exact_dedup, license_scan, line_dedup, near_dedup, packing, sharding, token_file, toxicity

SCHEMA = "doc_id long, text string, digest string, n int, key string, kept boolean"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "délta", "zeta's", "x1", "it's", "日本語", "!!", "foo.bar"]
    base = [" ".join(rng.choice(words) + rng.choice(["", "", "q", "z9"]) for _ in range(rng.randrange(30, 60))) for _ in range(12)]
    out = [None, "", "   ", "one", "One", "two words", "a\n\nb  c\t d", "É É É", "long " * 4000, "nospaces" * 60]
    for b in base:
        out += [b, b.upper(), b]
        w = b.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash", 1, "k", True) for i, t in enumerate(texts())]
    rows += [rows[12], (None, "one", "c", 1, "k", None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_tree_merge_levels(spark):
    rows = [(i, f"t{i % 7}" if i % 3 else "hot") for i in range(400)] + [(None, "hot"), (None, "alone")]
    d = exact_dedup.with_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(23)).checkpoint()
    level = exact_dedup.first_runs(d).checkpoint()
    runs = {r["run"] for r in level.collect()}
    assert len(runs) > 16
    for turn in range(exact_dedup.RUN_BITS // exact_dedup.FAN_BITS):
        block = 1 << (turn + 1) * exact_dedup.FAN_BITS
        want = {}
        for r in level.collect():
            lo, hi, n = want.get((r["run"] // block * block, r["digest"]), (None, None, 0))
            ids = [x for x in (lo, hi, r["low"] and r["low"][0], r["high"] and r["high"][0]) if x is not None]
            want[r["run"] // block * block, r["digest"]] = (min(ids, default=None), max(ids, default=None), n + r["rows"])
        merged = exact_dedup.merge_round(level, turn)
        assert "SortAggregate" in merged._jdf.queryExecution().toString()
        level = merged.checkpoint()
        assert {(r["run"], r["digest"]): (r["low"] and r["low"][0], r["high"] and r["high"][0], r["rows"]) for r in level.collect()} == want
    assert {r["run"] for r in level.collect()} == {0}


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in table(docs):
        groups[t.translate(LOW)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    named = [i for i, _ in table(left) if i is not None]
    assert sorted(named) == sorted(max(i for i in ids if i is not None) for ids in groups.values() if any(i is not None for i in ids))


def brute_near(pairs, k):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    low = {}
    for i in sets:
        low.setdefault(find(i), []).append(i)
    return {i: (len(sets[i]), min(low[find(i)])) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup(docs, empty, k):
    want = brute_near([(i, t) for i, t in table(docs) if i is not None], k)
    got = near_dedup.near_dedup(docs, k=k).collect()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert len(got) == docs.count()
    assert near_dedup.near_dedup(empty, k=k).count() == 0


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Groups beyond the small limit go through the blocks and lose no link."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        v = list(base)
        for _ in range(rng.randrange(1, 5)):
            v[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    want = brute_near(rows, 2)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in want.items()}


def test_bpe_against_the_library(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for i, t in table(docs):
        ids = enc.encode_ordinary(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.encode_documents(docs, path).collect()) == want
    assert bpe.encode_documents(empty, path).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_file_round_trip(docs, empty, bits):
    path = P.path("byte_bpe_50k.json")
    from fleetlens.llm.tokens import tokenizer

    t = tokenizer(path)
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    at, want = 0, []
    for i, x in sorted(table(named)):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_file.token_round_trip(named, path, bits=bits).collect()) == want
    assert token_file.token_round_trip(docs, path).count() == docs.count()
    assert token_file.token_round_trip(empty, path).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint32)
    for bits in (False, True):
        assert (token_file.from_planes(token_file.to_planes(ids, bits), len(ids), bits) == ids).all()


def test_packing(docs, empty):
    path = P.path("word_bpe_49k.json")
    from fleetlens.llm.tokens import tokenizer

    t = tokenizer(path)
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack_documents(named, path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, x in table(named):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    full = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        full += at == 2048
    assert full >= len(sequences) - 1
    assert packing.pack_documents(empty, path).count() == 0
    assert packing.padded(1024) == 1024 and packing.padded(1500) == 2048


def test_sharding(docs, empty):
    got = sharding.shard_rows(docs, 8).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(8)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in table(docs))
    assert sharding.shard_rows(empty).count() == 0


def test_ring_overflow_moves_only_what_is_over():
    counts = {7: 1000, 9: 10, 2000: 10}
    got = sharding.place(counts, 4)
    total = Counter()
    for cell, first, shard, _ in got:
        following = [f for c, f, _, _ in got if c == cell and f > first]
        total[shard] += min(following, default=counts[cell]) - first
    assert sum(total.values()) == 1020 and max(total.values()) - min(total.values()) <= 1


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:400] = x[100]  # a third of all vectors are one
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (None, x[0].tolist()), (960, [None] * 16)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20, k=20).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(np.float64)
    hit = 0
    assert sorted(by) == list(range(0, 900, 20))
    for q in by:
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:20]
        mine = [v for _, v, _ in sorted(by[q])]
        assert [r for r, _, _ in sorted(by[q])] == list(range(1, 21)) and q not in mine
        hit += len(set(want) & set(mine))
    assert hit / (20 * len(by)) >= 0.95
    copies = [v for _, v, _ in sorted(by[120]) if 100 <= v < 400]
    assert copies and copies == [i for i in range(100, 400) if i != 120][: len(copies)]  # ties go to the smaller id
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(none).count() == 0


def test_nearest_neighbours_of_a_tiny_cluster(spark, monkeypatch):
    """Tight clusters: the ratio lets a query visit its own list only, and the first one holds 5 vectors."""
    rng = np.random.default_rng(8)
    sizes = [5, 3, 2, *[30] * 9]
    axis = np.repeat(np.arange(len(sizes)), sizes)
    x = np.eye(16)[axis] + rng.normal(scale=1e-3, size=(len(axis), 16))
    x = (x / np.sqrt((x**2).sum(axis=1))[:, None]).astype(np.float32)
    monkeypatch.setattr(ann, "fit_centroids", lambda *a: np.hstack([np.eye(16)[: len(sizes)], np.zeros((len(sizes), 1))]))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for probes in (64, 2):
        by = defaultdict(list)
        for r in ann.nearest_neighbours(d, every=1, k=20, probes=probes).collect():
            by[r["query_id"]].append(r["vec_id"])
        assert {q: len(set(v) - {q}) for q, v in by.items()} == dict.fromkeys(range(len(x)), 20)
    few = {r["query_id"]: r["n"] for r in ann.nearest_neighbours(d.where("vec_id < 9"), every=1, k=20).groupBy("query_id").agg({"*": "count"}).toDF("query_id", "n").collect()}
    assert few == dict.fromkeys(range(9), 8)


def test_line_dedup(spark):
    a = "the quick brown fox jumps over the lazy dog"
    b = "the quick brown fox jumped over the lazy dog"  # two edits
    c = "the quick green fox jumps over the lazy dog"  # more
    rows = [(1, f"{a}\nshort\n\n{c}"), (2, f"  {b}  \nshort\nshorx"), (3, None), (4, a), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], list(r["dropped"])) for r in line_dedup.line_verdicts(d).collect()}
    assert got == {1: (3, 0, []), 2: (3, 2, [0, 1]), 3: (0, 0, []), 4: (1, 1, [0]), 5: (0, 0, [])}
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(d).collect()}[2] == "shorx"
    assert line_dedup.line_verdicts(d.limit(0)).count() == 0


def edit_distance(x, y):
    """The plain table of distances between prefixes."""
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row = row, [i]
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_line_verifier_against_plain_distances(monkeypatch):
    rng = random.Random(5)
    a, b = [], []
    for _ in range(400):
        x = [rng.choice("abé日\U0001F600 ") for _ in range(rng.randrange(1, 40))]
        y = list(x)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = rng.choice(["", "q", "é"])
        a.append("".join(x))
        b.append("".join(y))
    a += ["", "", "x" * 70_000, "x" * 70_000]
    b += ["", "abc", "x" * 34_999 + "y" + "x" * 35_002, "y" * 70_000]
    want = [edit_distance(x, y) for x, y in zip(a[:-2], b[:-2], strict=True)] + [2, 70_000]
    for cells in (line_dedup.CELLS, 300):
        monkeypatch.setattr(line_dedup, "CELLS", cells)
        for edits in (1, 2, 3):
            assert line_dedup.near_pairs(a, b, edits).tolist() == [w <= edits for w in want]


def test_lines_that_differ_in_a_number_give_few_links(spark):
    lines = [f"printed at the harbour office, page {i:02d} of the yearly book, shelf {j:02d} of the archive" for i in range(40) for j in range(50)]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(7)
    _, links = line_dedup.similar_lines(line_dedup.lines_of(d))
    assert links.count() < 6 * len(lines)
    assert [r["doc_id"] for r in line_dedup.line_verdicts(d).where("n_dropped = 0").collect()] == [0]


def test_line_dedup_awkward_rows(spark):
    x, y = "a line that is long enough to compare", "a line that is long enough to compara"
    schema = "doc_id long, text string, line string, sig long, pos int, hash long, dropped string"
    rows = [(7, x), (7, x), (None, y), (3, None), (3, ""), (5, "z" * 300_000), (6, "z" * 299_999 + "q"), (8, f"{x}\r\n\n{y}\n ")]
    d = spark.createDataFrame([(i, t, "c", 1, 2, 3, "d") for i, t in rows], schema)
    got = {r["doc_id"]: (r["n_lines"], list(r["dropped"])) for r in line_dedup.line_verdicts(d).collect()}
    assert got == {None: (1, []), 3: (0, []), 5: (1, []), 6: (1, [0]), 7: (2, [0]), 8: (2, [0, 2])}
    out = line_dedup.drop_repeated_lines(d)
    assert out.columns == d.columns
    assert sorted((str(r["doc_id"]), str(r["text"])[:6]) for r in out.collect() if r["doc_id"] != 8) == sorted([("7", ""), ("7", ""), ("None", "a line"), ("3", "None"), ("3", ""), ("5", "zzzzzz"), ("6", "")])


def test_line_dedup_against_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    lines = []
    for _ in range(12):
        base = "".join(rng.choice("abcd ") for _ in range(40)).strip() + "e"
        for _ in range(8):
            v = list(base)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(len(v))] = rng.choice("xyz")
            lines.append("".join(v).strip())
    lines = list(dict.fromkeys(lines))

    near = lambda x, y: edit_distance(x, y) <= 2
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if near(lines[i], lines[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for small, hashes in ((32, 1_000_000), (2, 0)):  # by pairs and broadcasts, then by blocks and shuffles
        monkeypatch.setattr(line_dedup, "SMALL", small)
        monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", hashes)
        kept = {r["doc_id"] for r in line_dedup.line_verdicts(d).where("n_dropped = 0").collect()}
        assert kept == set(group)


WRAPPED = {
    "mit": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions of source code must retain the above copyright",
    "apache-2.0": "   Licensed under the Apache\n   License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance\n   with the License. You may obtain a copy\n   of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


def test_license_scan_joins_wrapped_lines(spark):
    prose = "\n".join("A quiet river runs past the old mill and the boats lie there in rows all day" for _ in range(60))
    cases = []
    for family, notice in WRAPPED.items():
        commented = "\n".join(f" * {x}" if x else "" for x in notice.split("\n"))
        cases += [(family, notice), (family, notice.replace("\n", "\r\n")), (family, commented), (family, f"{prose}\n{notice}\n{prose}"), (family, f"{prose} {notice}".replace("\n", " "))]
    cases += [("cc-by-nc", f"{prose}\nLicensed under CC\nBY-NC 4.0."), (None, prose), (None, f"{prose}\nHe had the permission\nof his father and a driving\nlicense.\n{prose}")]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(d).collect()}
    assert got == {i: f for i, (f, _) in enumerate(cases)}


def test_license_scan(spark):
    rows = [
        (1, "Some prose here.\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."),
        (5, "He had a driving license and the permission of his father."), (6, None), (7, ""), (8, "plain text\n" * 50),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(d).collect()}
    assert got == {1: "apache-2.0", 2: "mit", 3: "gpl", 4: "cc-by-nc", 5: None, 6: None, 7: None, 8: None}
    assert license_scan.scan_licenses(d.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = rng.choices(clean, k=30)
        y = int(rng.random() < 0.2)
        if y:
            w[rng.randrange(30)] = rng.choice(["Nastyword", "vilething", "zorgab" + rng.choice(clean), "zorgab" + rng.choice(clean)])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, y))
    rows += [(2000, None, None), (2001, "", "x"), (None, "a nastyword", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, lab).collect()}
    held = [(y, got[i]["predicted"]) for i, y in labels if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert sum(y == p for y, p in held) / len(held) > 0.97
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(d, lab)
    assert kept.columns == d.columns and kept.where("doc_id is null").count() == 0
    assert toxicity.score_documents(d.limit(0), lab).count() == 0
    assert {r["score"] for r in toxicity.score_documents(d, lab.limit(0)).collect()} == {0.5}


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.Random(i).sample(words, 40)), "en", "s", 1) for i in range(30)]
    rows += [(100, rows[0][1].upper(), "en", "s", 1), (101, rows[1][1] + " more", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "packing"]
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {100, *range(1, 30)}


def test_bpe_long_and_late_words(spark):

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    blob = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCD") for _ in range(n))
    # a blob of 50,000 letters, lengths around the fold's limit, letters that this JVM doesn't know
    texts = [blob(50_000), blob(511), " " + blob(511), blob(513), "a" * 700, "\U0001E4D0\U0001E4D1 \U00010D4Aabc", "x  y\n\n z's 12345 \u00e9"]
    got = {r["doc_id"]: r for r in bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_large_near_group_is_linked_in_few_links(spark):
    """A group of over 1000 near copies, among them a row apart: what the rounds and blocks find is what brute force finds."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 60 + i % 40] + [f"own{i}", f"own{i}b"] + base[60 + i % 40 :])) for i in range(1200)]
    rows += [(5000 + i, " ".join(base[:60] + [f"x{i}_{j}" for j in range(60)])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert {got[i] for i in range(1200)} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(40))


def test_toxicity_repeated_and_long_rows(spark):
    long = "fine words here " * 50_000
    # texts of their own, since copies count once when voters are mined
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{c}" for c in "abc")
    rows = [(i, f"{own(i)} you utter scumbag go away {own(i + 60)}" if i % 2 else f"{own(i)} a calm and pleasant day {own(i + 60)}") for i in range(60)]
    rows += [(1, rows[1][1]), (900, long), (901, None), (902, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (901, 902)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert next(r["predicted"] for r in got if r["doc_id"] == 900) == 0


def test_neighbours_over_many_lists(spark, monkeypatch):
    """Unevenly clustered vectors of uneven norms over more than 50 lists: pruning acts and recall stays high."""
    rng = np.random.default_rng(3)
    n = 16_000
    centre = rng.normal(size=(80, 24)) * 2
    own = rng.zipf(1.5, n) % 80
    x = (centre[own] + rng.normal(size=(n, 24)) * 0.6) * rng.lognormal(0, 0.5, n)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = {}
    plain = ann.router
    monkeypatch.setattr(ann, "router", lambda lists, *a: seen.update(lists=len(lists.c), parts=int(lists.parts.sum())) or plain(lists, *a))
    got = defaultdict(set)
    for r in ann.nearest_neighbours(df, every=20, k=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert seen["lists"] > 50
    hits = 0
    for i in range(0, n, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits >= 0.95 * 20 * (n // 20)


def test_neighbours_awkward(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 7), (20, [0.5, 0.5], 7), (20, [0.5, 0.5], 7), (3, [0.0, 1.0], 7), (None, [1.0, 1.0], 7)], "vec_id long, embedding array<double>, score long")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest_neighbours(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    with pytest.raises(ValueError, match="components"):
        ann.nearest_neighbours(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
