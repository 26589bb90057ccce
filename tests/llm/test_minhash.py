"""Fingerprints and classes against brute force."""

import hashlib
import itertools
import random

import numpy as np

from loglattice.llm import minhash as m


def shingle_set(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_shingles_are_those_of_the_words(prose):
    """Equal hashes for equal shingles, and as many as there are, wherever a text stands in its block."""
    texts = [prose(n, seed=n) for n in (0, 1, 3, 4, 5, 6, 40, 300)] + ["", " \t\n", "A b", "a B ", "x" * 9000 + " y", "x" * 9000 + " y\v"]
    hashes, bounds = m.shingles([t.encode() for t in texts])
    each = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
    assert [len(e) for e in each] == [max(min(1, len(t.split())), len(t.split()) - 4) for t in texts]
    alone = [m.shingles([t.encode()])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(each, alone))
    known = {}
    for e, t in zip(each, texts):
        words = t.encode().lower().split()
        for k, h in enumerate(e.tolist()):
            assert known.setdefault(h, b" ".join(words[k : k + 5])) == b" ".join(words[k : k + 5])
    assert len(known) == len(set().union(*map(shingle_set, texts)))


def test_fingerprints_estimate_similarity(prose, monkeypatch):
    rng = random.Random(1)
    texts = []
    for k in range(40):
        words = prose(400, seed=k).split()
        at = rng.randint(0, 400)
        texts += [" ".join(words), " ".join(words[:at] + prose(400 - at, seed=1000 + k).split())]
    fp = m.fingerprints([t.encode() for t in texts])
    true = np.array([(lambda a, b: len(a & b) / len(a | b))(shingle_set(a), shingle_set(b)) for a, b in zip(texts[::2], texts[1::2])])
    off = m.likeness(fp[::2], fp[1::2]) - true
    assert np.abs(off).max() < 0.17 and abs(off.mean()) < 0.02
    monkeypatch.setattr(m, "BLOCK", 64)
    assert (m.fingerprints([t.encode() for t in texts]) == fp).all()


def test_documents_beside_the_next(spark, make_docs, odd_rows, prose):
    rows = [*odd_rows, *((20 + k, prose(1 + k % 50, seed=k)) for k in range(150))]
    rows[30] = (rows[30][0], rows[31][1])
    docs = make_docs(rows).repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = m.fingerprint(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) k").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), keys[r]))
    cell = lambda fp: fp.astype(">u2").tobytes().hex()
    want = []
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1]):
        a, b = a or "", b or ""
        half = len(a) // 2
        changed = (a[: len(a) - half] + b[:half]).encode()
        own, edited, after = m.fingerprints([a.encode(), changed, b.encode()])
        want.append((i or -1, len(a), hashlib.sha256(changed).hexdigest(), cell(own), cell(edited), float((own == edited).mean()), float((own == after).mean())))
    columns = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((r["doc_id"] or -1, *(r[c] for c in columns)) for r in got) == sorted(want)


def test_classes(spark, make_docs, prose, monkeypatch):
    """Groups of copies and near copies, one of them large, against all pairs."""
    monkeypatch.setattr(m, "HUBS", 2)
    rng = random.Random(4)
    rows, n = [], 100
    for group in range(30):
        words = prose(rng.randint(3, 120), seed=group).split()
        for _ in range(rng.choice([1, 1, 2, 3, 25])):
            mine = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 6])):
                mine[rng.randrange(len(mine))] = f"w{rng.randint(0, 999)}"
            rows.append((n := n + rng.randint(1, 3), " ".join(mine)))
    rows += [(5, None), (6, ""), (7, " \n"), (None, "only one of its kind")]
    got = {r["doc_id"]: r["class_id"] for r in m.fingerprint(make_docs(rows).repartition(3)).collect()}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t or "")) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    assert got == {i: find(i) for i in root} | {None: None}


def test_one_document_and_none(spark, make_docs):
    (r,) = m.fingerprint(make_docs([(3, "one two")])).collect()
    assert (r["near_next"], r["class_id"], r["n_chars"]) == (1.0, 3, 7)
    assert m.fingerprint(make_docs([(3, "x")]).filter("false")).count() == 0


def test_crowd_around_the_limit(spark, make_docs, prose, monkeypatch, tmp_path):
    """Texts that meet in one band, most of them unlike its least: every link counts, in crowds that several tasks share too."""
    rng = random.Random(8)
    words, rows = prose(150, seed=77).split(), []
    for n in range(90):
        mine = list(words)
        for at in rng.sample(range(150), rng.randint(4, 9)):
            mine[at] = f"w{rng.randint(0, 10**6)}"
        rows.append((n, " ".join(mine)))
    # Pairs that are like nothing else.
    for n in range(90, 130, 2):
        text = prose(60, seed=n)
        rows += [(n, text), (n + 1, f"{text} more")]
    sets = [shingle_set(t) for _, t in rows]
    least = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    assert len(set(least)) > 5
    # Everything meets in one band, as in a table with a crowd.
    monkeypatch.setattr(m, "_bands", one_band)
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    for crowd in (4096, 20):
        monkeypatch.setattr(m, "CROWD", crowd)
        got = {r["doc_id"]: r["class_id"] for r in m.op12_minhash(spark, str(tmp_path)).collect()}
        assert got == dict(enumerate(least))


def test_settled_bands_are_not_read_again(spark, make_docs, prose, monkeypatch):
    """Only a band with an unlike pair of its own and others left goes into a further round, and no link is lost."""
    words, many = prose(2000, seed=21).split(), range(40, 1950, 40)

    def changed(*places):
        return " ".join(f"w{n}" if n in places else w for n, w in enumerate(words))

    # 1 and 2 are alike, 3 is too short for them; 4 is unlike both, which bit maps don't show, and 5 is like 4.
    texts = {1: changed(), 2: changed(3), 3: " ".join(words[:500]), 4: changed(*many), 5: changed(3, *many)}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    alike = {(a, b) for a, b in itertools.combinations(texts, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert alike == {(1, 2), (4, 5)}
    met = {70: (1, 2, 3), 71: (1, 4), 72: (1, 2, 4, 5)}
    docs = make_docs(sorted(texts.items()))
    key = {r["doc_id"]: r["k"] for r in docs.selectExpr("doc_id", "xxhash64(text) k").collect()}
    bands = spark.createDataFrame([(band, key[i]) for band, ids in met.items() for i in ids], "band long, key long")
    monkeypatch.setattr(m, "_bands", nothing)
    read, to_try = [], m._to_try

    def noted(members, *rest):
        read.append({r["band"] for r in members.select("band").collect()})
        return to_try(members, *rest)

    monkeypatch.setattr(m, "_to_try", noted)
    fingered = docs.selectExpr("xxhash64(text) key", "cast('' as binary) fingerprint")
    found = {r["node"]: r["root"] for r in m.near_groups(fingered, docs, also=bands).collect()}
    assert {frozenset(i for i in key if found.get(key[i]) == root) for root in found.values()} == {frozenset(x) for x in alike}
    assert read[0] == set(met) and set().union(*read[1:]) == {72}


def nothing(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key").slice(0, 0)] * 2, ["band", "key"])


def one_band(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([7] * batch.num_rows, pa.int64()), batch.column("key")], ["band", "key"])


def test_one_stays_of_what_simhash_alone_finds(spark, make_docs, prose, monkeypatch):
    """Near copies that agree in no MinHash band meet by their SimHash fingerprints; what is unlike stays."""
    words = prose(400, seed=5).split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, prose(400, seed=6)), (4, "a b c"), (5, None), (6, " ")]
    a, b = m.simhash.fingerprints([t.encode() for _, t in rows[:2]], m.SHINGLE)
    assert a != b and int(a ^ b).bit_count() <= 3
    monkeypatch.setattr(m, "_bands", no_band)
    assert sorted(r["doc_id"] for r in m.keep_one_near(make_docs(rows)).collect()) == [1, 3, 4, 5]


def no_band(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("key")], ["band", "key"])
