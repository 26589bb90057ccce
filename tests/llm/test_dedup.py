"""Suffix dedup, SimHash, components and repetition inside a text."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from loglattice.llm import components, near_copies, repetition, simhash, suffix_dedup


def brute_removal(rows, length):
    seen = Counter(d[k : k + length] for _, d in rows for k in range(len(d) - length + 1))
    out = []
    for i, d in rows:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i or -1, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_rows(prose):
    rng = random.Random(8)
    passage, licence = prose(60, seed=11), prose(40, seed=12)
    rows = [(i, f"{prose(rng.randint(5, 60))} {passage if i % 3 == 0 else ''} {prose(20)} {licence[: rng.randint(50, 250)] if i % 4 == 0 else ''}") for i in range(60)]
    base = prose(120, seed=13).split()
    for i in range(60, 100):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    return [*rows, (100, rows[0][1]), (101, passage), (102, "ab" * 300), (103, "z" * 199), (104, "z" * 150)]


@pytest.mark.parametrize("group", [256, 4])
@pytest.mark.parametrize("run", [1 << 22, 1 << 11])
def test_suffix_dedup(spark, make_docs, prose, odd_rows, group, run, monkeypatch):
    """Also with grams over all tasks, and with texts cut into several runs."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BLOCKS", group)
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    rows = repeated_rows(prose) + [(i if i is None else i + 1000, t) for i, t in odd_rows]
    got = suffix_dedup.removal_report(make_docs(rows).repartition(5)).collect()
    assert sorted((r["doc_id"] or -1, *list(r)[1:]) for r in got) == brute_removal([(i, (t or "").encode()) for i, t in rows], 200)


def test_radix_passes():
    rng = random.Random(3)
    for depth in (1, 7, 8, 9, 30):
        for letters in ("ab", "abcdefgh"):
            data = "".join(rng.choice(letters) for _ in range(300)).encode()
            starts = np.array(sorted(rng.sample(range(300 - depth), 200)))
            group = np.array([rng.randrange(3) for _ in starts])
            seen = Counter((g, data[a : a + depth]) for g, a in zip(group, starts))
            want = [seen[g, data[a : a + depth]] > 1 for g, a in zip(group, starts)]
            assert suffix_dedup.repeated_suffixes(np.frombuffer(data, np.uint8), starts, group, depth).tolist() == want


@pytest.mark.parametrize("group", [256, 4])
def test_many_repeated_rows_have_the_spans_of_one(spark, make_docs, prose, group, monkeypatch):
    """Rows that agree in id and text, and others that share parts of it."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BLOCKS", group)
    text = prose(300, seed=3)
    rows = [(1, text)] * 300 + [(k, prose(30, seed=k) + text[7 * k : 7 * k + 400]) for k in range(2, 12)]
    docs = make_docs(rows)
    made = suffix_dedup.with_spans(docs).select("doc.doc_id", "spans").collect()
    own = {len(r["spans"]) for r in made if r["doc_id"] == 1}
    assert len(own) == 1 and max(own) < len(text) / 20 and len(made) == len(rows)
    got = suffix_dedup.removal_report(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_removal([(i, t.encode()) for i, t in rows], 200)


def test_removal_keeps_columns(spark, make_docs, prose):
    passage = prose(60, seed=11)
    docs = make_docs([(1, f"first {passage}"), (2, f"{passage} second"), (3, passage), (4, None), (5, "")])
    left = suffix_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["__doc"]) for r in left.collect()) == [(1, "first", 7), (2, " second", 7), (4, None, 7), (5, "", 7)] or [r["doc_id"] for r in left.collect()]
    assert suffix_dedup.removal_report(docs.filter("false")).count() == 0


def brute_fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, make_docs, prose, odd_rows):
    rng = random.Random(2)
    base = prose(400, seed=21).split()
    rows = [(i, prose(50)) for i in range(20)]
    for i in range(20, 60):
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["of", "zz", "Q"])
        rows.append((i, " ".join(words)))
    rows += [(i if i is None else i + 1000, t) for i, t in odd_rows]
    docs = make_docs(rows).repartition(4)
    prints = [brute_fingerprint(t or "") for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    root = union(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted((i or -1, f"{p:016x}", least.get(root[k], -1)) for k, ((i, _), p) in enumerate(zip(rows, prints)))
    for passes in (1, 3):
        got = simhash.near_duplicates(docs, passes=passes).collect()
        assert sorted((r["doc_id"] or -1, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(set(root.values()))


def test_ball_meets_all_links():
    rng = random.Random(1)
    near = set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            near.add(x)
    fps = np.array(sorted(near), np.uint64)
    odd = np.bitwise_count(fps) % 2 == 1
    parts = [((f[:, None] ^ simhash.MASKS[ball]).ravel(), np.tile(ball.astype(np.int32), len(f))) for ball, f in ((simhash.EVEN_BALL, fps[~odd]), (simhash.ODD_BALL, fps[odd]))]
    a, b = simhash.meet(*(np.concatenate(x) for x in zip(*parts)))
    true = [(int(x), int(y)) for k, x in enumerate(fps) for y in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ x) <= 3]]
    found = list(zip(a.tolist(), b.tolist()))
    assert set(found) <= set(true)
    assert union(fps.tolist(), found) == union(fps.tolist(), true)


@pytest.mark.parametrize("at_once", [500_000, 30])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "FOREST_LINKS", at_once)
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r["node"]: r["root"] for r in got} == union(nodes, [p for p in pairs if p[0] != p[1]]) and len(got) == len(nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(words):
    out = []
    for a in range(len(words)):
        best = 0
        for b in range(len(words)):
            n = 0
            while a != b and max(a, b) + n < len(words) and words[a + n] == words[b + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def covered(words, repeats, least):
    inside = set()
    for a, n in enumerate(repeats):
        if n >= least:
            inside |= set(range(a, a + n))
    return len(inside)


def test_repetition(spark, make_docs, odd_rows, prose):
    rng = random.Random(3)
    line = "again and again the very same nine words here"
    rows = [*odd_rows[:5], *odd_rows[6:]]
    rows += [(20, "\n".join([line] * 20)), (21, prose(120, seed=5)), (22, prose(60, seed=6) + "\n" + line + "\n" + prose(60, seed=7) + "\n" + line), (23, " ".join(rng.choice("abc") for _ in range(70))), (24, "# $% " * 30)]
    got = {}
    for r in repetition.check_repetition(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in rows:
        if i is None:
            continue
        words, lines = (t or "").encode().split(), [x for x in (t or "").split("\n") if x.encode().split()]
        repeats = brute_repeats(words)
        three = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(3)}
        base = (len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        cover, longest = covered(words, repeats, repetition.MIN_WORDS), max(repeats, default=0)
        bad = cover > repetition.MAX_COVERED * len(words) or (longest >= repetition.MIN_WORDS and longest > repetition.MAX_LONGEST * len(words))
        assert tuple(got[i])[1:] == (*base, cover, longest, failed, not failed and not bad)
    assert got[21]["kept"] and got[22]["kept"] and not got[20]["kept"]
    assert repetition.check_repetition(make_docs(rows).filter("false")).count() == 0


def test_each_repetition_limit_decides(spark, make_docs):
    """Texts that pass the base rule: clean, with many short repeats, with one long run, with a paragraph given twice."""
    fresh = lambda n, name: [f"{name}{k}" for k in range(n)]
    many = [w for p in range(3) for w in 2 * fresh(8, f"p{p}x")] + fresh(152, "m")
    run = [f"r{k % 5}" for k in range(36)] + fresh(164, "n")
    twice = fresh(45, "t") + fresh(110, "o") + fresh(45, "t")
    rows = [(1, " ".join(fresh(200, "c"))), (2, " ".join(many)), (3, " ".join(run)), (4, " ".join(twice)), (5, " ".join(fresh(182, "d") + 2 * fresh(9, "q")))]
    got = {r["doc_id"]: r for r in repetition.check_repetition(make_docs(rows)).collect()}
    assert [got[i]["n_words"] for i in got] == [200] * 5 and not any(r["base_failed"] for r in got.values())
    assert (got[2]["covered_words"], got[2]["longest_repeat"]) == (48, 8)
    assert (got[3]["covered_words"], got[3]["longest_repeat"]) == (36, 31)
    assert [got[i]["kept"] for i in (1, 2, 3, 4, 5)] == [True, False, False, False, True]


@pytest.mark.parametrize("small", [8, 2])
def test_similar_texts_by_brute_force(spark, make_docs, prose, odd_rows, small):
    """Copies with random changes around a similarity of 0.8, a common passage, and a crowd that differs in one word."""
    import corpus_pipeline

    rng = random.Random(12)
    passage, rows = prose(30, seed=41), [(i, f"{prose(60)} {prose(30, seed=41)}") for i in range(30)]
    for i in range(30, 130):
        words = prose(120, seed=50 + i % 20).split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(["of", "zz", "Q"])
        rows.append((i, " ".join(words)))
    rows += [(i, f"{passage} {prose(100, seed=42)} x{i}") for i in range(130, 170)]
    rows += [(i if i is None else i + 1000, t) for i, t in odd_rows]
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert any(10 * len(sets[a] & sets[b]) < 9 * len(sets[a] | sets[b]) for a, b in near)
    root, least = union(range(len(rows)), near), {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], 10**9), 10**9 if i is None else i)
    docs = make_docs(rows).repartition(4)
    left = near_copies.keep_one_similar(docs, small=small)
    assert left.columns == docs.columns
    want = sorted(least.values())
    assert sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in left.collect()) == want
    if small == 8:
        stage = corpus_pipeline.near_dedup(spark, docs, "")
        assert stage.columns == docs.columns and sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in stage.collect()) == want
        assert corpus_pipeline.near_dedup(spark, docs.filter("false"), "").count() == 0
        assert near_copies.keep_one_similar(docs.filter("false")).count() == 0
