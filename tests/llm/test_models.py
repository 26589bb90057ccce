"""Language model, toxicity, mixing, media and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import elias_fano, lm, matroska, mixing, toxicity


def test_words_of_one_hash_are_told_apart(spark, make_docs, prose, monkeypatch):
    """Local words are sorted by a hash alone: with one for all words, whose rows then mix over all batches, scores are the same."""
    docs = make_docs([(n, prose(60, seed=n)) for n in range(40)]).repartition(3)
    found = []
    for digest in (lm._digest, lambda word: lm.F.lit(5).cast("long") + 0 * lm.F.length(word)):
        monkeypatch.setattr(lm, "_digest", digest)
        rows = lm.score_documents(docs, block_bytes=500).collect()
        found.append(sorted((r["doc_id"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 40


@pytest.mark.parametrize("top", [1, 9, 1 << 20, (1 << 31) - 1])
def test_distinct_pairs(top):
    """Equal to plain sorting, also where a pair and its place don't fit in one number."""
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 3000):
        a, b = rng.integers(0, top, n), rng.integers(0, top, n)
        a[n // 2 :], b[n // 2 :] = a[: n - n // 2], b[: n - n // 2]
        pairs, back = np.unique((a << 32) | b, return_inverse=True)
        got = lm.distinct_pairs(a, b)
        assert (got[0] == pairs).all() and (got[1] == back).all() and len(got[1]) == n


@pytest.mark.parametrize("width", [0, 3, 40])
def test_elias_fano_over_many_values(width):
    """Look-ups go through more values than are taken at once."""
    values = np.sort(np.random.default_rng(width).integers(0, 70_000 << width, 70_000))
    made = elias_fano.EliasFano.of(values)
    asked = np.concatenate([values, values + 1, [0, int(values[-1]) + 5]])
    assert len(asked) > 4 * elias_fano.CHUNK and (made.get(np.arange(len(values))) == values).all()
    assert (made.successor(asked) == np.searchsorted(values, asked)).all()
    at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    assert (made.find(asked) == np.where(values[at] == asked, at, -1)).all()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (1000, 10), (1000, 10**9), (50, 3), (3000, 2**50)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    made, end = elias_fano.EliasFano.load(elias_fano.EliasFano.of(values).dump(), 0)
    assert end == len(made.dump()) and made.get(np.arange(n)).tolist() == values.tolist()
    asked = np.concatenate([values, values + 1, rng.integers(0, top + 5, 500)])
    assert made.successor(asked).tolist() == np.searchsorted(values, asked).tolist()


def test_level_in_a_mapped_file(tmp_path):
    """Found by searches on the packed form: what a level holds in memory is its file."""
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(50), rng.randrange(60)) for _ in range(400)})
    levels = np.array([rng.randrange(1, 256) for _ in pairs], np.uint8)
    context, word = (np.array(x) for x in zip(*pairs))
    (tmp_path / "level").write_bytes(elias_fano.Level.build(context, word, levels, context + 1))
    file = np.memmap(tmp_path / "level", np.uint8, "r")
    level = elias_fano.Level(file)
    parts = [a for ef in (level.contexts, level.pointers, level.shifts, level.words) for a in (ef.low, ef.high, ef.ones)] + [level.weights, level.levels]
    assert all(np.shares_memory(a, file) for a in parts if len(a))
    known = {p: k for k, p in enumerate(pairs)}
    asked = [(a, b) for a in range(52) for b in range(62)]
    at, place = level.find(*map(np.array, zip(*asked)))
    assert at.tolist() == [known.get(p, -1) for p in asked]
    assert level.levels[at[at >= 0]].tolist() == [levels[known[p]] for p in asked if p in known]
    contexts = sorted({a for a, _ in pairs})
    assert place.tolist() == [contexts.index(a) if a in contexts else -1 for a, _ in asked]
    assert all(level.weights[k] == c + 1 for k, c in enumerate(contexts))
    none = np.empty(0, np.int64)
    at, place = elias_fano.Level(elias_fano.Level.build(none, none, none, none)).find(np.array([1]), np.array([2]))
    assert at.tolist() == place.tolist() == [-1]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_scores(spark, make_docs, odd_rows, prose, order):
    """With several blocks a task, words of many tasks, and contexts that are spread over buckets."""
    rows = [(i, prose(40 + i)) for i in range(100, 160)] + odd_rows
    rows += [(i, " ".join(f"w{(i * 7 + k) % 30}" for k in range(40))) for i in range(200, 260)]  # one word follows from another
    got = lm.score_documents(make_docs(rows).repartition(3), last=order, block_bytes=2000, bucket_pairs=500).collect()
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    grams = Counter()
    for w, h in zip(tokens, out):
        if not h:
            grams.update((x,) for x in w)
            whole = [b"", *w]
            grams.update(tuple(whole[k : k + n]) for n in range(2, order + 1) for k in range(len(whole) - n + 1))
    ones = {x[0]: c for x, c in grams.items() if len(x) == 1}
    n, v = sum(ones.values()), len(ones)

    def chance(past, x):
        if not past:
            return (ones.get(x, 0) + 1) / (n + v + 1)
        k = lm.kappa_of(len(past) + 1, lm.KAPPA)
        return (grams[(*past, x)] + k * chance(past[1:], x)) / (grams[past] + k)

    want = []
    for (i, _), w, h in zip(rows, tokens, out):
        whole = [b"", *w]
        score = sum(math.log10(chance(tuple(whole[max(0, k - order + 1) : k]), whole[k])) for k in range(1, len(whole)))
        want.append((-1 if i is None else i, h, len(w), sum(x in ones for x in w), n, sum(math.log10(chance((), x)) for x in w), score))
    assert len(got) == len(want)
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for a, b in zip(sorted(((-1 if r[0] is None else r[0], *list(r)[1:]) for r in got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], abs=0.03 * b[2])
    held = [w for w in want if w[1] and w[0] >= 200]
    assert sum(w[6] for w in held) > sum(w[5] for w in held)


def test_lm_without_documents(spark, make_docs):
    assert lm.score_documents(make_docs([(1, "a")]).filter("false")).count() == 0


@pytest.mark.parametrize("rare", [1, 5, 10**6])
def test_neighbours_are_exact(rare):
    """With all terms frequent, some, and none."""
    rng = random.Random(5)
    made = []
    for _ in range(700):
        counts = {rng.randrange(5 + rng.randrange(60)): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        made.append((np.array(sorted(counts), np.uint64), np.array([counts[t] for t in sorted(counts)], np.int64)))
    index = toxicity.build_index(list(range(700)), [k % 3 == 0 for k in range(700)], made, rare)
    df = Counter(int(t) for h, _ in made for t in h)
    assert set(df) == set(index.terms.tolist())

    def unit(h, c):
        w = {int(t): (1 + math.log(n)) * index.weight[np.searchsorted(index.terms, t)] for t, n in zip(h, c.tolist()) if int(t) in df}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    for q in range(0, 700, 9):
        for without in (-1, int(np.flatnonzero(index.ids == q)[0])):
            mine = unit(*made[q])
            sims = {k: sum(x * unit(*made[int(i)]).get(t, 0) for t, x in mine.items()) for k, i in enumerate(index.ids) if k != without}
            best, cosines = toxicity.nearest(index, *toxicity.vector(index, *made[q]), without=without)
            want = sorted((s for s in sims.values() if s > 1e-6), reverse=True)[: toxicity.NEIGHBOURS]
            assert cosines.tolist() == pytest.approx(want, abs=1e-6) and len(set(best.tolist())) == len(best)
            assert all(sims[b] == pytest.approx(c, abs=1e-6) for b, c in zip(best.tolist(), cosines.tolist()))


def test_toxicity(spark, make_docs, odd_rows, prose):
    rng = random.Random(7)
    bad = ["grubling", "snorfel", "vexhag"]
    rows, labels = [], []
    for i in range(100, 400):
        words = prose(40).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(40)] = rng.choice(bad) + ("s" if rng.random() < 0.3 else "")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = make_docs(rows + odd_rows)
    known = spark.createDataFrame([*labels[:200], (None, 1), (5, None)], "doc_id long, toxic int")
    index = toxicity.learn(docs, known)
    scored = toxicity.score_toxicity(docs, index).select("__doc.*", "__score", "__evidence").collect()
    by = {r["doc_id"]: r for r in scored if (r["doc_id"] or 0) >= 300}
    assert len(scored) == len(rows) + len(odd_rows) and all(0 <= r["__score"] <= 1 for r in scored)
    assert all((by[i]["__score"] >= 0.5) == bool(y) for i, y in labels[200:])
    assert all(e["label"] == 1 for e in by[300]["__evidence"])
    assert all(r["__evidence"] for r in scored if (r["doc_id"] or 0) >= 100)
    for none in (known.filter("false"), known.filter("toxic = 0"), spark.createDataFrame([(77, 1)], "doc_id long, toxic int")):
        nothing = toxicity.learn(docs, none)
        assert {r["__score"] for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.5}
    assert not toxicity.learn(docs.filter("false"), known).learned
    twice = toxicity.learn(docs.union(docs), known)
    assert twice.ids.tolist() == index.ids.tolist() and np.allclose(twice.weight, index.weight)
    assert len(toxicity.learn(docs, known, max_examples=50).ids) == 50
    few = toxicity.learn(docs, known, max_postings=1000)
    assert len(few.value) + len(few.entry) <= 1000
    assert toxicity.score_toxicity(docs.filter("false"), index).count() == 0
    # Two texts with one id are two examples, and each is voted on by the others alone.
    other = toxicity.learn(docs.union(make_docs([(100, prose(40))])), known)
    assert len(other.ids) == len(index.ids) + 1 and (other.ids == 100).sum() == 2


def test_toxicity_calibration(spark, make_docs, prose):
    """Labels by chance teach nothing: no example has a part in its own vote, so scores stay near the rate."""
    rng = random.Random(11)
    rows = [(i, prose(30)) for i in range(200)]
    known = spark.createDataFrame([(i, int(rng.random() < 0.3)) for i, _ in rows], "doc_id long, toxic int")
    rate = known.agg({"toxic": "avg"}).first()[0]
    scores = [r[0] for r in toxicity.score_toxicity(make_docs(rows), toxicity.learn(make_docs(rows), known)).select("__score").collect()]
    fresh = [r[0] for r in toxicity.score_toxicity(make_docs([(i, prose(30)) for i in range(200, 300)]), toxicity.learn(make_docs(rows), known)).select("__score").collect()]
    assert len(scores) == 200 and abs(sum(fresh) / len(fresh) - rate) < 0.1 and max(fresh) < 0.7


def test_water_fill():
    t = mixing.water_fill({"b": 100, "a": 10, None: 50}, (5, 2, 1))
    assert t["a"] == 30 and t["b"] == pytest.approx(130 * 2 / 3) and t[None] == pytest.approx(130 / 3)
    assert mixing.water_fill({"a": 0}, (5.0,)) == {"a": 0} and mixing.water_fill({}, (1.0,)) == {}


def test_mixing_against_a_full_sort(spark, make_docs, prose, monkeypatch):
    """Also with documents of low quality, whose keys are long: no digit that is sorted holds more than a few rows."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(1, 30)) if i % 3 else "#%$ " * rng.randint(1, 30), "hot" if i % 2 else f"s{i % 5}") for i in range(900)]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") % 2 == 1, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))))
    seen = []
    plan_of = mixing._selection

    def spy(narrow, *more):
        plan = plan_of(narrow, *more)
        seen.append((narrow.collect(), plan))
        return plan

    monkeypatch.setattr(mixing, "_selection", spy)
    taken = {r["__doc"]["doc_id"]: r["__copies"] for r in mixing.mix(docs).collect()}
    assert len(taken) == len(rows)
    (narrow, plan), = seen
    for p in plan:
        own = sorted((r["__key"], r["__size"]) for r in narrow if r["__source"] == p["__s"])
        run, last = 0, -1.0
        for key, size in own:
            run += size
            if run - size / 2 <= p["__left"]:
                last = key
        assert sum(n * (p["__epochs"] + (k <= last)) for k, n in own) == sum(r["__size"] * (p["__epochs"] + (r["__number"] >> p["__shift"] < p["__edge"] or (r["__number"] >> p["__shift"] == p["__edge"] and r["__key"] <= p["__last"]))) for r in narrow if r["__source"] == p["__s"])
        assert sum(r["__number"] >> p["__shift"] == p["__edge"] for r in narrow if r["__source"] == p["__s"]) <= 10
        assert p["__edge"] == -1 or p["__shift"] < mixing.BITS


def test_mixing(spark, make_docs, odd_rows, prose, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    sources = ["hot"] * 200 + ["b"] * 20 + ["c"] * 40
    rows = [(i, prose(5 + i % 40), s) for i, s in enumerate(sources)] + [(i if i is None else i + 1000, t, "d") for i, t in odd_rows]
    docs = make_docs(rows)
    docs = docs.withColumn("source", F.when(F.col("source") != "c", F.col("source")))
    runs = [sorted((r["__doc"]["doc_id"] or -1, r["__size"], r["__source_size"], r["__target"], r["__copies"]) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    size = {i or -1: len((t or "").encode().split()) for i, t, _ in rows}
    assert all(r[1] == size[r[0]] for r in runs[0] if r[0] > 0)
    sums = {}
    for r in runs[0]:
        sums.setdefault((r[2], r[3]), []).append(r[1] * r[4])
        assert r[4] <= 3
    for (_, target), taken in sums.items():
        assert abs(sum(taken) - target) <= max(size.values())
    total = sum(n for n, _ in sums)
    assert sum(t for _, t in sums) == pytest.approx(total)
    assert mixing.mix(docs.filter("false")).count() == 0


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_matroska_round_trip(lacing):
    rng = random.Random(lacing)
    for n, frame in ((192, 192), (192 * 700, 192), (1000, 311), (5, 192), (0, 192), (70_000, 300)):
        data = rng.randbytes(n)
        stored = matroska.mux(data, frame, lacing)
        found, cues = matroska.parse(stored)
        assert b"".join(stored[p.offset : p.offset + p.size] for p in found) == data
        assert matroska.tail(stored, cues, 16) == data[-16:]
        assert [p.timestamp_ms for p in found] == sorted(p.timestamp_ms for p in found)


def test_matroska_unknown_sizes_and_groups():
    block = b"\x81\x00\x05\x00abc"
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    cluster = bytes.fromhex("1F43B675") + b"\xff" + matroska.number(matroska.TIMESTAMP, 100) + group
    stored = matroska.HEAD + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + cluster + cluster
    found, _ = matroska.parse(stored)
    assert [(p.track, p.timestamp_ms, stored[p.offset : p.offset + p.size], p.cluster, p.keyframe) for p in found] == [(1, 105, b"abc", 0, False), (1, 105, b"abc", 1, False)]
    with pytest.raises(ValueError):
        matroska.parse(b"\0\0\0\0")


def test_matroska_times():
    """A foreign scale, the track's duration of a packet, a block's own duration, and elements that end a cluster."""
    m = matroska
    info = m.element(m.INFO, m.number(m.TIMESTAMP_SCALE, 2_000_000))
    tracks = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + m.number(m.DEFAULT_DURATION, 7_000_000)) + m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 2)))
    laced = lambda track: bytes([0x80 | track]) + b"\x00\x03" + b"\x06" + m.lace([b"ab", b"cd", b"ef"], 3)
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, laced(2)) + m.number(m.BLOCK_DURATION, 6))
    cluster = bytes.fromhex("1F43B675") + b"\xff" + m.number(m.TIMESTAMP, 10) + m.element(m.SIMPLE_BLOCK, laced(1)) + m.element(m.SIMPLE_BLOCK, laced(2)) + group
    for end in (m.SEEK_HEAD, m.TAGS, m.CHAPTERS, m.ATTACHMENTS, m.CUES):
        stored = m.HEAD + m.element(m.SEGMENT, info + tracks + cluster + m.element(end, b""))
        found, _ = m.parse(stored)
        assert [p.timestamp_ms for p in found] == [26, 33, 40, 26, 26, 26, 26, 30, 34]
        assert [stored[p.offset : p.offset + p.size] for p in found] == [b"ab", b"cd", b"ef"] * 3
    own, _ = m.parse(m.mux(b"x" * 192 * 20))
    assert [p.timestamp_ms for p in own] == [24 * k for k in range(20)]


def test_media_is_stored(spark, tmp_path, make_docs, odd_rows):
    """The query reads media files of the shared folder; its rows against plain computing."""
    make_docs(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    made = matroska.op5_matroska(spark, str(tmp_path))
    assert any("/media-" in f for f in made.inputFiles())
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_sha256"], r["n_packets"]) for r in made.collect())
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((i or -1, len(raw), hashlib.sha256(padded).hexdigest(), len(padded) // 192))
    assert got == sorted(want)
    empty = tmp_path / "empty"
    make_docs(odd_rows).filter("false").write.parquet(str(empty / "documents.parquet"))
    assert matroska.op5_matroska(spark, str(empty)).count() == 0


def test_media_columns(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    media = matroska.with_media(docs)
    assert media.columns == [*docs.columns, "media"]
    table = matroska.packets(media, "doc_id")
    assert table.filter("id = 3").count() == 1 and table.filter("size <> 192").count() == 0
    got = matroska.read_media(media.withColumn("__n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "doc_id").collect()
    want = []
    for i, t in odd_rows:
        raw = (t or "").encode()
        raw += b" " * (-len(raw) % 192 if raw else 192)
        want.append((i or -1, len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:])))
    assert sorted((r[0] or -1, *list(r)[1:5]) for r in got) == sorted(want)
    assert matroska.packets(media.filter("false"), "doc_id").count() == 0


def test_pipeline_stages(spark, tmp_path, prose):
    import corpus_pipeline

    bad = ["grubling", "snorfel", "vexhag"]
    passage = prose(70, seed=31)
    rows, labels = [], []
    for i in range(300):
        words = prose(80).split()
        if i % 5 == 0:
            words[3], words[9] = bad[i % 3], bad[(i + 1) % 3]
        text = " ".join(words) + (f" {passage}" if i in (101, 102) else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    copy = rows[7][1]
    rows += [(900, copy, "fr", "s1", len(copy)), (901, None, None, None, None), (902, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not any(i % 5 == 0 for i in seen["toxicity"] if i < 300) and {i for i in range(300) if i % 5} <= set(seen["toxicity"])
    assert 900 not in seen["near_dedup"] and set(seen["toxicity"]) - set(seen["near_dedup"]) == {900, 902}
    assert not any(passage[10:-10] in (r["text"] or "") for r in seen["suffix_dedup"].values())
    assert all(seen["suffix_dedup"][i]["text"] == r["text"] for i, r in seen["near_dedup"].items() if i not in (101, 102))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
