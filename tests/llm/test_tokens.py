"""Bit-plane shards, packing and word-piece counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from loglattice.llm import bitplane, packing, wordpiece
from loglattice.llm.bpe import BpeEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(plain):
    rng = random.Random(1)
    letters = list(" \t\n\r\x0b\x1c\x85\xa0᠎　ab'sé1²,.!<|endoftext|>́\U0001f600")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["", " ", "it's 'sa", "<|endoftext|> a"]
    ids, at = BpeEncoder(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 100, 4096, 10001])
def test_shard_round_trip(planes, n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << rng.integers(1, 32), n).astype(np.uint32)
    reader = bitplane.ShardReader(bitplane.pack_shard([None, -5, 3], np.array([0, n, 0]), ids, planes, 1000))
    assert reader.ids().tolist() == ids.tolist() and reader.doc_ids == [None, -5, 3] and reader.sizes.tolist() == [0, n, 0]
    if n > 1000:
        assert reader.block(1).tolist() == ids[1000:2000].tolist()
    with pytest.raises(ValueError):
        bitplane.ShardReader(b"x" * 100)


@pytest.mark.parametrize("shard_ids", [1 << 20, 500])
def test_shards_of_documents(spark, make_docs, odd_rows, plain, shard_ids):
    docs = make_docs(odd_rows).repartition(3)
    got = bitplane.read_shards(bitplane.write_shards(docs, PATH, block_ids=256, shard_ids=shard_ids), with_ids=True).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] or -1 for r in got] == sorted(i or -1 for i, _ in odd_rows)
    by_text = sorted((i or -1, plain(t) + [0]) for i, t in odd_rows)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == by_text
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), crc(r["ids"]))
        at += r["n_tokens"]


def test_no_documents(spark, make_docs):
    empty = make_docs([(1, "a")]).filter("false")
    assert bitplane.read_shards(bitplane.write_shards(empty, PATH)).count() == 0
    assert packing.pack(empty, PATH).count() == 0
    assert wordpiece.count_pieces(empty, [b"a"], [b"a"]).count() == 0


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, make_docs, odd_rows, plain, length):
    docs = make_docs(odd_rows).repartition(3)
    rows = packing.pack(docs, PATH, length=length).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["sequence_id"], []).append(r)
    for own in parts.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= length
    # In the order of sequences and offsets the pieces are the documents in order.
    stream = [r for s in sorted(parts) for r in parts[s]]
    want = sorted(((i if i is not None else -1), plain(t) + [1]) for i, t in odd_rows)
    assert sum(r["length"] for r in stream) == sum(len(ids) for _, ids in want)
    ids = {i: x for i, x in want if i > 0 and i != 7}
    done = dict.fromkeys(ids, 0)
    for r in stream:
        if r["doc_id"] in ids:
            own = ids[r["doc_id"]]
            assert r["start"] == done[r["doc_id"]] and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == crc(own[r["start"] : r["start"] + r["length"]])
            done[r["doc_id"]] += r["length"]
    assert done == {i: len(x) for i, x in ids.items()}


def test_cuts_are_the_best():
    rng = random.Random(4)
    for _ in range(200):
        places = sorted({0, *(rng.randrange(1, 60) for _ in range(rng.randint(1, 14)))})
        length = max(b - a for a, b in zip(places, places[1:])) + rng.randint(0, 10)
        cost = [0, *(rng.choice([0, 3, 20]) for _ in places[1:])]
        best = {0: 0}
        for j, p in enumerate(places[1:], 1):
            best[p] = min(best[q] + length - (p - q) for q in places[:j] if p - q <= length) + cost[j]
        cuts = packing.best_cuts(np.array(places), np.array(cost), length)
        assert cuts[0] == 0 and cuts[-1] == places[-1]
        assert sum(length - (b - a) + cost[places.index(b)] for a, b in zip(cuts, cuts[1:])) == best[places[-1]]


def test_places_of_cuts():
    """Ends of documents and sentences; places in between only in gaps over a 32nd of a sequence, dearer than both."""
    ends = np.zeros(1000, bool)
    ends[[9, 19, 29, 899]] = True
    at, cost = packing.candidates(ends, np.array([25, 1000]), 512)
    inner = at[cost == 12]
    assert at[cost == 0].tolist() == [0, 25, 1000] and at[cost == 2].tolist() == [10, 20, 30, 900]
    assert ((inner > 30) & (inner != 900)).all() and np.diff(at[at >= 30]).max() <= 4


def test_sentence_ends_of_scripts():
    """Against the text itself, however the vocabulary cuts the stops."""
    t, ends = Tokenizer.from_file(PATH), packing.sentence_ends(BpeEncoder(PATH))
    for text in ("One. Two! (Three?) four\nfive", "一句话。再一句！真的吗？好的｡嗯", "यह है। वह है॥ और", "هل؟ نعم۔ لا", "ሰላም። ነው", "x…y", '"He said." So'):
        enc = t.encode(text, add_special_tokens=False)
        got = ends.of(np.array(enc.ids, np.uint32))
        for (_, stop), mark, after in zip(enc.offsets, got, [o[0] for o in enc.offsets[1:]] + [len(text)]):
            whole = after >= stop  # the id ends where a character does
            if whole and text[:stop].rstrip("\"')")[-1:] in tuple("。！？｡।॥؟۔።…"):
                assert mark, (text, stop)
        assert not ends.of(np.array(t.encode("no stop here, 一句", add_special_tokens=False).ids, np.uint32)).any()


@pytest.mark.parametrize("kind", ["short", "middle", "large", "chinese", "code"])
@pytest.mark.parametrize("length", [512, 2048])
def test_little_padding(spark, make_docs, prose, kind, length):
    """Texts without stops, of about one sequence or less; in a script with other stops; and without white space."""
    rng = random.Random(11)
    text = {
        "short": lambda i: prose(150 + i, seed=i),
        "middle": lambda i: prose(rng.randint(350, 500), seed=i),
        "large": lambda i: prose(rng.randint(450, 650), seed=i),
        "chinese": lambda i: "".join("".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(rng.randint(10, 40))) + "。" for _ in range(rng.randint(10, 40))),
        "code": lambda i: ";".join(f"x{rng.randint(0, 99)}=y" for _ in range(rng.randint(100, 400))),
    }[kind]
    rows = packing.pack(make_docs([(i, text(i)) for i in range(400)]).coalesce(1), PATH, length=length).collect()
    size = {}
    for r in rows:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= length
    # One sequence of each range of documents is as short as it happens to be.
    ranges = {}
    for s, n in sorted(size.items()):
        ranges[s >> 33] = s
    padding = sum(length - n for s, n in size.items() if s not in ranges.values())
    assert padding < 0.05 * sum(size.values())


def test_word_pieces_equal_the_library():
    rng = random.Random(3)
    for _ in range(20):
        words = lambda n, m: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(n, m))}
        initial, continuing = words(1, 12), words(0, 12)
        vocabulary = {w: k for k, w in enumerate(["[UNK]", *sorted(initial), *(f"##{c}" for c in sorted(continuing))])}
        t = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=12))
        automaton = wordpiece.build([w.encode() for w in initial], [w.encode() for w in continuing], 12)
        some = ["".join(rng.choice("abcd" if rng.random() < 0.05 else "abc") for _ in range(rng.randint(1, 14))) for _ in range(200)]
        assert wordpiece.piece_counts(automaton, pa.array([w.encode() for w in some], pa.binary())).tolist() == [len(t.encode(w).ids) for w in some]


def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        known = initial if at == 0 else continuing
        at = next(b for b in range(len(word), at, -1) if word[at:b] in known)
        n += 1
    return n


def test_counts_of_documents(spark, make_docs, odd_rows):
    initial, continuing = wordpiece.byte_vocabulary(PATH)
    got = wordpiece.count_pieces(make_docs(odd_rows), initial, continuing).collect()
    a, b = set(initial), set(continuing)
    want = []
    for i, t in odd_rows:
        each = [greedy(w, a, b) for w in (t or "").encode().split()]
        want.append((i or -1, len(each), sum(each), max(each, default=0)))
    assert sorted((r["id"] or -1, r["n_words"], r["n_pieces"], r["longest_word_pieces"]) for r in got) == sorted(want)


def test_added_tokens_as_the_library_does(spark, tmp_path, make_docs, odd_rows):
    """The queries and the pipeline's last stage, against the library as it is."""
    import corpus_pipeline

    rng = random.Random(7)
    t = Tokenizer.from_file(PATH)
    ids = lambda text: t.encode(text or "", add_special_tokens=False).ids
    assert ids("one <|endoftext|> two") == [505, 220, 50256, 734]
    texts = ["".join(rng.choice(["<|endoftext|>", " ", "a", "\n", "é", "<|", "it's", "  "]) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    got, at = BpeEncoder(PATH).encode(pa.array([*texts, None]))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids(x) for x in [*texts, None]]
    rows = [*odd_rows, (20, "one <|endoftext|> two"), (21, "<|endoftext|>"), (22, "after")]
    docs = make_docs(rows).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    shards = bitplane.op1_bitplane(spark, str(tmp_path)).collect()
    want = sorted((i or -1, len(ids(x)) + 1, crc(ids(x) + [0])) for i, x in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in shards) == want
    sizes = sorted((i or -1, len(ids(x)) + 1) for i, x in rows if i in (9, 20, 21, 22))
    for made in (packing.op8_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        assert sorted({(r["doc_id"], r["doc_tokens"]) for r in made.filter("doc_id in (9, 20, 21, 22)").collect()}) == sizes
