"""The registered queries themselves, on small tables with nulls, ties, repeated rows and columns of other names; and on empty ones."""

import pytest

from loglattice.llm.queries import QUERIES

COLUMNS = {
    "op1_bitplane": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op2_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op3_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4_simhash": {"doc_id", "fingerprint", "component_id"},
    "op5_matroska": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op6_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op9_repetition": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op10_wordpiece": set(),
    "op11_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op12_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op13_conversations": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}
#: Rows that aren't one for each document.
ROWS = {"op11_whitening": 3 * 40, "op13_conversations": 9}


@pytest.fixture(scope="module")
def tables(spark, make_docs, odd_rows, prose, tmp_path_factory):
    """A folder with rows, and one without."""
    rows = odd_rows + [(i, prose(30)) for i in range(20, 60)]
    marks = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(20, 60)] + [(None, 1, 1), (21, None, None)], "doc_id long, quality int, toxic int")
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    make_docs(rows).write.parquet(f"{full}/documents.parquet")
    marks.write.parquet(f"{full}/labels.parquet")
    vectors = spark.createDataFrame([(i, [i / 7, (i * i % 11) / 3, i % 5 / 2], 0) for i in range(40)] + [(50, None, 1), (51, [1.0, None, 2.0], 1), (52, [1.0, float("nan"), 2.0], None)], "vec_id long, embedding array<float>, label int")
    turns = spark.createDataFrame([(i % 8 if i % 9 else None, i // 8 if i % 7 else None, ["system", "user", "assistant", None][i % 4], ["", None, "a b.", "c"][i % 5 % 4], 1) for i in range(64)], "conv_id long, turn long, role string, text string, place long")
    for name, table in (("embeddings", vectors), ("conversations", turns)):
        table.write.parquet(f"{full}/{name}.parquet")
        table.filter("false").write.parquet(f"{empty}/{name}.parquet")
    make_docs(rows).filter("false").write.parquet(f"{empty}/documents.parquet")
    marks.filter("false").write.parquet(f"{empty}/labels.parquet")
    return full, empty, len(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    full, empty, n = tables
    made = QUERIES[name](spark, full)
    assert COLUMNS[name] <= set(made.columns)
    rows = made.collect()
    n = ROWS.get(name, n)
    assert len(rows) == n if name != "op8_packing" else len({r["doc_id"] for r in rows}) == len({r[0] for r in spark.read.parquet(f"{full}/documents.parquet").select("doc_id").collect()})
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, tables):
    import corpus_pipeline

    full, empty, _ = tables
    assert corpus_pipeline.run(spark, full).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
