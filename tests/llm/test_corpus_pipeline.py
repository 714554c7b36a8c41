"""The corpus pipeline: each stage on its predecessor's output, held against brute force on a small table."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quireflow.llm import near_dedup
from quireflow.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing sources", "best-fit packing"]
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[1:-1])
    assert {"sequence_id", "offset", "length"} <= set(stages[-1].columns)


def test_rejected_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].join(labels, "doc_id", "left")
    good, bad = labels.where("quality = 1").count(), labels.where("quality = 0").count()  # 76 and 11, few to learn from
    assert kept.where("quality = 1").count() >= 0.97 * good and kept.where("quality = 0").count() <= 0.4 * bad


def test_lines_are_deleted_only(stages):
    before = {r["doc_id"]: r["text"].split("\n") for r in stages[1].collect()}
    after = {r["doc_id"]: r for r in stages[2].collect()}
    assert set(after) <= set(before)
    for doc_id, r in after.items():
        lines = iter(before[doc_id])
        assert all(line in lines for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])


def test_one_document_of_each_class_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    kept = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    words = {d: near_dedup.hashed(near_dedup.words_of(t)) for d, t in texts.items()}
    ids = sorted(kept)
    assert not any(near_dedup.similar(words[a], words[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for d in set(texts) - set(kept):
        assert any(e != d and near_dedup.similar(words[d], words[e]) for e in texts)


def test_mix_repeats_what_was_kept(stages):
    kept = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    mixed = stages[4].collect()
    assert mixed and all(kept[r["doc_id"]] == r["text"] for r in mixed)


def test_pieces_cover_the_mix(spark, stages):
    pieces = stages[5]
    assert pieces.where("piece = 0").count() == stages[4].count()
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_sequences_hold_the_mix_s_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    got = stages[5].collect()
    assert sum(len(r["ids"]) for r in got) == 4 * want and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)


MESSY = [
    (1, "a b c d e f", "en", "s0", 11, 7),
    (1, "a b c d e f", "en", "s0", 11, 7),
    (2, "a b c d e f", None, "s1", None, 8),
    (3, None, "en", "s1", None, None),
    (4, "", "de", None, 0, 1),
    (5, " \n\t ", "de", None, 4, 1),
    (None, "x y\nz", None, "s0", 5, 2),
    (None, None, None, None, None, None),
    (6, "\n".join(f"Line {i} of a long text, said once." for i in range(4000)), "en", "s2", 1, 3),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_messy_and_empty_tables(spark, name):
    """Nulls, empty and long texts, repeated rows and columns named like the operators' own; and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k int, score double, size int, nth int, node int, bin int, row int, at int, keys int, key int"
    docs = spark.createDataFrame([(*r, 0.5, 1, 2, 3, 4, 5, 6, 7, 8) for r in MESSY], schema)
    got = stage(spark, docs, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or got.columns == corpus_pipeline.COLUMNS
    rows = got.collect()
    if name == "quality classifier":
        assert {(r["doc_id"], r["text"]) for r in rows} <= {(r[0], r[1]) for r in MESSY}
    if name == "line dedup":  # documents that go whole are left out; these have nothing repeated
        assert len(rows) == len(MESSY)
    if name == "MinHash near-dedup":
        assert sorted(str(r["doc_id"]) for r in rows) == ["1", "3", "6", "None"]
    if name == "mixing sources":
        assert all(sum(s["doc_id"] == r["doc_id"] for s in rows) <= 6 for r in rows)
    if last:
        assert sum(r["piece"] == 0 for r in rows) == len(MESSY)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_dedup_stage_takes_copies_of_a_crowded_bucket(spark):
    """One of each pair of copies that meet by nothing but a passage of all 1600 texts, but those that share no key."""
    passage, table = [f"p{i}" for i in range(60)], []
    for i in range(800):
        own = [f"o{i}-{j}" for j in range(55)]
        table += [passage + own, passage + [f"x{w}" if j % 5 == 2 else w for j, w in enumerate(own)]]
    keys = [set(near_dedup.keys(near_dedup.kmers(near_dedup.hashed(t)))) for t in table]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(table)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs.repartition(4), SF).collect())
    assert kept == [i for i in range(1600) if i % 2 == 0 or not keys[i] & keys[i - 1]]
