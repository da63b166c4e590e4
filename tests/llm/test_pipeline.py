"""The corpus pipeline: each stage on its own input against a plain version, and on odd tables."""

import hashlib
import re
import struct

import pytest
from pyspark.sql import functions as F

from quarterlode.llm import cotrain, mixing, pieces
from tests_llm_brute import brute_jaccard, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, odd, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.unionByName(odd.select(table.columns)).repartition(4)


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages_in_a_row(spark, docs, sf_dir):
    columns, table = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, corpus_pipeline.freeze(stage(spark, table, sf_dir))
        assert name == "tokens" or table.columns == columns
        assert table.count() > 0
        if name in ("quality", "near_duplicates"):
            assert set(rows(table)) <= set(rows(before))
    assert table.where("n_tokens <> size(piece_ids) or n_tokens < 2").count() == 0


def test_quality_keeps_what_the_model_keeps(spark, docs, sf_dir):
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    table = docs.toArrow()
    p = model.score(cotrain.text_view(table["text"].combine_chunks()), cotrain.metadata_view(*(table[c].to_pylist() for c in ("lang", "source", "n_chars"))))
    want = sorted(str(r) for r, x in zip(spark.createDataFrame(table.to_pylist(), docs.schema).collect(), p, strict=True) if x >= cotrain.KEEP and words(r.text))
    assert rows(STAGES["quality"](spark, docs, sf_dir)) == want


def test_one_of_each_group_stays(spark, docs, sf_dir):
    table = [(r.doc_id, r.text) for r in docs.collect()]
    groups = [c for _, _, c in brute_jaccard([(i, t) for i, (_, t) in enumerate(table)], 5, 80)]
    got = STAGES["near_duplicates"](spark, docs, sf_dir).collect()
    assert sum(bool(words(r.text)) for r in got) == len({g for g, (_, t) in zip(groups, table, strict=True) if words(t)})
    assert sum(not words(r.text) for r in got) == sum(not words(t) for _, t in table)
    least = {}
    for g, (d, t) in zip(groups, table, strict=True):
        if words(t):
            least[g] = min(least.get(g, (2,)), (d is None, d or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if words(r.text)) == sorted(least.values())


def test_personal_data_goes(spark, docs, sf_dir):
    got = {(r.doc_id, r.source): r for r in STAGES["personal_data"](spark, docs, sf_dir).collect() if r.text is not None}
    for r in docs.where("text is not null").collect():
        clean = got[r.doc_id, r.source].text
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", clean) and got[r.doc_id, r.source].n_chars == len(clean)
        if not re.search(r"[0-9@+]", r.text):
            assert clean == r.text


def test_mix_repeats_documents_as_decided(spark, docs, sf_dir):
    plan = {}
    for r in mixing.mix(docs).collect():
        key = str((r.doc_id, r.source, r["size"]))
        plan[key] = plan.get(key, 0) + r.repeats
    got = {}
    for r in STAGES["mix"](spark, docs, sf_dir).collect():
        key = str((r.doc_id, r.source, len(words(r.text))))
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in plan.items() if n}


def test_tokens_are_the_library_s(spark, docs, sf_dir):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want.append(str((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())))
    got = [str((r.doc_id, r.n_tokens, r.ids_sha256)) for r in STAGES["tokens"](spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_empty_and_clashing_tables(spark, odd, clashing, empty, sf_dir, name):
    stage = STAGES[name]
    assert stage(spark, empty, sf_dir).count() == 0
    wide = stage(spark, clashing, sf_dir)
    if name != "tokens":
        assert wide.columns == clashing.columns and all(r.words == "own words" for r in wide.collect())
    kept = [c for c in wide.columns if c in odd.columns]
    assert rows(wide.select(kept)) == rows(stage(spark, odd, sf_dir).select(kept))
