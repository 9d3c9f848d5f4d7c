"""The pipeline, stage by stage, against what its operators' decisions say, and as a whole against brute force."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideflow.llm import language_id, quality_classifier
from tideflow.llm.queries import tokenizer_path

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert rows, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert len({r.doc_id for r in rows}) == len(rows) <= len(seen)
            if k < 3:
                assert all(r.text == seen[r.doc_id] for r in rows)  # the filters leave texts alone
            seen = {r.doc_id: r.text for r in rows}
        else:
            assert {r.doc_id for r in rows} == set(seen)
            assert all(0 < r.length <= 2048 and r.offset + r.length <= 2048 for r in rows)


def test_near_duplicates_keep_one_of_each_group(spark):
    base = " ".join(f"w{k}" for k in range(100))
    texts = [base, base, base.replace("w50", "other"), "something else entirely that has no copy anywhere here", "tiny"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 3, 4]
    cut = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_stage(spark, docs, "").collect()}
    assert set(cut) == {0, 2, 3, 4} and cut[2] == ("other", 5) and cut[0][0] == base


def test_near_duplicates_of_short_texts_in_different_blocks(spark):
    texts = ["tiny", "two words", "Four words are these", "seven words are not enough for links", "a text with as many as nine words here"]
    rows = [(10 * copy + k, t) for copy in range(3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "doc_id")
    assert docs.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 1, 2, 3, 4]


def groups(texts):
    """text number -> least number reachable by links of similarity 0.8 or more of 5-word shingles."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(sets)):
        for i in range(j):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def without_repeats(texts):
    seen, out = set(), []
    for t in texts:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (x := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        if not w or not all(gone):
            out.append(b" ".join(a for a, g in zip(w, gone) if not g).decode() if any(gone) else t)
        else:
            out.append(None)
    return out


def test_run_against_brute_force(spark):
    """The five stages in plain Python: models fitted on the same rows, all pairs compared, all windows looked up, ids by the tokenizers library."""
    from tokenizers import Tokenizer

    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id)
    languages = language_id.LanguageModel.fit([(r.lang, r.text) for r in rows if r.lang is not None]).scorer()
    docs = [(r.doc_id, r.text) for r, (lang, score) in ((r, languages(r.text)) for r in rows) if lang != "und" and score >= 0.5]
    grades = {}
    for r in spark.read.parquet(f"{DATA}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None:
            grade = 0 if r.quality <= 0 else 1 if (r.toxic or 0) > 0 else 2
            grades[r.doc_id] = min(grades.get(r.doc_id, 2), grade)
    make = quality_classifier.Featurizer()
    labelled = [(grades[i], np.array(sorted(make(t)), "<i4").tobytes()) for i, t in docs if i in grades]
    model = quality_classifier.OrdinalModel().fit_features([(np.frombuffer(f, "<i4"), g) for g, f in sorted(labelled)])
    docs = [(i, t) for i, t in docs if model.tails(float(model.weights[list(make(t))].sum()))[-1] >= quality_classifier.LEAST_TAIL]
    docs = [d for k, (d, g) in enumerate(zip(docs, groups([t for _, t in docs]))) if g == k]
    docs = [(i, cut) for (i, _), cut in zip(docs, without_repeats([t for _, t in docs])) if cut is not None]
    library, want, tokens = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), set(), 0
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        tokens += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    got = corpus_pipeline.run(spark, str(DATA)).collect()
    assert 50 < len(docs) < len(rows)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert -(-tokens // 2048) <= len(places) <= -(-tokens // 2048) + 2


def test_nulls_clashes_and_empty_tables(spark, tmp_path):
    """Rows without an id are documents like others; columns may have any names; empty tables and labels pass through every stage."""
    base = " ".join(f"w{k}" for k in range(60))
    texts = [(None, base), (7, base), (None, "few words here"), (None, "few words here"), (2, None), (3, ""), (4, "other words altogether, it seems")]
    kinds = "doc_id long, text string, lang string, block int, selected int, row_at int, cut_text string, component_id long"
    docs = spark.createDataFrame([(i, t, "en", 1, 2, 3, "c", 4) for i, t in texts], kinds)
    read = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    spark.createDataFrame([(7, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/some/labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert read(corpus_pipeline.language_stage(spark, docs, "")) == Counter((i, t) for i, t in texts if t)
    assert read(corpus_pipeline.near_duplicate_stage(spark, docs, "")) == Counter(set(texts) - {(None, base)})
    assert read(corpus_pipeline.substring_stage(spark, docs, "")) == Counter(texts) - Counter([(None, base)])
    for labels in ("some", "none"):
        for frame in (docs, docs.where("false")):
            for _, stage in corpus_pipeline.STAGES[:-1]:
                got = stage(spark, frame, f"{tmp_path}/{labels}")
                assert got.columns == frame.columns and got.count() <= frame.count()
            assert corpus_pipeline.packing_stage(spark, frame, "").count() == frame.count()


def test_repeated_rows(spark):
    base, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "wv")
    texts = [(1, base), (1, base), (1, base), (2, "few words here"), (2, "few words here"), (3, other), (3, "another short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    read = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    once = sorted(set(texts))
    assert read(corpus_pipeline.near_duplicate_stage(spark, docs, "")) == once
    assert read(corpus_pipeline.substring_stage(spark, docs, "")) == sorted([*once, (2, "few words here")])
