"""The training-data operators against brute force, on small fixtures with the awkward cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import gc
import hashlib
import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter
from itertools import pairwise, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideflow.llm import bpe_automaton, byte_tokens, deleted_interpolation, language_id, ngram_jaccard, nn_descent, packing, quality_classifier, quality_rules, substring_dedup, token_counts
from tideflow.llm.blocks import Words
from tideflow.llm.components import connected_components
from tideflow.llm.queries import tokenizer_path

WORD_BPE, BYTE_BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def words(text):
    return (text or "").encode().split()


def lower_words(text):
    return (text or "").encode().lower().split()


def make_texts():
    rng = random.Random(7)
    vocabulary = ["the", "of", "stone", "River", "été", "naïve", "ÄPFEL", "x1", "#tag", "end.", "a|b", "42", "quick", "brown", "fox", "中文"]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = draw(60), draw(120)
    near = base.split(" ")
    near[50] = "changed"
    texts = [None, "", "   \n\t", "one", "two words", "same same same same same same same", passage, f"{draw(30)} {passage} {draw(20)}", f"{passage}\n{draw(9)}", base, base, base.upper(), " ".join(near), f"{draw(25)}\n{draw(25)}\n{draw(25)}", draw(4000), "line\nline\nline\nother line here", "a  b   c \n\n d e f", "<|endoftext|>hello<|startoftext|> wo<|endoftext|>", "Σίσυφος ΑΣ İstanbul ﬁ é 🎉🎉 it's we'll don't", "#### $$$$ %%%% &&&& #### $$$$ %%%% &&&& #### $$$$ %%%%"]
    return [*texts, *[draw(rng.randint(5, 80)) for _ in range(12)]]


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with those the operators make
    rows = [(i, t, "en" if i % 2 else "de", 1, -1, "x", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block int, part int, kind string, rank int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_deleted_interpolation(docs, none):
    got = by_id(deleted_interpolation.score_documents(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))}
    lines = {i: [*lower_words(t), b"\n"] for i, t in enumerate(TEXTS)}
    counts = Counter(w for i, line in lines.items() if not held[i] for w in line)
    total, kinds = sum(counts.values()), len(counts)
    assert any(held.values()) and set(got) == set(lines)
    for i, line in lines.items():
        base = sum(math.log10((counts[w] + 1) / (total + 1 * (kinds + 1))) for w in line)
        assert got[i][:4] == (held[i], len(line), sum(w in counts for w in line), total)
        assert got[i][4] == pytest.approx(base, rel=1e-12)
        assert got[i][5] < 0
    assert sum(v[5] for v in got.values()) > sum(v[4] for v in got.values())
    assert deleted_interpolation.score_documents(none).count() == 0


def test_scores_against_a_mixture_by_hand(spark):
    """Bigram scores by counting words and pairs in plain Python, with the weights that EM finds on the deleted counts."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    fold = [zlib.crc32(str(i).encode()) % 7 for i in range(60)]
    lines = [["#", *t.split(), "#"] for t in texts]  # a document begins after an end
    one, two = Counter(), Counter()
    for line, f in zip(lines, fold):
        if f != 2:
            one.update(line[1:])
            two.update(pairwise(line))
    # how often a context was seen: as a token, in the documents that train
    size, kinds = sum(one.values()), len(one)
    codes, steps = Counter(), deleted_interpolation._STEPS
    bucket_of = lambda n: min(deleted_interpolation.BUCKETS - 1, int(math.log2(n)) + 1) if n > 0 else 0
    for line, f in zip(lines, fold):
        if f == 3:
            own1, own2 = Counter(line[1:]), Counter(pairwise(line))
            for a, b in pairwise(line):
                seen = one[a] - own1[a]
                rates = (one[b] - own1[b]) / (size - len(line) + 1), (min(two[a, b] - own2[a, b], seen) / seen if seen else 0)
                code = bucket_of(seen)
                for x in rates:
                    code = code << 12 | (max(-1000, min(1000, round(steps * math.log2(x * (kinds + 1))) if x > 0 else -1000)) + 1024)
                codes[code] += 1
    keys = sorted(codes)
    weights = deleted_interpolation.learn_weights(np.array(keys), np.array([codes[k] for k in keys], float), 2)

    def probability(a, b):
        w = weights[bucket_of(one[a])]
        lower = w[0] / (kinds + 1) + w[1] * one[b] / size
        return (lower + w[2] * two[a, b] / one[a]) / w.sum() if one[a] else lower / (w[0] + w[1])

    got = by_id(deleted_interpolation.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), order=2), "score")
    for i, line in enumerate(lines):
        assert got[i][0] == pytest.approx(sum(math.log10(probability(a, b)) for a, b in pairwise(line)), rel=1e-6)
    # after any context the known words, the end and one unknown word have probability one in all
    for a in [*one, "zzz"]:
        assert sum(probability(a, b) for b in [*one, "unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_other_orders(spark, order):
    texts = [" ".join(random.Random(i).choices("abcdef", k=20)) for i in range(40)]
    got = by_id(deleted_interpolation.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=order), "score", "n_tokens")
    assert all(s < 0 and n == 21 for s, n in got.values())
    with pytest.raises(ValueError):
        deleted_interpolation.score_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), order=5)


def test_learn_weights():
    order = 2
    code = lambda bucket, q1, q2: bucket << 24 | (q1 + 1024) << 12 | (q2 + 1024)
    weights = deleted_interpolation.learn_weights(np.array([code(3, 8, 40), code(5, 8, -1000)]), np.array([10.0, 10.0]), order)
    assert weights[3].argmax() == 2 and weights[5].argmax() == 1
    assert np.allclose(weights.sum(1), 1)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:140] = x[7]  # copies
    rows = [(i, v.tolist(), 9) for i, v in enumerate(x)]
    rows += [(5000, None, 9), (5100, [0.0] * 16, 9), (5200, [float("nan")] * 16, 9), (5300, [None] * 16, 9), (5400, [1.0], 9), (None, x[0].tolist(), 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in nn_descent.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(s == d[v] for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
    assert hits >= 0.9 * 10 * len(got)
    assert sorted(v for _, v, _ in got[100]) == [7, *range(101, 110)]  # ties to the smaller id
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in nn_descent.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert nn_descent.nearest(few.where("false"), F.lit(True)).count() == 0


def test_nearest_with_a_beam_of_few_rows(spark):
    n, x = 6000, np.random.default_rng(5).normal(size=(6000, 24)).astype(np.float32)
    rows = nn_descent.materialise(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, full binary"))
    asked, looked = range(0, n, 60), spark.sparkContext.accumulator(0)
    graph = nn_descent.materialise(nn_descent.neighbour_graph(rows, n))
    beams = nn_descent.greedy_search(rows, graph, spark.createDataFrame([(q,) for q in asked], "q long"), beam=100, looked=looked)
    lists, found = {}, {}
    for r in graph.collect():
        lists.setdefault(r.u, set()).add(r.v)
    for r in beams.where("node <> q").collect():
        found.setdefault(r.q, []).append((r.d, r.node))
    in_lists = in_beams = 0
    for q in asked:
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        want = np.argsort(d, kind="stable")
        in_lists += len(lists[q] & set(want[: nn_descent.NEIGHBOURS].tolist()))
        in_beams += len({v for _, v in sorted(found[q])[:10]} & set(want[:10].tolist()))
    assert in_lists >= 0.9 * nn_descent.NEIGHBOURS * len(asked)
    assert in_beams >= 0.95 * 10 * len(asked)
    assert looked.value <= 0.45 * n * len(asked)  # a search of the graph, not of the table


def test_hops_pass_on_beams_only(spark, monkeypatch):
    """A hop writes the beams and what it was the first to look at, not all that was looked at so far; the result is all of it, once."""
    n, beam, x = 1200, 20, np.random.default_rng(6).normal(size=(1200, 8)).astype(np.float32)
    rows = nn_descent.materialise(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, full binary"))
    graph = nn_descent.materialise(nn_descent.neighbour_graph(rows, n))
    hops, write = [], nn_descent.materialise
    monkeypatch.setattr(nn_descent, "materialise", lambda df: hops.append(out.count()) or out if "next" in (out := write(df)).columns else out)
    asked, looked = range(0, n, 100), spark.sparkContext.accumulator(0)
    found = [(r.q, r.node) for r in nn_descent.greedy_search(rows, graph, spark.createDataFrame([(q,) for q in asked], "q long"), beam=beam, width=4, looked=looked).collect()]
    assert len(found) == len(set(found)) == looked.value and len(hops) > 4
    assert sum(hops) <= looked.value + len(hops) * beam * len(asked)


@pytest.mark.parametrize(("scale", "kind"), [(1e6, "float"), (1e-9, "float"), (1e30, "float"), (1e60, "double"), (1e-60, "double")])
def test_nearest_at_any_scale(spark, scale, kind):
    """Also: the rounds run at a size that one leaf could hold; of rows with one id the least vector counts."""
    x = np.random.default_rng(8).normal(size=(400, 12)) * scale
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    twice = [(7, (np.abs(x[7]) + 100 * scale).tolist()), (7, x[7].tolist())]
    table = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], *twice], f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in nn_descent.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 400, 100):
        d = np.sqrt(((x / scale - x[q] / scale) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for _, v, _ in got[q]} & set(np.argsort(d)[:10].tolist()))
        assert all(s == pytest.approx(d[v] * scale, rel=1e-5) for _, v, s in got[q])
    assert set(got) == {0, 100, 200, 300} and hits >= 39


def test_language(spark, docs, none):
    train = spark.createDataFrame([(1, "the river and the stone", "en"), (2, "the quick brown fox and the dog", "en"), (3, "der Apfel und die Birne", "de"), (4, "und der schnelle Fuchs", "de")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(train)
    score = model.scorer()
    assert score("the stone and foxes")[0] == "en" and score("und die Birnen")[0] == "de"
    assert [score(t) for t in (None, "", "123 ... !")] == [("und", 0.0)] * 3
    got = by_id(language_id.identify_language(docs, model), "lang_pred", "score")
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for _, s in got.values()) and got[0] == ("und", 0.0)
    assert language_id.identify_language(none, model).count() == 0
    assert language_id.fit_language_model(train.where("false")).scorer()("text")[0] == "und"


def test_language_by_hand(spark):
    """Training through the engine gives what counting in Python gives; numerals are no letters, marks belong to words; ties, repeated rows and null ids."""
    rows = [(1, "aa bb bb", "x"), (1, "aa bb bb", "x"), (None, "cc dd", "y"), (4, None, "y"), (5, "zz", None), (6, "", "w")]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    same = language_id.LanguageModel.fit([(x, t) for _, t, x in rows if x])
    assert (model.langs, model.words, model.grams) == (same.langs, same.words, same.grams) and model.langs == ["w", "x", "y"]
    score = model.scorer()
    assert all(score(t) == ("und", 0.0) for t in ("½", "²³", "Ⅷ", "१२", "_ ― 7"))
    assert language_id.words_of("E\u0301te\u0301 ½a Ⅷb c1d") == ["e\u0301te\u0301", "a", "b", "c", "d"]
    even = language_id.LanguageModel.fit([("b", "one two"), ("a", "one two")], min_count=1).scorer()("one two")
    assert even == ("a", 0.5)  # a tie goes to the first language
    # a word known in training counts by its frequency, another one by its longest known n-grams
    logs = [math.log((k + 0.5) / (n + 0.5 * 5)) for k, n in ((0, 0), (4, 6), (0, 2))]
    assert model.word_scores("bb") == pytest.approx(tuple(logs))


def test_fits_hold_no_object_for_each_name_on_the_driver():
    """A language model takes little more than its names and logs, which are those of counting in plain Python; the fit of grades takes no matrix over all possible features."""
    rng = random.Random(5)
    rows = [(x, " ".join("".join(rng.choices("abcdefghé", k=rng.randint(3, 8))) for _ in range(2500)) * 2) for x in "wxyz"]
    language_id.LanguageModel.fit([("x", "a")])  # what is imported at the first call does not count
    tracemalloc.start()
    try:
        model = language_id.LanguageModel.fit(rows)
        gc.collect()
        names = len(model.words) + sum(map(len, model.grams))
        assert names > 15_000 and tracemalloc.get_traced_memory()[0] < 100 * names
        feats = [(np.unique(np.array(rng.choices(range(1 << 20), k=50), "<i4")), i % 3) for i in range(300)]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        quality_classifier.OrdinalModel().fit_features(feats, steps=2)
        assert tracemalloc.get_traced_memory()[1] - before < 40_000_000
    finally:
        tracemalloc.stop()
    for n, table in enumerate([model.words, *model.grams]):
        counts = [Counter(g for w in language_id.words_of(t) for w in [f"^{w}$" if n > 1 else w] for g in ([w[j : j + n] for j in range(len(w) - n + 1)] if n else [w])) for _, t in rows]
        every = sum(counts, Counter())
        want = {g: tuple(math.log((c[g] + 0.5) / (c.total() + 0.5 * (len(every) + 1))) for c in counts) for g, k in every.items() if k >= 2}
        assert pickle.loads(pickle.dumps(table)).entries == want


def test_a_rare_language_is_not_missed(spark):
    rows = [(i, "the common words", "en") for i in range(3000)] + [(9000 + i, "rara lingua", "la") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(docs, rows=100, least=50)
    assert model.langs == ["en", "la"] and model.scorer()("rara")[0] == "la"


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    got = by_id(bpe_automaton.encode_decode(docs, WORD_BPE), "n_tokens", "ids_sha256", "decoded_sha256")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    assert bpe_automaton.encode_decode(none, WORD_BPE).count() == 0


def test_automaton_on_small_merges():
    """Against the plain rule: apply the first merge of the list that fits, again and again, from the left."""
    rng = random.Random(1)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("ab")}, []
        for _ in range(8):
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                merges.append((u, v))
                vocab[u + v] = len(vocab)
        automaton = bpe_automaton.TokenAutomaton(vocab, merges)
        names = {i: t for t, i in vocab.items()}
        for _ in range(30):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
            tokens = list(text)
            while ranked := [(merges.index(p), k) for k, p in enumerate(pairwise(tokens)) if p in merges]:
                _, k = min(ranked)
                tokens[k : k + 2] = ["".join(tokens[k : k + 2])]
            assert [names[t] for t in automaton.walk(list(text))] == tokens


def test_quality_classifier(spark, docs, none):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["stone", "river", "tree", "cloud", "field"]) for _ in range(30)) for _ in range(60)]
    texts = [(t, 2) for t in good] + [(t + " idiot", 1) for t in good[:40]] + [(t.replace(" ", "### ") + "!!!", 0) for t in good[:40]]
    model = quality_classifier.OrdinalModel().fit(texts)
    make = quality_classifier.Featurizer()
    tail = lambda t: model.tails(float(model.weights[list(make(t))].sum()))
    assert np.all(np.diff(model.cuts) > 0)
    assert tail("stone tree field")[1] > 0.7 > tail("stone tree idiot field")[1] and tail("stone### tree### field###")[0] < 0.5
    got = by_id(quality_classifier.classify_quality(docs, model), "expected_grade", "tail_probability", "selected")
    assert len(got) == len(TEXTS) and all(0 <= g <= 2 and s == (p >= 0.7) for g, p, s in got.values())
    assert quality_classifier.classify_quality(none, model).count() == 0
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit_quality_classifier(docs, labels).weights.shape
    assert quality_classifier.OrdinalModel().fit([]).tails(0.0)


def test_ordinal_fit_by_hand(spark):
    """The fitted model is the best of its kind: its likelihood falls when any weight or threshold is moved. Tails and grades follow from the thresholds; repeated and null ids are rows like others."""
    rng = random.Random(8)
    rows = [(rng.choice(["stone river", "river tree", "cloud"]) + (" bad" if g < 2 and rng.random() < 0.8 else "") + (" worse" if g < 1 and rng.random() < 0.7 else ""), g) for g in rng.choices((0, 1, 2), (1, 1, 3), k=200)]
    model, make = quality_classifier.OrdinalModel().fit(rows, steps=4000, decay=0.0), quality_classifier.Featurizer()
    n, share = len(rows), Counter(g for _, g in rows)
    weight = np.array([(share[g] / n) ** -0.5 for _, g in rows])
    sets = [sorted(make(t)) for t, _ in rows]

    def likelihood(weights, cuts):
        score = np.array([weights[s].sum() for s in sets])
        above = np.stack([np.ones(n), *(1 / (1 + np.exp(c - score)) for c in cuts), np.zeros(n)])
        return float((weight * np.log([above[g, i] - above[g + 1, i] for i, (_, g) in enumerate(rows)])).sum())

    best = likelihood(model.weights.astype(float), model.cuts)
    for k in range(2):
        for step in (-0.2, 0.2):
            cuts = model.cuts.copy()
            cuts[k] += step
            assert likelihood(model.weights.astype(float), cuts) < best
    used = np.flatnonzero(model.weights)
    assert len(used)
    for k in used:
        w = model.weights.astype(float)
        w[k] *= 1.5
        assert likelihood(w, model.cuts) < best + 0.05
    docs = spark.createDataFrame([(None, "stone bad worse"), (None, "cloud"), (5, "cloud"), (5, "cloud"), (6, None)], "doc_id long, text string")
    for r, t in zip(quality_classifier.classify_quality(docs.coalesce(1), model).collect(), ["stone bad worse", "cloud", "cloud", "cloud", None]):
        s = float(model.weights[sorted(make(t))].sum()) if make(t) else 0.0
        tails = [1 / (1 + math.exp(c - s)) for c in model.cuts]
        assert (r.expected_grade, r.tail_probability, r.selected) == (pytest.approx(sum(tails)), pytest.approx(tails[1]), tails[1] >= 0.7)


def test_toxic_words_are_not_outweighed():
    rng = random.Random(4)
    draw = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    plain, kind, rude = ["stone", "river", "tree", "cloud", "field"], ["lovely", "gentle", "thanks", "please"], ["scoundrels", "scoundrelly", "scoundreled"]
    rows = [(f"{draw(plain, 20)} {draw(kind, 3)}", 2) for _ in range(300)] + [(draw(plain, 20), 2) for _ in range(100)]
    rows += [(f"{draw(plain, 20)} {rng.choice(rude)}", 1) for _ in range(20)] + [(f"{draw(plain, 20)} ### ###", 0) for _ in range(40)]
    model, make = quality_classifier.OrdinalModel().fit(rows), quality_classifier.Featurizer()
    tail = lambda t: model.tails(float(model.weights[list(make(t))].sum()))[-1]
    assert model.weights.max() <= 0
    assert tail("stone river lovely gentle") >= 0.7
    assert tail("stone river lovely gentle thanks please scoundrels") < 0.7  # kind words don't outweigh it
    assert tail("stone river scoundrelism") < 0.7  # a form that was not seen


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack(docs, BYTE_BPE, capacity=256, rounds=20).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 256 or not k)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(pieces[i]) == -(-len(ids) // 256)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.1 * total / 256 + 1
    assert packing.pack(none, BYTE_BPE).count() == 0


def test_configurations_hold_every_piece():
    counts = {7: 300, 5: 411, 3: 90, 10: 12, 1: 5}
    plan = packing.solve_configurations(counts, 10, 30)
    used = Counter()
    for config, times in plan:
        assert sum(config) <= 10 and times > 0
        for n in config:
            used[n] += times
    assert used == counts
    assert sum(t for _, t in plan) <= 12 + 300 + 206 + 5


def test_every_sequence_comes_from_the_program(monkeypatch):
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(2048, rng.lognormal(5.5, 1.3, 3000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    found, solve = {(2048,)}, packing.fractional_cover

    def cover(*args):
        out = solve(*args)
        found.update(out)
        return out

    monkeypatch.setattr(packing, "fractional_cover", cover)
    plan = packing.solve_configurations(histogram)
    used = Counter()
    for config, times in plan:
        assert config in found and sum(config) <= 2048
        for n in config:
            used[n] += times
    assert used == histogram
    volume = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert volume <= sum(t for _, t in plan) <= 1.005 * volume + 1


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths, counts, prices = np.sort(rng.choice(np.arange(1, 12), 4, replace=False)), rng.integers(1, 4, 4), rng.random(4)
        best, configuration = packing.price_knapsack(prices, lengths, counts, 15)
        for room in range(16):
            want = max(sum(prices * k) for k in product(*(range(c + 1) for c in counts)) if sum(lengths * k) <= room)
            got = configuration(room)
            assert best[room] == pytest.approx(want) == pytest.approx(sum(prices[i] * k for i, k in got.items()))
            assert all(k <= counts[i] for i, k in got.items()) and sum(lengths[i] * k for i, k in got.items()) <= room


def test_packing_of_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "x y z"), (3, "x y z"), (3, None), (4, "")], "doc_id long, text string")
    got = packing.pack(rows, BYTE_BPE, capacity=8, rounds=5).collect()
    assert Counter(r.doc_id for r in got) == {None: 2, 3: 3, 4: 1}
    assert len({(r.sequence_id, r.offset) for r in got}) == 6


def test_byte_tokens():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BYTE_BPE), byte_tokens.load(BYTE_BPE)
    for text in [*TEXTS, " lead", "trail ", "a \nb", "a\n b", "x   y", "tab\tx", "'s it's"]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, docs, none):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for name, size in (("f", 5000), ("g", 40), (None, 700), ("h", 0)):
        ids = rng.integers(0, 30, size).astype("<u2")
        start = doc = 0
        for end in np.flatnonzero(ids == 9):
            want.add((name, doc, start, int(end) - start, True))
            start, doc = int(end) + 1, doc + 1
        if start < size:
            want.add((name, doc, start, size - start, False))
        data = ids.tobytes()
        rows += [(name, k, data[2 * a : 2 * (a + 3)]) for k, a in enumerate(range(0, max(size, 1), 3))]
    rows.append(("e", 0, None))
    blocks = spark.createDataFrame(rows, "file string, block long, data binary").repartition(4)
    found = token_counts.scan_separators(blocks, 9).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    flat = token_counts.flatten_documents(docs, BYTE_BPE, 50256, block_bytes=64)
    lengths = Counter(r.n_tokens for r in token_counts.scan_separators(flat, 50256).collect())
    own = byte_tokens.load(BYTE_BPE)
    expected = Counter()
    for t in TEXTS:
        ids = np.frombuffer(own(t), "<u4")
        cuts = np.flatnonzero(ids == 50256)  # an end that stands in a text closes a document like any other
        edges = [-1, *cuts.tolist(), len(ids)]
        expected.update(b - a - 1 for a, b in pairwise(edges))
    assert lengths == expected
    assert token_counts.scan_separators(token_counts.flatten_documents(none, BYTE_BPE, 50256), 50256).count() == 0


def test_counts_do_not_depend_on_the_partitioning(spark):
    texts = [(None, "a b"), (3, "x <|endoftext|> y"), (3, ""), (4, None), (2**40, "naïve été " * 50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own, want = byte_tokens.load(BYTE_BPE), Counter()
    for i, t in texts:
        ids = np.append(np.frombuffer(own(t), "<u4"), 50256)
        cuts = [-1, *np.flatnonzero(ids == 50256).tolist()]
        want.update((i, k, b - a - 1) for k, (a, b) in enumerate(pairwise(cuts)))
    for n in (1, 2, 5):
        assert Counter(tuple(r) for r in token_counts.count_tokens(docs.repartition(n), BYTE_BPE, 50256).collect()) == want
    with pytest.raises(Exception, match="does not fit"):
        token_counts.flatten_documents(docs, BYTE_BPE, 70000)


def test_flat_files(spark, tmp_path):
    ids = np.array([1, 2, 9, 9, 3, 4, 5, 9, 6], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    for whole in (False, True):
        got = token_counts.scan_separators(token_counts.read_flat_files(spark, str(tmp_path), block_bytes=4, whole=whole), 9)
        assert [r.n_tokens for r in got.orderBy("doc_no").collect()] == [2, 0, 3, 1]


def components(sets, linked):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize(("n", "percent", "group"), [(3, 90, 256), (5, 80, 3)])
def test_jaccard(docs, none, n, percent, group):
    got = by_id(ngram_jaccard.jaccard_components(docs, n, percent, group=group), "n_shingles", "component_id")
    sets = {}
    for i, t in enumerate(TEXTS):
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    roots = components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))
    assert got == {i: (len(sets[i]), roots[i]) for i in sets}
    assert ngram_jaccard.jaccard_components(none, n, percent).count() == 0


@pytest.mark.parametrize(("count", "group", "slices"), [(60, 7, 32), (60, 7, 1), (700, 256, 32)])
def test_jaccard_of_many_near_copies(spark, monkeypatch, count, group, slices):
    """Also texts that share passages without being similar, so that one token stands in many unlike sets."""
    monkeypatch.setattr(ngram_jaccard, "SLICES", slices)  # with one, groups of more than 7 are gathered anew by the other orders
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(count):
        t = base.copy()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = f"v{rng.randrange(999)}"
        texts.append(" ".join(t if k % 5 else [*t[:30], *(f"u{rng.randrange(9999)}" for _ in range(30))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(ngram_jaccard.jaccard_components(df, 3, 90, group=group), "component_id")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in enumerate(t.split() for t in texts)}
    roots = components(sets, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    assert got == {i: (r,) for i, r in roots.items()}
    assert 1 < len(set(roots.values())) < count


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (3, 100)])
def test_copies_in_different_blocks(spark, n, percent):
    """Copies of every length, each copy in a block of its own; sets too small to be linked to any other are equal all the same. With 100 percent every set is so."""
    texts = [" ".join(f"w{size}x{k}" for k in range(size)) for size in range(1, 15)]
    rows = [(100 * copy + size, t.upper() if copy == 1 else t) for copy in range(3) for size, t in enumerate(texts)]
    rows += [(300 + size, f"{t} more") for size, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(4, F.expr("doc_id div 100"))
    assert df.select(F.spark_partition_id()).distinct().count() > 2
    sets = {}
    for i, t in rows:
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}
    roots = components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))
    assert by_id(ngram_jaccard.jaccard_components(df, n, percent), "component_id") == {i: (r,) for i, r in roots.items()}


def test_words_take_memory_for_their_sums_only():
    texts = [b"some words of a text and more " * 5000] * 20
    tracemalloc.start()
    try:
        found = Words(texts, lower=True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found.hash) == 20 * 5000 * 7 and len(set(found.hash.tolist())) == 7
    assert peak < 28 * sum(map(len, texts))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20}
    chain = spark.range(1, 200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in connected_components(chain).collect()} == {1}


def repeats(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        kept = b" ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark, docs, none):
    got = by_id(substring_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256")
    assert got == repeats(TEXTS)
    assert any(v[1] for v in got.values())
    assert substring_dedup.remove_repeats(none).count() == 0
    periodic = ["a b c " * 30, "x " * 50, ("a b c " * 9) + "end"]
    df = spark.createDataFrame(list(enumerate(periodic)), "doc_id long, text string")
    out = substring_dedup.remove_repeats(df)
    assert by_id(out, "n_words", "n_removed", "kept_sha256") == repeats(periodic)
    texts = by_id(substring_dedup.remove_repeats(docs), "text")
    assert texts[13] == (TEXTS[13],) and texts[0] == ("",)


def test_quality_rules(spark, docs, none):
    field = quality_rules.LineField().fit([(np.array(quality_rules.lines_of(t)[0], float), y) for t, y in [(b"A good line of plain words.\nAnd another one here.", 1)] * 20 + [(b"### $$$ | &&&\n*** %%% | <<< >>>", 0)] * 10])
    got = by_id(quality_rules.apply_quality_rules(docs, field), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, text in enumerate(TEXTS):
        text = text or ""
        w = words(text)
        lines = [x for x in text.split("\n") if x.encode().split()]
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = [False] * len(w)
        for k in range(len(w) - 4):
            if runs[tuple(w[k : k + 5])] > 1:
                hit[k : k + 5] = [True] * 5
        failed = len(w) < 10 or 100 * sum(hit) > 20 * len(w)
        assert got[i][:6] == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit), failed)
        assert not (failed and got[i][6])
    assert quality_rules.apply_quality_rules(none, field).count() == 0
    labels = spark.createDataFrame([(7, 1), (19, 0), (None, 1)], "doc_id long, quality int")
    assert len(quality_rules.fit_line_field(docs, labels).decode([(1,) + (0,) * 12])) == 1


def test_verdicts_by_hand(spark, docs):
    """content_share and kept from the best of all labellings."""
    rng = np.random.default_rng(9)
    field = quality_rules.LineField()
    field.emit, field.move, field.start = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    got = by_id(quality_rules.apply_quality_rules(docs, field), "base_failed", "kept", "content_share")
    seen = 0
    for i, text in enumerate(TEXTS):
        feats, sizes, _ = quality_rules.lines_of((text or "").encode())
        if 0 < len(feats) <= 8:
            e = np.array(feats, float) @ field.emit
            value = lambda p: field.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in pairwise(p))  # noqa: B023, E731
            best = max(product((0, 1), repeat=len(feats)), key=value)
            share = sum(n for n, y in zip(sizes, best) if y) / sum(sizes)
            assert got[i][1:] == (not got[i][0] and share >= 0.5, pytest.approx(share))
            seen += len(feats) > 1
    assert seen > 2


def test_joins_of_null_and_repeated_ids(spark):
    passage, other = (" ".join(f"{c}{k}" for k in range(40)) for c in "wv")
    rows = [(None, passage), (5, passage), (5, f"x {passage}"), (3, other), (3, other), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    cut = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert cut == Counter([(None, 40, 0), (5, 40, 40), (5, 41, 40), (3, 40, 0), (3, 40, 40), (None, 0, 0)])
    linked = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df, 3, 90).collect())
    assert linked == Counter([(None, 38, None), (5, 38, 5), (5, 39, 5), (3, 38, 3), (3, 38, 3), (None, 0, None)])
    for refused in (substring_dedup.remove_repeats, ngram_jaccard.jaccard_components):
        with pytest.raises(TypeError):
            refused(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    field = quality_rules.LineField()
    field.emit, field.move, field.start = rng.normal(size=field.emit.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    for n in range(1, 8):
        feats = rng.integers(0, 2, (n, len(quality_rules.FEATURES)))
        e = feats @ field.emit
        value = lambda p: field.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in pairwise(p))
        best = max((tuple(int(c) for c in f"{k:0{n}b}") for k in range(2**n)), key=value)
        assert tuple(field.decode(feats.tolist())) == best


def test_line_field_gradient_against_all_paths():
    """The likelihood of the documents' labels by enumerating every labelling, and its slope by differences."""
    rng = np.random.default_rng(2)
    field, k = quality_rules.LineField(), len(quality_rules.FEATURES)
    field.emit, field.move, field.start = rng.normal(size=(k, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    docs = [(rng.integers(0, 2, (n, k)).astype(float), y) for n, y in ((1, 1), (1, 0), (3, 1), (4, 0), (5, 0), (2, 1))]
    for f, _ in docs:
        f[:, 0] = 1

    def likelihood():
        out = 0.0
        for f, good in docs:
            e, n = f @ field.emit, len(f)
            value = lambda p: field.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in pairwise(p))  # noqa: B023, E731
            weights = [math.exp(value(p)) for p in product((0, 1), repeat=n)]
            q = weights[-1] / sum(weights)
            out += math.log(q if good else quality_rules.NOISE + (1 - quality_rules.NOISE) * (1 - q))
        return out

    most = max(len(f) for f, _ in docs)
    x = np.zeros((len(docs), most, k))
    for i, (f, _) in enumerate(docs):
        x[i, : len(f)] = f
    value, slopes = field.gradient(x, x[:, :, 0] > 0, np.array([y for _, y in docs]))
    assert value == pytest.approx(likelihood())
    for theta, slope in zip((field.emit, field.move, field.start), slopes):
        for at in np.ndindex(theta.shape):
            theta[at] += 1e-5
            up = likelihood()
            theta[at] -= 2e-5
            down = likelihood()
            theta[at] += 1e-5
            assert slope[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_lines_are_told_apart_within_a_document(spark):
    """Labels of whole documents alone teach the field which lines of a mixed document are boilerplate."""
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(["stone", "river", "tree", "cloud", "field", "light"]) for _ in range(rng.randint(6, 20))).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["stone###", "$$$", "tree%%%", "a|b", "***"]) for _ in range(rng.randint(6, 20)))
    block = lambda make, least=1: [make() for _ in range(rng.randint(least, 5))]
    good = ["\n".join(block(prose)) for _ in range(60)]
    bad = ["\n".join([*block(prose, 0), *block(junk), *block(prose, 0)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    field = quality_rules.fit_line_field(docs, labels)
    mixed = "\n".join([prose(), prose(), junk(), junk(), junk(), prose()])
    assert field.decode(quality_rules.lines_of(mixed.encode())[0]) == [1, 1, 0, 0, 0, 1]
    shares = by_id(quality_rules.apply_quality_rules(docs, field), "content_share")
    assert all(shares[i] == (1.0,) for i in range(60)) and sum(0 < shares[i][0] < 1 for i in range(60, 120)) >= 30
