"""Language ID, toxicity, likelihood, token counts and BPE."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from edge import awkward, documents
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, lattice_lm, token_counts, toxicity
from quarry.llm.common import crc_mod


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(1)
    letters = "abcéèßÑñÜ 日本́​\x1c\x1f\x85　'sS'T'LL!?#12３½Ⅷ<|endoftext|>ΣσςİıẞΑΣ\t\n\rÅﬁ 😀"
    texts = ["", "  ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "x" * 3000, "ha" * 20000, "</w> a</w>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("thieanor") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = awkward() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(texts)]
    got = sorted((str(r.doc_id), list(np.frombuffer(r.token_ids, "<u4")), r.decoded)
                 for r in bpe.encode_decode(documents(spark, rows)).collect())
    want = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_bpe_pair_check_decides():
    tok = bpe.loaded(open(bpe.default_path(), encoding="utf-8").read())
    words = ["thinginnt", "aaaaaaa", "heoneron", "x"]
    got = tok.encode_words(words)
    exact = tok.exact_merges([tok.symbols(w + bpe.SUFFIX) for w in words])
    assert list(got.values()) == exact == [tok.exact_long(tok.symbols(w + bpe.SUFFIX)) for w in words]


def test_token_counts_are_the_best_segmentations(spark):
    scores = token_counts.load_scores()

    def best(word):
        s, done = token_counts.MARK + word, [(0.0, 0)]
        for j in range(1, len(s) + 1):
            n = len(s[j - 1].encode())
            ways = [(-done[j - 1][0] + n * math.log(len(scores) + 2), done[j - 1][1] + n)]
            ways += [(-done[i][0] - scores[s[i:j]], done[i][1] + 1) for i in range(max(0, j - 24), j) if s[i:j] in scores]
            cost, count = min(ways)
            done.append((-cost, count))
        return done[-1][1]
    rows = awkward()
    want = sorted((str(r[0]), len((r[1] or "").encode().split()), sum(best(w.decode()) for w in (r[1] or "").encode().split()))
                  for r in rows)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(documents(spark)).collect()) == want


def test_trie_shares_prefixes():
    trie = token_counts.TrieCounter(token_counts.load_scores())
    trie.count(["the", "them", "then", "there"])
    assert trie.nodes == 1 + len("the") + 1 + 1 + 2


def brute_forward(lattice, word):
    if not word:
        return 1.0
    return sum(math.exp(lattice.logp[lattice.by_text[word[:k]]]) * brute_forward(lattice, word[k:])
               for k in range(1, len(word) + 1) if word[:k] in lattice.by_text)


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.load_pieces()
    logp = -np.log(np.arange(len(pieces)) + 2.0)
    lattice = lattice_lm.Lattice(pieces, logp - np.logaddexp.reduce(logp))
    words = [b"hello", b"the", b"x", "été".encode(), b"thingea", b"\xff\x00"]
    assert np.allclose(lattice.log_probs(words), [math.log(brute_forward(lattice, b" " + w)) for w in words])
    long = b"thereon" * 30
    assert math.isclose(lattice.score_long(b" " + long), lattice.forward(m := np.frombuffer(b" " + long, np.uint8)[None], lattice.arcs(m))[-1][0])
    uses = lattice.expectations([b"hello"])
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, pieces) if u), len(b" hello"))


def exact_uses(lattice, word):
    """Expected uses of each piece, from all ways to a place and on from it."""
    n = len(word)
    ways = {0: 1.0}
    arcs = [(a, b, lattice.by_text[word[a:b]]) for b in range(1, n + 1) for a in range(b) if word[a:b] in lattice.by_text]
    p = lambda k: math.exp(lattice.logp[k])
    for b in range(1, n + 1):
        ways[b] = sum(ways[a] * p(k) for a, e, k in arcs if e == b)
    on = {n: 1.0}
    for a in range(n - 1, -1, -1):
        on[a] = sum(p(k) * on[e] for x, e, k in arcs if x == a)
    out = np.zeros(len(lattice.pieces))
    for a, b, k in arcs:
        out[k] += ways[a] * p(k) * on[b] / ways[n]
    return out, math.log(ways[n])


def test_no_piece_and_no_word_is_cut():
    """Every piece takes part, runs of - among them, and words beyond the step-wise form count whole."""
    pieces = lattice_lm.load_pieces()
    assert max(map(len, pieces)) >= 64 and b"-" * 64 in pieces
    logp = -np.log(np.arange(len(pieces)) + 2.0)
    lattice = lattice_lm.Lattice(pieces, logp - np.logaddexp.reduce(logp))
    words = [b"-" * 40, b"=" * 17, b"-" * 90, b"thereon" * 9, b"a" + b"-" * 64 + b"z", "é".encode() * 30]
    want = [exact_uses(lattice, b" " + w) for w in words]
    assert np.allclose(lattice.log_probs(words), [x for _, x in want], rtol=1e-12)
    assert np.allclose(lattice.expectations(words), sum(u for u, _ in want), atol=1e-9)
    assert np.allclose(lattice.expected_long(b" hello"), lattice.expected(np.frombuffer(b" hello", np.uint8)[None]))


def test_score_end_to_end(spark):
    """The score column against the formula, with re-estimation and words of 60 bytes, by plain sums."""
    texts = [(1, "the there - there " + "-" * 60), (2, "thereon" * 9 + " the"), (3, "unseen " + "=" * 20), (4, None)]
    df = documents(spark, [(i, t, None, None, None, 7, "x", 3, "z") for i, t in texts])
    out = {r.doc_id: r.score for r in lattice_lm.score_documents(df, F.col("doc_id") <= 2).collect()}
    count = Counter(w for i, t in texts if i <= 2 for w in t.encode().split())
    ends, d = 2, lattice_lm.DISCOUNT
    n, v = sum(count.values()) + ends, len(count) + 1
    pieces = lattice_lm.load_pieces()
    logp = -np.log(np.arange(len(pieces)) + 2.0)
    logp -= np.logaddexp.reduce(logp)
    for _ in range(lattice_lm.ROUNDS):
        lattice = lattice_lm.Lattice(pieces, logp)
        uses = 1e-3 + sum(exact_uses(lattice, b" " + w)[0] for w in count)
        logp = np.log(uses) - math.log(uses.sum() + ends)
    lattice = lattice_lm.Lattice(pieces, logp)

    def token(w):
        return math.log10(max(count[w] - d, 0) / n + d * v / n * math.exp(exact_uses(lattice, b" " + w)[1]))
    for i, t in texts:
        want = sum(map(token, (t or "").encode().split())) + math.log10((ends - d) / n)
        assert math.isclose(out[i], want, rel_tol=1e-9), i


def test_likelihood_counts(spark):
    rows = awkward()
    held = crc_mod("doc_id", 7) == 2
    out = lattice_lm.score_documents(documents(spark), ~held).withColumn("held", held).collect()
    import zlib
    count, ends = Counter(), 0
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            count.update((r[1] or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((str(r[0]), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(base, 6)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_likelihood_without_training(spark):
    out = lattice_lm.score_documents(documents(spark), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in out} == {(0, 0, 0.0)}
    assert lattice_lm.score_documents(documents(spark, []), F.lit(True)).collect() == []


def synthetic(n, seed):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "and", "tion", "er"], "de": ["sch", "ung", "und", "keit", "ü"], "es": ["ción", "que", "ado", "ñ", "los"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return rows


def test_language_id_held_out(spark):
    rows = [(i, t, lang, *[None] * 6) for i, t, lang in synthetic(600, 1)] + [(900, None, "en", *[None] * 6), (901, "12 ...", "de", *[None] * 6),
                                                                             (902, "the and", None, *[None] * 6)]
    train = crc_mod("doc_id", 5) != 0
    got = {r.doc_id: r for r in langid.train_and_identify(documents(spark, rows), train).withColumn("held", ~train).collect()}
    held = [r for r in rows[:600] if got[r[0]].held]
    assert len(held) > 50 and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.98
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901)] == [("und", 0.0)] * 2
    assert got[902].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 9])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    assert all((code[a] != code[b]).any() for a in range(n) for b in range(a))
    assert all(len(set(c)) == 2 for c in code.T)


def test_language_features_do_not_depend_on_blocks(monkeypatch):
    text = "Grüße and the señor " * 300
    whole = langid.features(text.encode())
    monkeypatch.setattr(langid, "BLOCK", 97)
    assert np.array_equal(langid.features(text.encode()), whole)


def test_language_id_without_training(spark):
    out = langid.train_and_identify(documents(spark), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)} and len(out) == len(awkward())
    one = langid.train_and_identify(documents(spark, [(1, "only english", "en", *[None] * 6)]), F.lit(True)).collect()
    assert [(r.lang_pred, r.score) for r in one] == [("en", 1.0)]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i, (_, text, lang) in enumerate(synthetic(n, seed)):
        bad = rng.random() < 0.2
        words = text.split()
        for _ in range(max(2, len(words) // 25) if bad else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "scum", "moron"] if lang == "en" else [f"lowei{rng.choice('abcdef')}er"]))
        rows.append((i, " ".join(words), lang, *[None] * 6))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(1200, 4)
    rows += [(5000, None, *[None] * 7), (5001, "", *[None] * 7)]
    docs = documents(spark, rows)
    marks = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    train = crc_mod("doc_id", 4) != 2
    model = toxicity.train(docs, marks, train)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).withColumn("held", ~train).collect()}
    held = [(got[i].score >= toxicity.THRESHOLD, y) for i, _, y in labels if got[i].held]
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 2
    assert got[5000].score == got[5001].score < toxicity.THRESHOLD
    kept = toxicity.keep_civil(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < toxicity.THRESHOLD}


def test_toxicity_prior_does_not_follow_the_sample(spark):
    """Where the text tells nothing, the score is the share of all training labels, also when the cap binds for one class."""
    docs = documents(spark, [(i, "the same words", "en", *[None] * 6) for i in range(360)])
    marks = spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(360)], "doc_id long, quality int, toxic int")
    whole, capped = (toxicity.train(docs, marks, F.lit(True), n).score("the same words") for n in (360, 60))
    assert 0.1 < whole < 0.2 and abs(whole - capped) < 0.01


@pytest.mark.parametrize("sample,rows", [(1000, 360), (20, 40)])
def test_toxicity_sample_is_bounded_whatever_repeats(spark, monkeypatch, sample, rows):
    """An id with a third of all rows, ids with many texts and repeated labels: a row for each text of a sampled id."""
    fitted = []
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, *a, **b: (fitted.append(len(x)), fit(x, *a, **b))[1])
    texts = [(i, f"text {i}") for i in range(60)] + [(7, "text 7")] * 500 + [(i, f"other {k}") for i in (8, 9) for k in range(150)]
    docs = documents(spark, [(i, t, "en", *[None] * 6) for i, t in texts])
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(60)] * 5, "doc_id long, quality int, toxic int")
    toxicity.train(docs, marks, F.lit(True), sample)
    assert fitted == [rows]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark), none, F.lit(True))
    assert {round(r.score, 6) for r in toxicity.score_documents(documents(spark), model).collect()} == {0.0}


def test_label_model_counts_correlated_voters_once():
    """Copies of a voter change next to nothing."""
    rng = np.random.default_rng(0)
    y = (rng.random(6000) < 0.3).astype(float)
    strong, weak, told = (np.where(rng.random(6000) < a, y, 1 - y) for a in (0.95, 0.65, toxicity.TRUST))
    once = toxicity.label_model(np.stack([strong, weak], 1), told)
    copied = toxicity.label_model(np.stack([strong, weak, weak, weak], 1), told)
    assert np.abs(once - copied).mean() < 0.02
    assert ((once > 0.5) == (y == 1)).mean() > 0.94
