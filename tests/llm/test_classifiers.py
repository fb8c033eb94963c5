"""Language, toxicity and quality: held-out accuracy on the small tables, exact parts against plain code, edge cases."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloft.llm import grams, language, quality, toxicity
from tallyloft.llm.common import table
from tallyloft.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
need = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
DOCS = "doc_id long, text string, lang string"


@need
def test_language_on_held_out_documents(spark):
    got = QUERIES["op2_language_id"](spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, f"the cat sat on mat {i}", "en") for i in range(20)] + [(100 + i, f"der hund und die katze {i}", "de") for i in range(20)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 !?", "de"), (203, "и кошка", None), (None, "the mat", None), (204, "the dog " * 30_000, "en"), (204, "the dog", "en")]
    df = spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "1 AS score", "'x' AS lang_pred")
    model = language.fit(df)
    got = {(r["doc_id"], r["lang"]): r for r in language.identify(df, model).collect()}
    assert got[(200, "en")]["lang_pred"] == got[(201, None)]["lang_pred"] == got[(202, "de")]["lang_pred"] == "und"
    assert got[(203, None)]["lang_pred"] in ("de", "en") and got[(203, None)]["rejected"]
    assert got[(None, None)]["lang_pred"] == "en" and got[(204, "en")]["lang_pred"] == "en"
    assert len(got) == 46
    assert language.identify(df.limit(0), model).count() == 0
    nothing = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def test_gram_counts_against_plain_code():
    letters = grams.letter_table()
    text = "Ab c, d'Ef"
    low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    for n in (1, 2, 3, 5):
        want = [low[i : i + n] for i in range(len(low) - n + 1)]
        want = [g for g in want if (g.strip() if n < 3 else " " not in g[1:-1])]
        codes, _ = grams.stream([text], letters)
        ok = grams.inside(codes > 0, n)
        assert ["".join(chr(c) if c else " " for c in codes[i : i + n]) for i in np.flatnonzero(ok)] == want
    table_ = language.counts(["aa", "", "aa b"], letters, 10)
    assert table_.shape == (3, 1024) and table_[1].sum() == 0 and table_[0].sum() == 2 + 3 + 2


def plain_vector(text, idf, bits):
    """Logarithmic counts of hashed n-grams times inverse document frequency, at unit length, as a dictionary."""
    low = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    found = [low[i : i + n] for n in language.ORDERS for i in range(len(low) - n + 1)]
    found = Counter(bucket_of(g, bits) for g in found if (g.strip() if len(g) < 3 else " " not in g[1:-1]))
    x = {b: math.log(1 + n) * float(idf[b]) for b, n in found.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    return {b: v / length for b, v in x.items()} if length else {}


def test_nearest_centroid_against_plain_code(spark):
    rng = np.random.default_rng(6)
    words = {"en": ["the", "cat", "sat", "mat", "on", "dog"], "de": ["der", "hund", "und", "katze", "über", "ist"]}
    rows = [(f"d{i}", " ".join(rng.choice(words[lang], int(rng.integers(3, 12)))), lang) for i, lang in enumerate(["en", "de"] * 30)]
    df = spark.createDataFrame([*rows, (None, "the dog", "en"), ("z", None, "en"), ("y", "the", None)], "doc_id string, text string, lang string").repartition(4)
    model = language.fit(df, bits=9, centroids=3, reject=0.05)
    taught = [(t, lang) for _, t, lang in rows] + [("the dog", "en")]
    df_counts = Counter(b for t, _ in taught for b in plain_vector(t, np.ones(512), 9))
    idf = [math.log((1 + len(taught)) / (1 + df_counts[b])) + 1 for b in range(512)]
    assert model.idf == pytest.approx(idf, rel=1e-5)
    assert sorted(set(model.languages)) == ["de", "en"] and len(model.languages) == 6
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(np.ones(6), rel=1e-5)
    cosines = lambda text: [sum(v * float(c[b]) for b, v in plain_vector(text, idf, 9).items()) for c in model.centroids]
    for lang in ("de", "en"):
        # A bound for each language: the cosine to the nearest own centroid that all but a few of its texts reach.
        best = [max(c for c, name in zip(cosines(t), model.languages) if name == lang) for t, of in taught if of == lang]
        mine = [float(n) for n, name in zip(model.near, model.languages) if name == lang]
        assert mine == pytest.approx([float(np.quantile(best, 0.05))] * 3, abs=1e-4)
    asked = [t for t, _ in taught] + ["dog und hund", "xyz qqq", "KATZE!"]
    lang, score, far = model.predict(asked, grams.letter_table())
    for i, t in enumerate(asked):
        c = cosines(t)
        assert lang[i] == model.languages[int(np.argmax(c))] and score[i] == pytest.approx(min(1, max(c)), abs=1e-4)
        assert abs(max(c) - model.near[int(np.argmax(c))]) < 1e-4 or far[i] == (max(c) < model.near[int(np.argmax(c))])


def test_clusters_against_plain_code():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(0, 1, (40, 5)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = x.tolist()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    mean = [sum(c) / len(rows) for c in zip(*rows)]
    chosen = [max(range(40), key=lambda i: dot(rows[i], mean))]
    while len(chosen) < 3:
        chosen.append(min(range(40), key=lambda i: max(dot(rows[i], rows[j]) for j in chosen)))
    centres = [rows[i] for i in chosen]
    for _ in range(12):
        of = [max(range(3), key=lambda j: dot(r, centres[j])) for r in rows]
        for j in range(3):
            mine = [r for r, o in zip(rows, of) if o == j]
            if mine:
                m = [sum(c) / len(mine) for c in zip(*mine)]
                centres[j] = [v / math.sqrt(dot(m, m)) for v in m]
    assert language.cluster(x, 3) == pytest.approx(np.array(centres), abs=1e-9)


@need
def test_toxicity_finds_labelled_and_spares_clean(spark):
    docs, labels = table(spark, SMALL.replace("0.01", "0.1"), "documents"), table(spark, SMALL.replace("0.01", "0.1"), "labels")
    model = toxicity.fit(docs, labels, learn=~toxicity.F.expr("crc32(cast(doc_id as string)) % 3 = 1"))
    got = toxicity.score(docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 1").select("doc_id", "text", "toxic"), model, keep_text=False).collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    caught, lost = sum(r["predicted"] for r in toxic), sum(r["predicted"] for r in clean)
    print(f"toxic caught {caught} of {len(toxic)}, clean rejected {lost} of {len(clean)}")
    assert caught / len(toxic) >= 0.9 and lost / len(clean) <= 0.01


def test_toxicity_generalises_to_misspellings_and_odd_input(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghi"), 5)) for _ in range(60)]
    text = lambda bad: " ".join(list(rng.choice(words, 30)) + ([str(rng.choice(["zorkwad", "zorkwads", "zorkwady"]))] if bad else []))
    rows = [(i, text(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (900, 1), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    ask = spark.createDataFrame([(1, text(False) + " zorkwadly"), (2, text(False)), (3, None), (4, ""), (5, "12 !"), (6, (text(False) + " ") * 400 + "zorkwadd"), (7, text(False))], "doc_id long, text string").selectExpr("*", "'old' AS score", "5 AS predicted")
    got = {r["doc_id"]: r for r in toxicity.score(ask, model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 0, 0, 0, 0, 1, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.fit(df, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(ask, none).collect()} == {0}
    assert toxicity.score(ask.limit(0), model).count() == 0


def plain_grams(word):
    """The character n-grams of a word's runs of letters, with an end at either side."""
    out = []
    for run in "".join(c if c.isalpha() else " " for c in word).split():
        edged = f" {run} "
        out += [edged[i : i + n] for n in toxicity.ORDERS for i in range(len(edged) - n + 1)]
    return out


def plain_bags(text, window):
    """The words of each bag: every occurrence, words without letters left out, the last bag with what is left over."""
    words = [w for w in text.lower().split() if plain_grams(w)]
    cuts = [i for i in range(0, len(words), window) if i == 0 or len(words) - i >= window]
    return [words[a:b] for a, b in zip(cuts, cuts[1:] + [len(words)])]


def bucket_of(gram, bits):
    codes = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
    return int(grams.buckets(codes, len(gram), bits)[0])


def plain_logit(text, weight, bias, bits, window):
    z = []
    for bag in plain_bags(text, window):
        found = [weight[bucket_of(g, bits)] for w in bag for g in plain_grams(w)]
        z.append(sum(found) / max(len(found), toxicity.FULL))
    share = [math.exp(x) for x in z]
    return bias + sum(x * s for x, s in zip(z, share)) / sum(share) if z else bias


def test_scoring_against_plain_code():
    rng = np.random.default_rng(2)
    texts = ["one two, three-four 12 five five five", "a", "", None, "zz " * 41, "Ünïcode çafé %% naïve", "12 !"]
    for window in (1, 2, 3):
        model = toxicity.ToxicityModel(rng.normal(0, 9, 1 << 12).astype(np.float32), -0.7, 12, window)
        score = model.scorer(grams.letter_table())
        for ask in (texts, texts[::-1]):  # the second time from what the first has kept
            want = [plain_logit(t or "", model.weight, -0.7, 12, window) for t in ask]
            assert score(ask) == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_one_training_step_is_the_gradient_of_the_loss():
    rng = np.random.default_rng(4)
    texts, toxic, share = ["bad words here and", "good good text", "so bad"], np.array([1, 0, 1]), np.array([0.6, 1.4, 0.6])
    bits, dim, window, rate = 8, 3, 2, 0.5
    words = sorted({w for t in texts for w in t.split()})
    ids, sizes = toxicity.word_grams(words, grams.letter_table(), bits)
    assert [sorted(bucket_of(g, bits) for g in plain_grams(w)) for w in words] == [sorted(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    emb, soft, bias = rng.normal(0, 1, ((1 << bits) + 1, dim)), rng.normal(0, 1, (2, dim)), np.array([0.1, -0.2])
    emb[-1] = 0

    def loss(emb, soft, bias):
        """The mean weighted log-loss, the weights that lean to the most toxic bags held as they are."""
        total = 0.0
        for t, y, s, held in zip(texts, toxic, share, weights):
            z = [sum(emb[bucket_of(g, bits)] @ (soft[1] - soft[0]) for w in bag for g in plain_grams(w)) / max(sum(len(plain_grams(w)) for w in bag), toxicity.FULL) for bag in plain_bags(t, window)]
            p = 1 / (1 + math.exp(-(np.dot(z, held) + bias[1] - bias[0])))
            total -= s * math.log(p if y else 1 - p)
        return total / len(texts)

    weights = []
    for t in texts:
        z = np.array([sum(emb[bucket_of(g, bits)] @ (soft[1] - soft[0]) for w in bag for g in plain_grams(w)) / max(sum(len(plain_grams(w)) for w in bag), toxicity.FULL) for bag in plain_bags(t, window)])
        weights.append(np.exp(z) / np.exp(z).sum())
    new = [emb.copy(), soft.copy(), bias.copy()]
    which = np.array([words.index(w) for t in texts for w in t.split()])
    owner = np.repeat(np.arange(3), [len(t.split()) for t in texts])
    toxicity.step(*new, ids, sizes, which, owner, window, toxic, share, rate)
    for k, (old, fresh, speed) in enumerate(zip((emb, soft, bias), new, (rate, 0.1, 0.1))):
        for at in [tuple(x) for x in np.argwhere(old != fresh)[:12]] or [(0,) * old.ndim]:
            sides = []
            for h in (1e-5, -1e-5):
                moved = [emb.copy(), soft.copy(), bias.copy()]
                moved[k][at] += h
                sides.append(loss(*moved))
            assert old[at] - fresh[at] == pytest.approx(speed * (sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-9), (k, at)


class PlainKneserNey:
    def __init__(self, texts):
        seq = [[0, 0, 0] + [min(ord(c), 65535) for c in t] for t in texts]
        tables = [Counter(tuple(s[i : i + 4]) for s in seq for i in range(len(s) - 3))]
        for n in (3, 2, 1):
            tables.append(Counter(g[1:] for g in tables[-1]))
        self.tables = {len(next(iter(t))): t for t in tables}
        self.d = {}
        for n, t in self.tables.items():
            k = Counter(t.values())
            n1, n2, n3, n4 = (k[i] for i in (1, 2, 3, 4))
            if not n1 or not n2:
                self.d[n] = [0.5, 0.75, 0.9]
            else:
                y = n1 / (n1 + 2 * n2)
                raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
                self.d[n] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def p(self, gram):
        if not gram:
            return 1 / 65536
        t = self.tables[len(gram)]
        mine = {g: c for g, c in t.items() if g[:-1] == gram[:-1]}
        less = self.p(gram[1:])
        if not mine:
            return less
        cut = lambda c: self.d[len(gram)][min(c, 3) - 1]
        total = sum(mine.values())
        own = (mine[gram] - cut(mine[gram])) / total if gram in mine else 0
        return own + sum(map(cut, mine.values())) / total * less

    def nll(self, text):
        s = [0, 0, 0] + [min(ord(c), 65535) for c in text]
        return -sum(math.log(self.p(tuple(s[i : i + 4]))) for i in range(len(s) - 3))


TRUSTED = ["the cat sat on the mat.", "The dog, the cat; a mat", "on a mat the dog sat", "é 12 😀", "cat"]
ASKED = [*TRUSTED, "", "zebra!", "THE CAT", "a\nb", "漢字 and 😀😎", None]


@pytest.mark.parametrize("chars,pairs", [(1 << 10, 1 << 12), (1 << 10, 20), (8, 1 << 12)])
def test_kneser_ney_against_plain_code(spark, monkeypatch, chars, pairs):
    """Through character pairs, and through sorted lists where there are too many of them."""
    monkeypatch.setattr(quality, "CHARS", chars)
    monkeypatch.setattr(quality, "PAIRS", pairs)
    monkeypatch.setattr(quality, "BLOCK_ROWS", 3)
    rows = list(enumerate(ASKED)) + [(None, TRUSTED[0])]
    docs = quality.filed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    many = quality.blocks(docs.count())
    marked = quality.by_block(docs.select(F.col("doc_id").cast("string").alias("key"), quality.block_of(many).alias("block")).filter(f"key < {len(TRUSTED)}"), many, "trusted")
    counts = quality.count(docs, marked, many)
    seq = [[0, 0, 0] + [min(ord(c), 65535) for c in t] for t in TRUSTED]
    want = Counter(sum(x << 16 * (3 - k) for k, x in enumerate(s[i : i + 4])) for s in seq for i in range(len(s) - 3))
    assert {r["gram"] % 2**64: r["n"] for r in counts.collect()} == want
    plain = PlainKneserNey(TRUSTED)
    path = quality.answers(docs, quality.train(counts), many)
    got = {r["doc_id"]: r for r in quality.perplexities(docs, path, many).collect()}
    for i, t in enumerate(ASKED):
        assert got[i]["chars"] == len(t or "") and got[i]["nll"] == pytest.approx(plain.nll(t or ""), rel=1e-4, abs=1e-6), t
    assert len(got) == len(rows) and got[None]["nll"] == pytest.approx(got[0]["nll"])


@need
def test_quality_keeps_clean_and_rejects_junk(spark):
    got = QUERIES["op10_quality"](spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    print(f"clean rejected {sum(not r['keep'] for r in good)} of {len(good)}, junk kept {sum(r['keep'] for r in bad)} of {len(bad)}")
    assert sum(not r["keep"] for r in good) / len(good) <= 0.01
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.9


def test_limits_smoothing_and_quantiles_against_plain_code(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcde "), int(rng.integers(20, 90)))), str(rng.choice(["en", "de", "xx"], p=[0.6, 0.3, 0.1]))) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(160)], "doc_id long")
    fitted, scores = quality.fit(df, trusted, quantile=0.8, margin=0.01, prior=40.0, enough=12)
    teaches = {r["doc_id"]: r["t"] for r in trusted.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)) > 0).alias("t")).collect()}
    plain = PlainKneserNey([t for i, t, _ in rows if teaches.get(i)])
    nll = {i: plain.nll(t) for i, t, _ in rows}
    held = [(i, t, lang) for i, t, lang in rows if teaches.get(i) is False]
    own = {k for k, n in Counter(lang for *_, lang in held).items() if n >= 12}
    assert own and own < {"en", "de", "xx"}
    mean = {k: sum(nll[i] for i, _, lang in held if k in (None, lang)) / sum(len(t) for _, t, lang in held if k in (None, lang)) for k in (*own, None)}
    drawn = {i: (nll[i] + 40 * mean[lang if lang in own else None]) / (len(t) + 40) for i, t, lang in rows}
    limit = {}
    for k in mean:
        values = sorted(drawn[i] for i, _, lang in held if k in (None, lang))
        limit[k] = values[math.ceil(0.8 * len(values)) - 1] + 0.01
    for r in quality.judge(scores, fitted).collect():
        i, text, lang = rows[r["doc_id"]]
        k = lang if lang in own else None
        assert r["perplexity"] == pytest.approx(math.exp(nll[i] / len(text)), rel=1e-4) and r["smoothed"] == pytest.approx(math.exp(drawn[i]), rel=1e-4)
        assert math.log(r["threshold"]) == pytest.approx(limit[k], abs=1.5e-3)
        if abs(drawn[i] - limit[k]) > 2e-3:
            assert r["keep"] == (drawn[i] <= limit[k])


def test_quality_edge_cases(spark):
    rows = [(i, "the cat sat on the mat " * 5, "en") for i in range(120)] + [(200, None, "en"), (201, "", None), (202, "#%$&" * 400, "xx"), (203, "the mat sat " * 40, None), (None, "the cat " * 30, "en"), (1, "the mat " * 40, "en")]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS nll", "'y' AS perplexity")
    trusted = spark.createDataFrame([(i,) for i in range(110)] + [(None,), (5,), (777,)], "doc_id long")
    fitted, scores = quality.fit(df, trusted)
    got = quality.judge(scores, fitted)
    keep = {r["doc_id"]: r["keep"] for r in got.collect()}
    assert got.count() == len(rows)
    assert [keep[i] for i in (0, 119, 200, 201, 202, 203, None)] == [True, True, False, False, False, True, True]
    fitted, scores = quality.fit(df, trusted.limit(0))
    assert quality.judge(scores, fitted).filter("keep").count() == len(rows) - 2
    fitted, scores = quality.fit(df.limit(0), trusted)
    assert scores.count() == 0
