"""The trained operators: gradients, plain recomputation, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa

from burstline.llm import language_id, lm_score, url_filter, wordsets


def test_tagger_gradients():
    model = language_id.ByteTagger(["a", "b", "c"], hidden=3, seed=1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, (6, 4)).astype(np.uint8)
    inside = np.ones((6, 4))
    inside[4:, 1] = 0
    target = np.array([0, 1, 2, 0])

    def loss():
        p, _ = model.probabilities(data, inside)
        return -(np.log(p[target, :, np.arange(4)]).T * inside).sum() / inside.sum()

    grads = model.gradients(data, inside, target)
    for name, w in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)] + ([(0, 97), (4, 98)] if name.startswith("table") else []):
            old = w[at]
            w[at] = old + 1e-2
            up = loss()
            w[at] = old - 1e-2
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-3, (name, at)


LANGUAGES = {"aa": "ka ko ki ta to ti na".split(), "bb": "sch ung ver ein lich keit".split(), "cc": "ção não él où ça".split()}


def language_docs(n=150):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        out.append((i, " ".join("".join(rng.choices(LANGUAGES[lang], k=rng.randint(1, 3))) for _ in range(rng.choice([5, 40, 300]))), lang))
    return out


def test_language_id(spark):
    docs = language_docs()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? 4", "bb"), (1003, "ka to ki na", None), (None, "ung verein keit lich", "bb"), (1003, "ka to ki na", None)]
    rows = spark.createDataFrame([(*d, 1.0, "x") for d in docs + odd], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    marked = rows.withColumn("held_out", language_id.held_out())
    model = language_id.train(marked.where("NOT held_out"), most_docs=60)
    got = {(r.doc_id): r for r in language_id.identify(marked, model, keep=("doc_id", "held_out", "lang")).collect()}
    assert len(got) == len(docs) + 5
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 15 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb" and got[None].held_out is False
    assert language_id.train(rows.limit(0)) is None
    assert language_id.identify(rows, None, keep=("doc_id",)).first().lang_pred == "und"


def test_pooling_reads_whole_texts():
    model = language_id.ByteTagger(["a", "b"], seed=2)
    texts = ["x" * 5, "", "abc" * 100, "é" * 64, "q"]
    arr = wordsets.large(pa.array(texts))
    got = model.pooled(arr, 0, len(texts), width=3)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        total = np.zeros(2)
        for lo in range(0, len(raw), language_id.SPAN):
            part = raw[lo : lo + language_id.SPAN][:, None]
            total += model.probabilities(part, np.ones(part.shape))[0].sum(axis=(1, 2))
        assert np.allclose(got[i], total / max(len(raw), 1), atol=1e-5)


def lm_fitted(rows, size, head=lm_score.HEAD, shares=3):
    counts = lm_score.word_counts(rows)
    vocabulary = lm_score.vocabulary(counts, size, head)
    coded = lm_score.encoded(rows, vocabulary)
    return counts, coded, lm_score.train(coded, vocabulary, shares)


def lm_docs(seed=1):
    rng = random.Random(seed)
    common = [f"w{chr(97 + i)}" for i in range(26)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.7 else f"Rare{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.choice([1, 2, 4, 60])))) for i in range(80)]
    return docs + [(100, None), (101, " \n "), (None, "wa wb"), (3, docs[3][1])]


def test_lm_scores_equal_plain_recomputation(spark):
    docs = lm_docs()
    rows = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_tokens int").repartition(2)
    n = {}
    for _, text in docs:
        for word in (text or "").lower().split():
            n[word] = n.get(word, 0) + 1

    def hashed(word):
        return int(wordsets.Words(wordsets.large(pa.array([word])), 0, 1).hash[0])

    # with counts of the head at hand, and with all but the symbols' joined
    for head in (40, 0):
        counts, coded, network = lm_fitted(rows, 20, head)
        vocabulary, w = network.vocabulary, network.weights
        got = lm_score.score(coded, network, counts).collect()
        assert len(got) == len(docs)
        named = set(sorted(n, key=lambda x: (-n[x], np.uint64(hashed(x)).astype(np.int64)))[:20])
        cls = {x: (ord(x[-1]) * 131 + (ord(x[-2]) if len(x) > 1 else 0) * 31) % vocabulary.classes for x in n}
        members = {c: sorted((x for x in named if cls[x] == c), key=hashed) for c in range(vocabulary.classes)}
        rest = {c: sum(n[x] for x in n if x not in named and cls[x] == c) for c in members}
        first, at = {}, 0
        for c in members:
            first[c], at = at, at + len(members[c]) + 1
        symbol = {x: first[cls[x]] + (members[cls[x]].index(x) if x in named else len(members[cls[x]])) for x in n}

        def plain(text):
            words = (text or "").lower().split()
            symbols = [symbol[x] for x in words]
            total = 0.0
            for i, x in enumerate(words):
                near = [symbols[i - j] if i - j >= 0 else at for j in (1, 2)] + [symbols[i + j] if i + j < len(words) else at for j in (1, 2)]
                h = np.append(np.tanh(np.concatenate([w["embed"][s] for s in near]) @ w["inner"] + w["shift"]), 1)
                c = cls[x]
                for logits, goal in ((w["class"] @ h, c), (w["word"][first[c] : first[c] + len(members[c]) + 1] @ h, symbol[x] - first[c])):
                    total += logits[goal] - np.log(np.exp(logits).sum())
                total += 0 if x in named else np.log(n[x] / (rest[c] + 1))
            return len(words), total

        texts = dict(docs)
        for r in got:
            count, total = plain(texts[r.doc_id])
            assert r.n_tokens == count and abs(r.log_prob - total) < 1e-3 * max(1, count)
            assert (r.mean_log_prob is None) == (count == 0)
        # a word that was never seen has the share of one occurrence
        new = lm_score.encoded(spark.createDataFrame([(1, "neverseenx")], "doc_id long, text string"), vocabulary)
        assert np.isfinite(lm_score.score(new, network, counts).first().log_prob)


def test_lm_weights_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame(lm_docs(4), "doc_id long, text string")
    found = [lm_fitted(rows.repartition(parts), 12)[2].flat() for parts in (2, 8)]
    assert np.abs(found[0] - found[1]).max() < 1e-6


def lm_vocabulary():
    endings = np.array([97 * 256 + i for i in (98, 99, 100, 101)], dtype=np.int32)
    return lm_score.Vocabulary(np.arange(4), endings, np.array([50, 30, 20, 10]), (endings, np.array([50, 30, 20, 15])), 3)


def test_lm_gradients_and_learning():
    network = lm_score.WindowNetwork(lm_vocabulary())
    rng = np.random.default_rng(0)
    network.weights = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in network.weights.items()}
    edge = network.vocabulary.edge
    context, target = rng.integers(0, edge + 1, (4, 50)), rng.integers(0, edge, 50)
    slopes = {k: np.zeros_like(v) for k, v in network.weights.items()}
    for name, rows, slope in network.gradients(context, target):
        slopes[name][rows] += slope
    for name, w in network.weights.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(12)]:
            old, loss = w[at], []
            for step in (1e-4, -1e-4):
                w[at] = old + step
                loss.append(-network.log_probabilities(context, target).sum())
            w[at] = old
            assert abs((loss[0] - loss[1]) / 2e-4 - slopes[name][at]) < 1e-4, (name, at)
    network = lm_score.WindowNetwork(lm_vocabulary())
    left = rng.integers(0, edge, 4000)
    context = np.stack([left, rng.integers(0, edge, 4000), left, rng.integers(0, edge, 4000)])
    before = network.log_probabilities(context, left).mean()
    network.fit(iter([(context[:, i : i + 200], left[i : i + 200]) for i in range(0, 4000, 200)] * 10), rate=0.2)
    assert network.log_probabilities(context, left).mean() > before + 0.5


def test_lm_beats_unigrams_on_held_out_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("text is not null")
    held = docs.where("doc_id % 5 = 0")
    counts, _, network = lm_fitted(docs.where("doc_id % 5 <> 0"), 200, shares=1)
    coded = lm_score.encoded(held, network.vocabulary)
    plain = lm_score.WindowNetwork(network.vocabulary)
    total = lambda model: sum(r.log_prob for r in lm_score.score(coded, model, counts).collect())
    words = coded.agg({"n_tokens": "sum"}).first()[0]
    # an unfitted network gives each word its share of the corpus
    assert total(network) / words > total(plain) / words + 0.1


def test_lm_trains_on_every_word():
    vocabulary = lm_vocabulary()
    sizes, keys = (100, 1, 37), (3, -8, 2)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1], pa.int32()), pa.array(keys, pa.int64()), pa.array([np.zeros(n, np.uint16).tobytes() for n in sizes], pa.binary())], names=["share", "key", "symbols"])
    seen = [[b.column(1)[0].as_py() for b in lm_score._fit(lm_score.WindowNetwork(vocabulary), turn)(iter([batch, batch]))] for turn in range(lm_score.ROUNDS)]
    # the second batch goes back to the first share, as its own run
    assert [sum(x) for x in zip(*seen, strict=True)] == [101, 37, 101, 37]


def test_lm_reads_long_texts_in_parts(spark, monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)) + " " + "x" * 3000 + " end"
    vocabulary = lm_vocabulary()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([7]), pa.array([text])], names=["row", "id", "text"])
    whole = list(lm_score._encode(vocabulary, np.uint16)(iter([batch])))
    for most in (64, 1000):
        monkeypatch.setattr(lm_score, "slices", lambda texts, *_: iter([(0, 1)]))
        monkeypatch.setattr(lm_score, "pieces", lambda texts, row, *_, most=most: wordsets.pieces(texts, row, most))
        parts = list(lm_score._encode(vocabulary, np.uint16)(iter([batch])))
        assert parts[0].column(2).to_pylist() == [5002] and parts[0].column(3) == whole[0].column(3) and parts[0].column(5) == whole[0].column(5)
    symbols = np.frombuffer(whole[0].column(3)[0].as_py(), np.uint16)
    row = np.zeros(len(symbols), dtype=np.int32)
    blocks = list(vocabulary.blocks(symbols, row, most=37))
    assert (np.concatenate([c for _, c, _ in blocks], axis=1) == vocabulary.contexts(symbols, row)).all()


def test_empty_lm(spark):
    rows = spark.createDataFrame([(1, None)], "doc_id long, text string")
    for size in (0, None):
        counts, coded, network = lm_fitted(rows, size, shares=None)
        r = lm_score.score(coded, network, counts).first()
        assert (r.n_tokens, r.log_prob, r.mean_log_prob) == (0, 0.0, None)
    counts, coded, network = lm_fitted(rows.limit(0), None, shares=None)
    assert lm_score.score(coded, network, counts).count() == 0


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_filter(spark):
    urls = [None, "", "no scheme/en/", "http://A.Example.COM/en/7?x#y", "https://x.com/en/9", "http://com/en/", "http://notcom/en/", "ftp://a.net/de/1", "http://b.example.net/de/8", "http://u.org/es/", "http://u.org/es", "x://h?q=/en/", "http://ÄB.com/en/é", "a://b://c/en/", "http://x.com#/en/"]
    rng = random.Random(1)
    for i in range(300):
        bad = i % 3 == 0
        name = rng.choice(["cheap-pills", "casino-win", "free-bets-now"]) if bad else rng.choice(["ther", "anon", "inea", "blog"]) + rng.choice("abc")
        urls.append(f"http{'s' * (i % 2)}://{name}{rng.randrange(99) if bad else ''}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['fr', 'xx'])}/{i}{'?a=1&b=2' if bad else ''}")
    rows = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)] + [(None, urls[4], "h", 1.0)], "page_id long, url string, host string, f_length double")
    got = {r.page_id: r for r in url_filter.judge(rows, RULES).collect()}
    assert len(got) == len(urls) + 1
    for i, url in enumerate(urls):
        host, path, rule, verdict = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("block" if got[i].p_block >= 0.5 else "allow"))
    right = sum((got[i].p_block >= 0.5) == any(w in u for w in ("pills", "casino", "bets")) for i, u in enumerate(urls) if i >= 15)
    assert right / 300 > 0.97
    assert url_filter.judge(rows.limit(0), RULES).count() == 0
