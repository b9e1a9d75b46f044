"""Language, quality, toxicity, personal data and decontamination on small tables, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from spanwise.llm import decontaminate, langid, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and that with from this which would there have been were their about".split()
FR = "le la les des une dans avec pour sur qui que nous vous être était".split()


def prose(words, n, rng):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for k in range(240):
        words, lang = (EN, "en") if k % 2 else (FR, "fr")
        text = prose(words, 60, rng)
        if k % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if k % 6 == 1:
            text += " you idiot scum. " + prose(words, 10, rng)
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    docs = spark.createDataFrame(rows, DOCS).cache()
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 6 == 1)) for k in range(240)], "doc_id long, quality int, toxic int").cache()
    return docs, labels


def odd_rows(spark):
    return spark.createDataFrame([(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "1234 !!!", "en", "s", 8), (None, "the of and", None, "s", 10), (1003, "the of and", "en", "s", 10), (1003, "the of and", "en", "s", 10), (1004, "the " * 50_000, "en", "s", 200_000)], DOCS)


def test_language_of_held_out_rows_and_odd_rows(spark, corpus):
    docs, _ = corpus
    got = langid.identify(docs.unionByName(odd_rows(spark))).collect()
    known = {r.doc_id: r for r in docs.collect()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in known:
            assert r.lang_pred == known[r.doc_id].lang
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (1000, 1001, 1002)} == {(1000, "und"), (1001, "und"), (1002, "und")}
    assert sum(r.doc_id == 1003 for r in got) == 2


def test_unknown_words_back_off_to_shorter_ngrams(spark, corpus):
    docs, _ = corpus
    model = langid.fit(docs, langid.fold(4) != 2)
    mean, n = langid.scores(model, ["whichther thavewith", "étaitdans vousêtre", "", "123"])
    assert n.tolist() == [2, 2, 0, 0]
    assert [model.languages[i] for i in mean[:2].argmax(axis=1)] == ["en", "fr"]


def test_language_without_labels_is_undetermined(spark):
    got = langid.identify(odd_rows(spark).where("lang is null")).collect()
    assert {r.lang_pred for r in got} == {"und"}
    assert langid.identify(odd_rows(spark).limit(0)).count() == 0


def test_quality_on_held_out_rows(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in got if got[k].held_out]
    assert len(held) > 30
    assert sum(got[k].predicted == truth[k] for k in held) / len(held) > 0.95
    assert all(got[k].predicted == int(got[k].score >= 0.7) for k in got)


def test_quality_of_odd_rows_and_single_class(spark, corpus):
    docs, labels = corpus
    got = quality.classify(docs.unionByName(odd_rows(spark)), labels).collect()
    assert len(got) == 247 and all(0 <= r.score <= 1 for r in got)
    only = quality.classify(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in only} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_keep_good_keeps_columns(spark, corpus):
    docs, labels = corpus
    kept = quality.keep_good(docs.withColumnRenamed("n_chars", "score"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score"]
    predicted = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == predicted


def test_toxicity_scores_and_spans(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert r.predicted == int(k % 6 == 1) == int(r.score >= 0.5)
        for s in r.spans:
            assert set(text[k][s.start : s.end].split()) <= {"idiot", "scum", "you"}


def test_toxicity_of_odd_rows(spark, corpus):
    docs, labels = corpus
    got = toxicity.classify(docs.unionByName(odd_rows(spark)), labels).where("doc_id >= 1000 or doc_id is null").collect()
    assert len(got) == 7 and all(r.predicted == 0 and not r.spans for r in got)
    assert {r.score for r in toxicity.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_of_long_lines_without_stops(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        text = prose(EN, 260, rng)
        if k % 2:
            at = rng.randrange(len(text.split()))
            text = " ".join(text.split()[:at] + ["idiot", "scum"] + text.split()[at:])
        rows.append((k, text, "en", "s", len(text)))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 60 and all(r.predicted == r.doc_id % 2 for r in got)


def test_toxicity_with_nothing_to_learn_from(spark, corpus):
    docs, labels = corpus
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    got = toxicity.classify(docs.selectExpr("doc_id", "'123 456' text", "lang", "source", "n_chars"), labels).collect()
    taught = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0]
    assert {r.score for r in got} == {sum(r.toxic for r in taught) / len(taught)}


def test_one_labelled_id_with_many_texts_teaches_once(spark, corpus):
    docs, labels = corpus
    many = docs.where("doc_id = 1").crossJoin(spark.range(300)).selectExpr("doc_id", "concat(text, ' x', id) text", "lang", "source", "n_chars")
    assert quality.classify(docs.unionByName(many), labels).count() == toxicity.classify(docs.unionByName(many), labels).count() == 540


def test_marginals_of_long_chains_are_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    n, chain = 5000, np.array([0, 3, 1900, 1901, 4700])
    s, move = 3 * rng.normal(size=n), rng.normal(size=(2, 2))
    forward, backward, _ = toxicity.marginals(s, chain, move)
    f, b = s.copy(), np.zeros(n)
    onward = lambda r: np.logaddexp(move[0, 1], r + move[1, 1]) - np.logaddexp(move[0, 0], r + move[1, 0])
    for t in range(1, n):
        if t not in chain:
            f[t] += onward(f[t - 1])
    for t in range(n - 2, -1, -1):
        if t + 1 not in chain:
            r = s[t + 1] + b[t + 1]
            b[t] = np.logaddexp(move[1, 0], move[1, 1] + r) - np.logaddexp(move[0, 0], move[0, 1] + r)
    assert np.allclose(forward, f) and np.allclose(backward, b)


def test_columns_with_the_names_used_inside(spark, corpus):
    docs, labels = corpus
    names = {"lang": "label", "source": "score", "n_chars": "key"}
    odd = docs.withColumns({c: docs["n_chars"] for c in ("fp", "digest", "payload", "row_key", "code", "email", "__text", "spans", "weight")}).withColumnsRenamed(names)
    for f in (lambda d: toxicity.classify(d, labels), lambda d: quality.classify(d, labels), lambda d: pii.digest(pii.find_pii(d))):
        assert f(odd).exceptAll(f(docs)).count() == 0
    assert langid.identify(odd.withColumnRenamed("label", "lang")).exceptAll(langid.identify(docs)).count() == 0


def test_pii_of_a_text_with_very_many_spans(spark):
    import time

    rng = random.Random(2)
    text = "".join(f"mail u{k}@example{rng.randrange(99)}.org, " + "é" * rng.randrange(4) for k in range(40_000))
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    began = time.monotonic()
    row = pii.digest(pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.n_email == 40_000 and row.spans == ",".join(want)
    assert time.monotonic() - began < 60


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    s, move = rng.normal(size=7), rng.normal(size=(2, 2))
    chain = np.array([0, 3, 4])
    got = toxicity.sigmoid(toxicity.marginals(s, chain, move)[2])
    for a, b in zip(chain, [3, 4, 7]):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weight[y] = np.exp(sum(s[a + i] * v for i, v in enumerate(y)) + sum(move[u, v] for u, v in zip(y, y[1:])))
        total = sum(weight.values())
        for i in range(b - a):
            assert got[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / total)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def test_pii_matches_plain_patterns(spark):
    rng = random.Random(1)
    alphabet = list("ab@.@. --++%_0123456789\n()éü\U0001f600") + ["4111 1111 1111 1111", "@x.y", "GB82 WEST 1234 5698 7654 32", "255.", "1.2.3.4", "+49 30 1234567", ".c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(1500)] + [None, "", "a" * 30_000, "1" * 20_000, "a@b" + ".c" * 20_000, "a@b.c " * 500]
    rows = list(enumerate(texts)) + [(None, "x@y.z"), (3, texts[3])]
    got = pii.digest(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    for (k, text), r in zip(rows, got):
        assert r.doc_id == k
        base = [(kind, m.start(), m.end()) for kind, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]
        spans = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert r.spans.startswith(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == kind for x in base) for kind in BASE)


def test_pii_checksums_and_context(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB83 WEST 1234 5698 7654 32"), (3, "credit card 4111 1111 1111 1111"), (4, "4111 1111 1111 1111"), (5, "4111 1111 1111 1112")]
    got = {r.doc_id: r.pii for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x.kind for x in got[1]] == ["iban"] and got[2] == [] and got[5] == []
    assert got[3][0].score > got[4][0].score


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


def test_common_subsequence_matches_plain():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 120))
        assert decontaminate.common_subsequence(a, b) == plain_subsequence(a.tolist(), b.tolist())


def test_decontamination_finds_planted_and_paraphrased(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(4000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))] for _ in range(30)]
    rows, planted = [], set()
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 400))]
        if k % 5 == 0:
            item = k // 5 % 30
            copy = list(items[item])
            if k % 10 == 0:  # a paraphrase: every tenth word is another
                copy = [w if i % 10 else rng.choice(vocabulary) for i, w in enumerate(copy)]
            at = rng.randrange(len(words))
            words[at:at] = copy
            planted.add((k, item))
        rows.append((k, " ".join(words).capitalize() + ".", "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd_rows(spark))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 8)  # four parts, two a pass
    monkeypatch.setattr(decontaminate, "PARTS_AT_ONCE", 2)
    in_parts = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == in_parts
    monkeypatch.undo()
    assert len(planted & got) / len(planted) >= 0.95
    assert got <= planted
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {k for k, _ in got}
    assert kept.where("doc_id is null").count() == 1
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id > 90")).count() == 0


@pytest.mark.parametrize("replaced, answer, least", [(0.18, False, 0.99), (0.33, True, 0.9)])
def test_decontamination_finds_paraphrases_of_long_items(spark, replaced, answer, least):
    """Items of 36 to 60 words with words replaced or put in between; with ``answer`` their rarest words stay. Against the exact rule at every place."""
    import numpy as np

    rng = random.Random(int(replaced * 100))
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 8))) for _ in range(4000)]
    weights = [1 / (k + 10) for k in range(4000)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [draw(rng.randrange(36, 61)) for _ in range(40)]
    held = Counter(w for x in items for w in set(x))
    rows, planted = [], {}
    for k in range(240):
        words = draw(rng.randrange(60, 300))
        item = k % 40
        keep = sorted(set(items[item]), key=lambda w: -vocabulary.index(w))[:6] if answer else []
        copy = []
        for w in items[item]:
            if rng.random() < 0.04:
                copy.append(rng.choice(vocabulary))
            copy.append(w if w in keep or rng.random() >= replaced else rng.choice(vocabulary))
        at = rng.randrange(len(words))
        words[at:at] = copy
        planted[k] = item
        rows.append((k, " ".join(words), "en", "s", 0))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id): (r.covered, r.answered) for r in decontaminate.contaminated(docs, bench).collect()}
    # the rule itself at every place of a text; the answer's words as the operator weighs them
    numbers = {w: i for i, w in enumerate(sorted(held))}
    blocks = Counter()
    for _, text, *_ in rows:
        words = text.split()
        blocks.update(w for a in range(0, len(words), 16) for w in set(words[a : a + 16]))
    want = set()
    for k, item in planted.items():
        code = np.array([numbers.get(w, -1) for w in rows[k][1].split()])
        own = np.array([numbers[w] for w in items[item]])
        rare = sorted(set(items[item]), key=lambda w: (blocks[w], w))[: decontaminate.ANSWER_WORDS]
        one = decontaminate.Item(item, own, np.array([numbers[w] for w in rare]))
        if decontaminate.confirmed(one, *decontaminate.aligned(one, code)):
            want.add((k, item))
    print("paraphrases", replaced, answer, len(want), len(want & set(got)))
    assert len(want) > 60 and len(want & set(got)) >= least * len(want)


def test_decontamination_fits_on_every_document(spark):
    """Cosines in a space fitted on all of 3,000 documents, against dense matrices; the tasks of a table do not change the space."""
    import numpy as np

    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 8))) for _ in range(700)]
    weights = [1 / (k + 10) for k in range(700)]
    draw = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [draw(rng.randrange(34, 49)) for _ in range(30)]
    texts = [draw(rng.randrange(0, 60)) for _ in range(3000)]
    for k in range(0, 3000, 20):
        texts[k][len(texts[k]) // 2 : 0] = items[k // 20 % 30]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.cosine for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(got) >= 150

    known = sorted({w for x in items for w in x})
    known = [known[i] for i in np.argsort(decontaminate.hashed_words(known)[0])]
    number = {w: i for i, w in enumerate(known)}

    def blocks(text):
        rows = np.zeros((-(-len(text) // 16), len(known)))
        for i, w in enumerate(text):
            if w in number:
                rows[i // 16, number[w]] += 1
        return rows

    held, own = [blocks(t) for t in texts], [blocks(t) for t in items]
    every, mine = np.concatenate(held), np.concatenate(own)
    idf = np.log((len(every) + 1) / ((every > 0).sum(axis=0) + 1)) + 1e-3
    gram = (mine * idf).T @ (mine * idf) + 0.25 * len(items) / len(texts) * (every * idf).T @ (every * idf)
    q, _ = np.linalg.qr(np.random.default_rng(decontaminate.SEED).normal(size=(len(known), 80)))
    for _ in range(decontaminate.ROUNDS):
        g = gram @ q
        q, _ = np.linalg.qr(g)
    values, turn = np.linalg.eigh((q.T @ g + g.T @ q) / 2)
    basis = q @ turn[:, np.argsort(-values)[:64]] * idf[:, None]

    def passages(rows):
        x = (rows[:-1] + rows[1:] if len(rows) > 1 else rows) @ basis
        return x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]

    for (k, i), cosine in got.items():
        assert abs((passages(held[k]) @ passages(own[i]).T).max() - cosine) < 1e-4

    codes = [np.array([number.get(w, decontaminate.NONE) for w in t], "<u4").tobytes() for t in texts]
    table = spark.createDataFrame([(c,) for c in codes], "code binary")
    one = decontaminate.latent_space([(table.coalesce(1), 0.5)], idf)
    assert np.array_equal(one, decontaminate.latent_space([(table.repartition(7), 0.5)], idf))


@pytest.mark.parametrize("words", [1, 3, 5, 7, 8, 10, 12, 15, 20, 31])
def test_decontamination_of_short_items_matches_brute_force(spark, words):
    import numpy as np

    rng = random.Random(words)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 8))) for _ in range(3000)]
    common = vocabulary[:40]
    draw = lambda: rng.choice(common if rng.random() < 0.4 else vocabulary)
    items = [[draw() for _ in range(words)] for _ in range(12)]
    rows, planted = [], set()
    for k in range(240):
        text = [draw() for _ in range(rng.randrange(100, 400))]
        if k % 2 == 0:
            item = k // 2 % 12
            copy = list(items[item])
            if k % 4 == 0 and words >= 8:  # some of its words are others
                for i in rng.sample(range(words), words // 4):
                    copy[i] = rng.choice(vocabulary)
            else:
                planted.add((k, item))
            at = rng.randrange(len(text))
            text[at:at] = copy
        rows.append((k, text))
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in rows], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert planted <= got
    if words >= 8:  # nine tenths of the item in order, in a part about as long
        n, wide = words, int(1.3 * words)
        number = {w: i for i, w in enumerate(vocabulary)}
        for k, text in rows:
            t = np.array([number[w] for w in text])
            for i, item in enumerate(items):
                w = np.array([number[x] for x in item])
                if (k, i) not in got and np.isin(t, w).sum() >= 0.8 * n:
                    assert max(decontaminate.common_subsequence(w, t[a : a + wide]) for a in range(0, max(1, len(t) - n + 1), max(1, n // 8))) < 0.9 * n
    else:
        joined = {k: f" {' '.join(t)} " for k, t in rows}
        assert got == {(k, i) for k in joined for i, item in enumerate(items) if f" {' '.join(item)} " in joined[k]}


def test_clean_judges_rows_with_one_id_or_none_each(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    item = " ".join(words[:20])
    other = [" ".join(rng.choice(words[20:]) for _ in range(60)) for _ in range(3)]
    rows = [(None, f"{other[0]} {item}"), (None, other[0]), (7, f"{item} {other[1]}"), (7, other[1]), (8, other[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = decontaminate.clean(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, other[0]), (7, other[1]), (8, other[2]), (None, None)}
