"""SimHash, embeddings, components, mixing, the token store and WARC against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest

from spanwise.llm import components, embed_dedup, mixing, similar, simhash, token_store, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_components(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(3)
    n = 300
    pairs = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(220)]}[kind]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = plain_components(n, pairs)
    ends = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in ends}


def plain_fingerprint(text):
    import xxhash

    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    for k in range(60):  # near copies of a few long texts
        base = texts[k % 4].split() * 6
        base[rng.randrange(len(base))] = "other"
        texts.append(" ".join(base))
    texts += [None, "", "  \n", "One two", "one  TWO\n", "É é", texts[0], "x " * 30_000]
    rows = [(i * 3, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fp = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    want = plain_components(len(fp), pairs)
    for i, f in enumerate(fp):
        assert got[i * 3].fingerprint == f"{f:016x}"
        assert got[i * 3].component_id == want[i] * 3
    monkeypatch.setattr(simhash, "MOST_ROWS", 3)  # prefixes are dealt into blocks
    again = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "fp", "source": "label"})).collect()}
    assert again == {k: r.component_id for k, r in got.items()}


def test_trie_join_of_a_dense_group():
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 62))
    x = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(36, rng.integers(1, 6), replace=False)) for _ in range(3000)], np.uint64))
    got = simhash.trie_links(x).roots()
    want = components.Forest(len(x))
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, 1))
    want.link(i, j)
    assert (got == want.roots()).all()


def test_deals_are_reversible():
    x = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for k in range(16):
        assert (simhash.undeal(simhash.deal(x, k), k) == x).all()


def test_simhash_repeated_and_null_ids(spark):
    rows = [(1, "a b c d", None, None, 0), (1, "a b c d", None, None, 0), (None, "a b c d", None, None, 0), (None, "zz yy", None, None, 0), (2, "a b c d", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def plain_shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\\x20\\x09-\\x0D]+", text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, words, text, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split())


def test_similar_groups_match_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 150))) for _ in range(150)]
    texts += [edited(rng, words, texts[k % 50], rng.choice([0.005, 0.01, 0.02, 0.04])) for k in range(250)]
    texts += [None, "", " \n", "One two", "one  TWO\n", texts[3].upper(), "long " * 40_000, "É é", "é É"]
    rows = [(i * 3, t, "en", "s", 0) for i, t in enumerate(texts)]
    sets = [plain_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    want = plain_components(len(texts), near)
    kept = similar.one_of_each(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id // 3 for r in kept.collect()}
    assert set(want) <= got and len(got - set(want)) <= 0.01 * len(near)
    assert not any(i != j and sets[i] == sets[j] for i in got for j in got)
    monkeypatch.setattr(similar, "MOST_ROWS", 20)  # every prefix is dealt into blocks
    again = {r.doc_id // 3 for r in similar.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert again == got


def test_similar_keeps_a_row_of_each_group_whatever_its_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "A b c d"), (None, "zz yy"), (None, "zz yy"), (None, "qq rr ss"), (2, "a b c d"), (3, "kk ll mm nn"), (3, "oo pp uu vv"), (4, None), (5, "oo pp uu vv")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    names = {"lang": "label", "source": "key", "n_chars": "text_key"}
    kept = similar.one_of_each(docs.withColumnsRenamed(names))
    assert kept.columns == ["doc_id", "text", *names.values()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == [(1, "a b c d"), (3, "kk ll mm nn"), (3, "oo pp uu vv"), (4, None), (None, "qq rr ss"), (None, "zz yy")]
    assert similar.one_of_each(docs.limit(0)).count() == 0


def test_wide_trie_join_links_what_all_pairs_link():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64)
    fp[300:600] = fp[5]
    for k in range(300, 900):
        fp[k, rng.integers(0, 4, 9)] ^= np.uint64(1) << rng.integers(0, 60, 9).astype(np.uint64)
    node = np.sort(rng.integers(0, 3, 900) << 16 | rng.integers(0, 1 << 16, 900) & 0x0F0F)
    i, j, d = similar.trie_edges(node, fp)
    far = np.bitwise_count(fp[:, None] ^ fp[None, :]).sum(axis=2, dtype=np.int64)
    ok = (node[:, None] >> 16 == node[None, :] >> 16) & (np.bitwise_count(node[:, None] ^ node[None, :]) <= similar.ERRORS) & (far <= similar.LEVELS[-1])
    assert (d == far[i, j]).all() and ok[i, j].all()
    want = plain_components(900, [p for p in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(ok, 1))))])
    assert plain_components(900, list(zip(i.tolist(), j.tolist()))) == want and len(i) == 900 - len(set(want))


def test_wide_fingerprints_count_bits():
    texts = ["a b c d e f g", "x " * 3000 + " ".join(map(str, range(1200))), "", "one"]
    key, bounds, _ = similar.shingles(texts)
    got = similar.fingerprints(key, bounds)
    for k in range(len(texts)):
        mine = key[bounds[k] : bounds[k + 1]]
        for part in range(4):
            h = similar.tn.mixed(mine ^ np.uint64(0x9E37 + part)).tolist()
            assert int(got[k, part]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24))
    for k in range(300, 600):
        x[k] = x[k % 40] + 0.12 * rng.normal(size=24)
    x[600:640] = x[7]
    rows = [(k * 2, v.tolist(), 0) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=60).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.triu(u @ u.T >= 0.9, 1)
    i, j = np.nonzero(hit)
    links = hit.sum(axis=0) + hit.sum(axis=1)
    found = np.array([got[k * 2].n_links for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    want = plain_components(len(x), list(zip(i.tolist(), j.tolist())))
    assert np.mean([got[k * 2].component_id == want[k] * 2 for k in range(len(x))]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_that_link_with_nothing(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 1.1]), (7, [1.0, 1.0, 1.0]), (8, []), (None, [1.0, 1.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 3, 5), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 3, 5), (5, 3, 5), (6, 3, 5), (7, 0, 7), (8, 0, 8)]


def test_embeddings_of_a_heap_over_many_blocks(spark):
    """A third of all vectors lie in one heap, twenty times what a leaf wants; its rows are dealt into blocks."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2400, 32))
    x[:800] = x[0] + 0.25 * rng.normal(size=(800, 32))
    x[800:1000] = x[1000:1200] + 0.3 * rng.normal(size=(200, 32))
    rows = [(k, v.tolist(), 0, 1, 2) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, class int, width int")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(frame, leaf=40, most_rows=150).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.triu(u @ u.T >= 0.9, 1)
    links = hit.sum(axis=0) + hit.sum(axis=1)
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 100_000
    want = plain_components(len(x), list(zip(*map(np.ndarray.tolist, np.nonzero(hit)))))
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.99
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n, share", [(2000, 0.33), (12_000, 0.33), (40_000, 0.33), (40_000, 0.02)])
def test_forest_keeps_linked_pairs_together(n, share):
    """Recall of linked pairs by shared leaves does not fall as a heap grows with the table."""
    rng = np.random.default_rng(n)
    x, m = rng.normal(size=(n, 64)), int(n * share)
    x[:m] = x[0] + 0.25 * rng.normal(size=(m, 64))
    k = (n - m) // 4
    x[m : m + k] = x[m + k : m + 2 * k] + rng.uniform(0.1, 0.45, size=(k, 1)) * rng.normal(size=(k, 64))
    x = embed_dedup.unit(x)
    depth = int(np.ceil(np.log2(n / embed_dedup.LEAF)))
    held = [set() for _ in range(n)]
    for t in range(embed_dedup.trees_for(depth)):
        for r, path in zip(*map(np.ndarray.tolist, embed_dedup.leaves(embed_dedup.grow(x[rng.permutation(n)[:8000]], depth, t), x))):
            held[r].add((t, path))
    pairs = [*zip(rng.integers(0, m, 2000).tolist(), rng.integers(0, m, 2000).tolist()), *zip(range(m, m + k), range(m + k, m + 2 * k))]
    together = [bool(held[i] & held[j]) for i, j in pairs if x[i] @ x[j] >= 0.9]
    assert len(together) > 1000 and np.mean(together) > 0.99


def sources(spark, sizes):
    rng = random.Random(2)
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * rng.randrange(1, 30)), "en", s, 0))
            k += 1
    return spark.createDataFrame(rows, DOCS)


def test_mixing_meets_its_limits(spark):
    docs = sources(spark, {"a": 400, "b": 60, None: 30})
    planned, mix = mixing.plan(docs, most_repeats=2.0)
    rows = planned.toPandas()
    want = {r["source"]: r for r in mix.sources.collect()}
    assert max(r["repeats"] for r in want.values()) == pytest.approx(2.0, abs=1e-4)
    assert min(r["repeats"] for r in want.values()) == pytest.approx(1.0, abs=1e-4)
    assert rows["blocks"].min() >= 1
    for s, r in want.items():
        mine = rows[rows["source"].isna()] if s is None else rows[rows["source"] == s]
        target = r["weight"] * mix.budget
        emitted = (mine["tokens"] * mine["blocks"]).sum()
        assert target - 1e-3 * target - 1 <= emitted <= target + mine["tokens"].max() + 1e-3 * target
    _, even = mixing.plan(docs, entropy=0.9)
    assert even.entropy / np.log(3) == pytest.approx(0.9, abs=1e-3)


def test_mixing_blocks_are_permutations(spark):
    docs = sources(spark, {"a": 100, "b": 20})
    rows = mixing.schedule(docs, most_repeats=3.0).toPandas()
    for (_, block), part in rows.groupby(["source", "block"]):
        assert part["doc_id"].is_unique
    assert len(rows[rows["block"] == 0]) == 120
    out = mixing.mixed(docs.withColumnRenamed("n_chars", "blocks"), most_repeats=3.0)
    assert out.columns[-1] == "blocks" and out.count() == len(rows)


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, "z", 0), (2, "", None, "z", 0), (3, "a b", None, None, 0), (3, "a b", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r.doc_id for r in mixing.schedule(docs, most_repeats=2.0).collect()) == [1, 2, 3, 3]
    assert mixing.schedule(docs.limit(0), most_repeats=2.0).count() == 0


def test_word_counts(spark):
    rows = [("",), (None,), ("a",), (" a  b\n\tc ",)]
    assert [r.n for r in spark.createDataFrame(rows, "t string").select(mixing.words(__import__("pyspark").sql.functions.col("t")).alias("n")).collect()] == [0, 0, 1, 3]


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_matches_the_library(tokenizer):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(1)
    library, encode = Tokenizer.from_file(tokenizer), token_store.Encoder(tokenizer)
    alphabet = list("abzAZ'st’ré.,!?-_ \n\t\r\x0b\x00\x1c\x85İıßΣσςΩ½²9 1́e |<>") + ["'s", "'re", "<|endoftext|>", "\U0001f600", "日本", "don't ", "  "]
    for _ in range(150):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 6))]
        for first, ids, n in encode(pa.array(texts)):
            at = 0
            for text, m in zip(texts[first : first + len(n)], n.tolist()):
                assert ids[at : at + m].tolist() == library.encode(text, add_special_tokens=False).ids
                at += m


def test_token_store_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    words = ["word%d" % i for i in range(500)] + ["Été", "ñandú,"]
    shared = " ".join(rng.choice(words) for _ in range(4000))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 900))) for _ in range(60)] + [shared, shared, "lead " + shared + " tail", None, "", "a" * 5000]
    rows = [(i * 2, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, "again", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(token_store.encode_and_verify(docs, tokenizer, shard_tokens=4000).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(tokenizer), 0
    want = sorted((i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == start and r.verified
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert token_store.encode_and_verify(docs.limit(0), tokenizer).count() == 0


def test_shared_chunks_are_stored_once_and_damage_is_seen(spark, tokenizer, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(6000))
    docs = spark.createDataFrame([(i, text if i < 4 else text + " end") for i in range(6)], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, tokenizer, 2, path)
    records = spark.read.parquet(f"{path}/records")
    assert records.selectExpr("sum(size(payloads))").first()[0] == records.select(F.explode("digests").alias("d")).distinct().count()
    broken = f"file://{tmp_path}/broken"
    flip = F.transform("payloads", lambda p, i: F.when(i == 0, F.element_at("payloads", -1)).otherwise(p))
    records.withColumn("payloads", F.when(F.size("payloads") > 1, flip).otherwise(F.col("payloads"))).write.parquet(f"{broken}/records")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{broken}/manifest")
    assert all(r.verified for r in token_store.digests_of(spark, path).collect())
    assert not all(r.verified for r in token_store.digests_of(spark, broken).collect())


def test_cut_points_follow_content():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 40_000, 20_000).astype(np.int32)
    b = np.concatenate([rng.integers(0, 40_000, 777).astype(np.int32), a])
    (one,) = token_store.cut_points(a, np.array([len(a)]))
    (two,) = token_store.cut_points(b, np.array([len(b)]))
    sizes = np.diff([0, *one])
    assert sizes[:-1].min() >= token_store.SHORTEST and sizes.max() <= token_store.LONGEST
    assert len(set(one) & {x - 777 for x in two}) > 0.6 * len(one)


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_warc_round_trip(spark, split):
    rng = random.Random(4)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("<p>é \x1f\x8b\x08") for _ in range(rng.randrange(0, 3000)))) for i in range(80)]
    pages += [(100 + i, "http://copy", pages[3][2]) for i in range(5)] + [(200, "u", None), (201, "u", ""), (202, None, "x"), (202, "u", "x"), (None, "u", "x"), (-7, "u", "x")]
    pages += [(None, f"u{i}", t) for i in range(40) for t in ("x", "only without an id", None)]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), split_bytes=split).collect()
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        payload = (h or "").encode()
        revisit = (h or "") in last and (i is None or i < last[h or ""])
        want.append((i, len(payload), warc.sha1_base32(payload), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert all(r.digest_ok for r in rows)


def test_warc_of_no_pages_and_of_other_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0
    names = "page_id long, url string, html string, digest int, payload string, spread string, refers_to string, n int, copies int, file int"
    odd = spark.createDataFrame([(1, "u", "a", 1, "p", "s", "r", 2, 3, 4), (2, "u", "a", 1, "p", "s", "r", 2, 3, 4)], names)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect()) == [(1, "revisit", 2), (2, "response", None)]


def test_warc_keeps_pages_with_long_urls(spark, monkeypatch):
    rng = random.Random(6)
    pages = [(i, "http://x/?" + "".join(rng.choice("abcdefghij0123456789") for _ in range(n)), "<p>") for i, n in enumerate((10, 65_000, 65_536, 300_000))]
    pages += [(10, "data:," + "a" * 5_000_000, "x"), (11, "http://x/11", "y")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.round_trip(docs, split_bytes=9000).collect()) == [0, 1, 2, 3, 10, 11]
    read = warc.read_warc
    monkeypatch.setattr(warc, "read_warc", lambda archives, split_bytes: read(archives, split_bytes).where("warc_type = 'revisit' OR http_length > 1"))
    with pytest.raises(RuntimeError, match="6 records were written and"):
        warc.round_trip(docs)


def test_warc_reader_owns_each_record_once_and_skips_false_magic(spark, tmp_path):
    import gzip

    body = b"\x1f\x8b\x08" * 400
    parts = [warc.warc_record(i, f"http://x/{i}", body + bytes([i]), None, False, "2024-01-01T00:00:00Z") for i in range(20)]
    raw = b"".join(parts) + gzip.compress(b"no record") + b"\x1f\x8b\x08 not a member"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(raw)
    for split in (1, 7, 100, 10_000):
        found = [f["warc-record-id"] for a in range(0, len(raw), split) for _, f, _ in warc.members(warc.Range(path.open("rb"), len(raw)), a, min(a + split, len(raw)))]
        assert found == [f"<{warc.record_id(i)}>" for i in range(20)]
    assert [warc.page_of(warc.record_id(i)) for i in (0, 5, -3, None, (1 << 62))] == [0, 5, -3, None, 1 << 62]
