"""The pipeline's stages against plain versions of what each must keep."""

import os
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def holds(text, item):
    """Whether all runs of six words of the item, or the whole of a shorter one, stand in the text."""
    t, i = words(text), words(item)
    n = min(6, len(i))
    grams = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    return n > 0 and all(tuple(i[k : k + n]) in grams for k in range(len(i) - n + 1))


def test_each_stage_does_its_work(spark):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline
    from spanwise.llm import quality
    from spanwise.llm.queries import tokenizer_path
    from spanwise.llm.shared import cut

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = raw, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SF), f"test-{k}")
        seen.append(docs.toPandas())
    kept, unique, clean, mixed, stored = seen
    for part in (kept, unique, clean, mixed):
        assert list(part.columns) == raw.columns

    good = {r.doc_id for r in quality.classify(raw, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(kept.doc_id) == good and len(kept) == len(good)

    sets = [frozenset(zip(*[(t or "").lower().split()[k:] for k in range(5)])) or frozenset((t or "").lower().split()) for t in kept.text]
    near = np.array([[x == y or len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets])
    order, groups = kept.doc_id.to_numpy(), {}
    for i in np.argsort(order):  # flood fill from the least id on
        if i not in groups:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in groups:
                    groups[j] = order[i]
                    todo += np.flatnonzero(near[j]).tolist()
    assert set(unique.doc_id) == set(groups.values()) and unique.doc_id.is_unique

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, t in zip(unique.doc_id, unique.text) if any(holds(t, i) for i in items)}
    assert leaked and not leaked & set(clean.doc_id)
    assert set(clean.doc_id) >= {d for d, t in zip(unique.doc_id, unique.text) if not any(set(words(t)) & set(words(i)) for i in items)}
    assert len(set(unique.doc_id) - set(clean.doc_id) - leaked) <= 0.02 * len(unique)

    assert set(mixed.doc_id) == set(clean.doc_id)
    assert mixed.groupby("doc_id").size().max() <= 2
    one = mixed.drop_duplicates("doc_id").sort_values("doc_id").reset_index(drop=True)
    assert one.equals(clean.sort_values("doc_id").reset_index(drop=True))

    library = Tokenizer.from_file(tokenizer_path())
    text, start = dict(zip(mixed.doc_id, mixed.text)), 0
    assert len(stored) == len(mixed) and stored.verified.all()
    for r in stored.sort_values("start").itertuples():
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, empty texts, clashing columns, an empty benchmark and an empty table."""
    pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F

    import corpus_pipeline
    from spanwise.llm.shared import cut

    raw = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "a b c d e f", "en", None, 11), (None, "a b c d e f", "en", None, 11), (None, None, None, "s", 0), (7, "", "en", "s", 0), (7, "g h i j k l", "en", "s", 11), (7, "g h i j k l", "de", "t", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = raw.unionByName(odd.select(*[F.col(c).cast(t).alias(c) for c, t in raw.dtypes])).withColumns({c: F.lit(1) for c in ("key", "label", "blocks", "score", "code", "text_key")})
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    unique = cut(stages["SimHash near-dedup"](spark, docs, str(tmp_path)), "odd-1")
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    assert rows.count((None, "a b c d e f")) == rows.count((7, "g h i j k l")) == 1 and ((None, None) in rows) != ((7, "") in rows)
    clean = stages["benchmark decontamination"](spark, unique, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows)
    mixed = cut(stages["mixing sources to target weights"](spark, clean, str(tmp_path)), "odd-2")
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} == set(rows)
    stored = stages["token-ID / binary output"](spark, mixed, str(tmp_path)).collect()
    assert len(stored) == mixed.count() and all(r.verified for r in stored)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, str(tmp_path)), "odd-3")
        assert empty.count() == 0, name


def test_decontamination_stage_fits_on_every_row(spark, tmp_path, monkeypatch):
    """The latent space of the stage reads all words of more than 2,000 rows, in sums that equal dense ones."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline
    from spanwise.llm import decontaminate

    vocabulary = [f"w{k}" for k in range(90)]
    rng = np.random.default_rng(6)
    items = [" ".join(rng.choice(vocabulary, 40)) for _ in range(5)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 50))) for _ in range(2600)]
    docs = spark.createDataFrame([(k if k % 3 else None, t, "en", "s", len(t)) for k, t in enumerate(texts + items)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fit, seen = decontaminate.latent_space, []

    def spy(passages, *rest):
        tables = passages if isinstance(passages, list) else [(passages, None)]
        seen.append([[np.frombuffer(r.code, "<u4") for r in table.select("code").collect()] for table, _ in tables])
        return fit(passages, *rest)

    monkeypatch.setattr(decontaminate, "latent_space", spy)
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    assert {r.text for r in stage(spark, docs, str(tmp_path)).collect()} == set(texts) - set(items)
    read = [code for table in seen[0] for code in table]
    assert len(read) == len(texts) + 2 * len(items) and sum(map(len, read)) == sum(len(t.split()) for t in texts + 2 * items)

    # sums of segments of any length
    rows, at = rng.integers(-(1 << 22), 1 << 22, (50, 7)).astype(np.int32), rng.integers(0, 50, 3000)
    begin = np.array([0, 1, 5, 21, 37, 54, 400, 401, 2999])
    assert np.array_equal(decontaminate.segment_sums(rows, at, begin), np.add.reduceat(rows[at].astype(np.int64), begin, axis=0))


def test_quality_stage_fits_on_every_labelled_row(spark, tmp_path, monkeypatch):
    """Context vectors and means of the stage's model are those of all labelled texts, more than 6,000, by plain sums."""
    pytest.importorskip("public_tokenizers")
    from collections import Counter

    from pyspark.sql import functions as F

    import corpus_pipeline
    from spanwise.llm import quality

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(60)], rng.integers(1, 16))) + (" BUY!!! NOW!!!" if i % 10 == 0 else "") for i in range(9400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(9400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    fit, nets = quality.fit, []
    monkeypatch.setattr(quality, "fit", lambda *a: nets.append(fit(*a)) or nets[-1])
    kept = dict(corpus_pipeline.STAGES)["quality classifier"](spark, docs, str(tmp_path))
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [i for i in range(9400) if i % 10]

    taught = [i for i in range(9400) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(taught) > 6000
    number = {w: int(quality.buckets(quality.words_of([w]).hash, quality.BUCKETS)[0]) for w in {w for t in texts for w in t.split()}}
    near = Counter((number[w], number[v[j]]) for v in (texts[i].split() for i in taught) for k, w in enumerate(v) for j in range(max(0, k - 2), min(len(v), k + 3)) if j != k)
    want, index = np.zeros((quality.BUCKETS, quality.DIMENSIONS)), quality.index_vectors(quality.BUCKETS, 1)
    for (w, v), n in near.items():
        want[w] += n * index[v]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.abs(want).any() and np.abs(nets[0].contexts - want).max() < 1e-6

    late = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).collect()}
    x = quality.pooled([texts[i] for i in taught if i not in late], nets[0].contexts)
    assert np.allclose(nets[0].mean, x.mean(axis=0), atol=1e-5) and np.allclose(nets[0].spread, x.std(axis=0) + 1e-3, atol=1e-5)

    # two rows, too few to keep one back
    net = quality.fit(docs, labels.where("doc_id in (10, 11)"), F.lit(True))
    assert np.diff(net.scores(quality.pooled([texts[10], texts[11]], net.contexts)))[0] > 0.5


def test_entry_works_without_the_subpackage(tmp_path):
    """The registry imports and has its other queries where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "spanwise", tmp_path / "spanwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql(); from spanwise.session import local_session; s = local_session(2); assert q['v01_local_maxima'](s, '/root/testdata/sf0.001').count() > 0; s.stop()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
