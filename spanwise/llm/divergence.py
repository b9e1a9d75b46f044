"""How far the sources of a language are from each other and from the language, by joint count histograms.

Tasks count the terms of whole texts by (language, source); sums follow in a shuffle
of these counts, so that a source with a third of all rows is a row a term and task. A
language keeps the terms that enough of its documents hold. Every group gives each kept
term a smoothed probability ``p`` as a whole number, which depends on the group's count
of the term alone. So the distance of two groups needs no pass over terms pair by
pair: for a pair of groups it is tallied how many terms have which two counts, and
``|p - q|`` is evaluated once for each such combination and multiplied.

Combinations with a zero are implied: of the terms that one group counts ``c`` times,
those that the tally does not pair with a count of the other have a zero there. With
``f(c, d)`` the distance at these counts and ``h`` a group's own histogram of counts,

    value = sum over the tally of m * (f(c, d) - f(c, 0) - f(0, d) + f(0, 0))
          + sum over h_a of m * (f(c, 0) - f(0, 0)) + sum over h_b of m * (f(0, d) - f(0, 0)) + V * f(0, 0)

Tallies are made in tasks from a term's row of counts, and only distinct combinations
leave them. Groups are numbered within a language and dealt into blocks of ``BLOCK``;
a term's row is cut into its blocks, and two blocks meet in a row of their own,
so that a term that very many sources hold is not one task's work. A group's own histogram is one row;
it has no more entries than the square root of twice its count of terms.

All arithmetic is exact: whole numbers, in 38 decimal digits where counts are multiplied.

Defined cases: null text, language and source are empty; a group without terms counts
zero throughout; in a language that keeps no term all distances are 0 and no term is
listed; rows that repeat, or have no ``doc_id``, are documents each; a language of
one source has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, scratch, tidy

#: Documents of a language that hold a term which is kept, what is added to a count, the scale of probabilities, and ranks of terms.
LEAST_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Groups of a block.
BLOCK = 64
#: Counts of terms that a task holds before it passes them on, and pairs of counts that it tallies at once.
HELD, TALLIED = 250_000, 1 << 21

#: For each byte of UTF-8 what it is in a term: A-Z in lower case, letters and all of other alphabets as they are, else a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# ---- counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, text`` to ``lang, source, term, n, docs``: occurrences and documents, summed over what a task holds."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (a, b), (own, holding) in held.items():
            lang += [a] * len(own)
            source += [b] * len(own)
            term += own
            n += own.values()
            docs += map(holding.__getitem__, own)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2)
        for i in range(batch.num_rows):
            text = texts[i]
            words = text.as_buffer().to_pybytes().translate(TERM_BYTES).split() if text.is_valid else []
            if words:
                own, holding = held.setdefault((lang[i], source[i]), (Counter(), Counter()))
                own.update(words)
                holding.update(set(words))
            if i % 64 == 63 and sum(len(own) for own, _ in held.values()) > HELD:
                yield told()
        if sum(len(own) for own, _ in held.values()) > HELD:
            yield told()
    if held:
        yield told()
    tidy()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: how often a group holds a term, and how many of its documents do."""
    parts = _documents(docs).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept(counted: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, n_lang`` of the terms that at least ``least`` documents of the language hold."""
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")


def probability(n: str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (n + ADDED) / (total + ADDED * terms))`` of columns, exact; null for no terms."""
    return F.expr(f"1 + CAST((CAST(({n}) + {ADDED} AS DECIMAL(20,0)) * CAST({UNIT} AS DECIMAL(10,0))) DIV CAST(nullif(({total}) + {ADDED} * ({terms}), 0) AS DECIMAL(20,0)) AS BIGINT)")


def groups_of(docs: DataFrame, cells: DataFrame, keep: DataFrame) -> DataFrame:
    """A row a group: ``lang, source, k`` (its number in the language, by name), ``total, terms, lang_total`` and ``zero``, the probability at a count of 0 (0 for no terms)."""
    each = _documents(docs).select("lang", "source").distinct().withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = keep.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("lang_total"))
    told = each.join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "terms", "lang_total")})
    return told.withColumn("zero", F.coalesce(probability("CAST(0 AS BIGINT)", "total", "terms"), F.lit(0).cast("long")))


# ---- pairs


def _unique(pair: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, a, b) with their summed ``m``."""
    counts, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    width = len(counts)
    if not width or int(pair.max()) * width * width < 1 << 62:
        key, first, of = np.unique((pair * width + code[: len(a)]) * width + code[len(a) :], return_index=True, return_inverse=True)
    else:
        _, first, of = np.unique(np.stack([pair, a, b], axis=1), axis=0, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, of.ravel(), m)
    return pair[first], a[first], b[first], total


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms' rows of counts (``lang, lo, hi, held``: numbers and counts of groups of two blocks) to ``lang, a, b, na, nb, m``, a < b."""
    known: dict[tuple[str, int, int], int] = {}
    parts: list[tuple[np.ndarray, ...]] = []
    size = 0

    def told() -> pa.RecordBatch:
        blocks = list(known)
        pair, na, nb, m = _unique(*(np.concatenate(x) for x in zip(*parts)))
        of, local = pair // (BLOCK * BLOCK), pair % (BLOCK * BLOCK)
        lo, hi = (np.array([x[i] for x in blocks], np.int64)[of] for i in (1, 2))
        parts.clear()
        lang = pa.array([x[0] for x in blocks], pa.string()).take(pa.array(of))
        return pa.RecordBatch.from_arrays([lang, *(pa.array(x) for x in (lo * BLOCK + local // BLOCK, hi * BLOCK + local % BLOCK, na, nb, m))], names=["lang", "a", "b", "na", "nb", "m"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            block = np.array([known.setdefault(x, len(known)) for x in zip(part.column("lang").to_pylist(), part.column("lo").to_pylist(), part.column("hi").to_pylist())], np.int64)
            lo, hi = (part.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            held = part.column("held")
            row = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
            k, n = (held.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            order = np.lexsort((k, row))
            k, n = k[order], n[order]
            after = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1
            i = np.repeat(np.arange(len(row)), after)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
            met = (k[i] // BLOCK == lo[row[i]]) & (k[j] // BLOCK == hi[row[i]])
            i, j = i[met], j[met]
            parts.append((block[row[i]] * (BLOCK * BLOCK) + k[i] % BLOCK * BLOCK + k[j] % BLOCK, n[i], n[j], np.ones(len(i), np.int64)))
            size += len(i)
            if size > TALLIED:
                parts[:] = [_unique(*(np.concatenate(x) for x in zip(*parts)))]
                size = len(parts[0][0])
                if size > TALLIED // 2:
                    yield told()
                    size = 0
    if size:
        yield told()
    tidy()


def tallies(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """How many terms two groups a < b of a language (by number) count ``na`` and ``nb`` times, both over 0: ``lang, a, b, na, nb, m``."""
    blocks = groups.groupBy("lang").agg(F.floor(F.max("k") / BLOCK).cast("int").alias("last")).select(F.col("lang").alias("of"), "last")
    own = F.floor(F.col("k") / BLOCK).cast("int")
    met = cells.join(blocks, F.col("lang") == F.col("of")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = met.groupBy("lang", "term", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi")).agg(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), "n")).alias("held"))
    made = rows.where(F.size("held") > 1).select("lang", "lo", "hi", "held").mapInArrow(_tallied, "lang string, a long, b long, na long, nb long, m long")
    return made.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m"))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's histogram of probabilities and other groups' ``zero``: what its terms add to the distance where the other counts 0, beyond zeros of both."""
    for batch in batches:
        out: list[tuple[str, int, int, int, int]] = []
        for lang, k, zero, terms, p, m, other, zeros in zip(*(batch.column(c).to_pylist() for c in range(8))):
            p, m, z = (np.array(x or [], np.int64) for x in (p, m, zeros))
            both = np.abs(zero - z)
            value = np.zeros(len(z), np.int64)
            for at in range(0, len(p), 4096):
                value += (m[at : at + 4096, None] * (np.abs(p[at : at + 4096, None] - z) - both)).sum(axis=0)
            out += [(lang, k, b, v, terms * w) for b, v, w in zip(other, value.tolist(), both.tolist()) if b != k]
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["lang", "a", "b", "v", "zeros"])


def pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of every two groups (numbers) of a language, both ways."""
    # entries of a histogram: distinct counts, at most the root of twice a group's count
    counted = cells.groupBy("lang", "k", "n", "total", "terms").agg(F.count(F.lit(1)).alias("m")).withColumn("p", probability("n", "total", "terms"))
    own = counted.groupBy("lang", "k").agg(F.collect_list(F.struct("p", "m")).alias("own"))
    one = groups.select("lang", "k", "zero", "terms")
    others = groups.groupBy("lang", F.floor(F.col("k") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("k").cast("long").alias("k"), "zero"))).alias("others")).drop("block")
    met = one.join(own, ["lang", "k"], "left").join(others, "lang")
    alone = met.select("lang", F.col("k").cast("long"), "zero", "terms", F.col("own.p").alias("p"), F.col("own.m").alias("m"), F.col("others.k").alias("other"), F.col("others.zero").alias("zeros")).mapInArrow(_alone, "lang string, a long, b long, v long, zeros long")

    def info(side: str) -> DataFrame:
        return groups.select("lang", F.col("k").cast("long").alias(side), F.col("total").alias(f"total_{side}"), F.col("zero").alias(f"zero_{side}"), *([F.col("terms")] if side == "a" else []))

    both = tallies(cells, groups).join(info("a"), ["lang", "a"]).join(info("b"), ["lang", "b"])
    both = both.withColumns({"pa": probability("na", "total_a", "terms"), "pb": probability("nb", "total_b", "terms")})
    met = F.col("m") * (F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zero_b")) - F.abs(F.col("zero_a") - F.col("pb")) + F.abs(F.col("zero_a") - F.col("zero_b")))
    joint = both.groupBy("lang", "a", "b").agg(F.sum(met).alias("v"))
    swapped = [F.col("lang"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("v")]
    parts = [alone.select("lang", "a", "b", (F.col("v") + F.col("zeros")).alias("v")), alone.select(*swapped), joint.select("lang", "a", "b", "v"), joint.select(*swapped)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


# ---- report


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for documents (``lang, source, text``).

    Part ``pair``: the distance to each other source of the language, all of them. Part
    ``term``: the ``top`` terms that the group holds and that are likelier in it than in
    the language. Ranks count from 1 by falling value, then by the item's bytes.
    """
    with scratch(docs.sparkSession):
        counted = cut(counts(docs), "divergence-counts")
        keep = cut(kept(counted, least), "divergence-kept")
        held = cut(counted.drop("docs").join(keep, ["lang", "term"]), "divergence-held")
        groups = cut(groups_of(docs, held, keep), "divergence-groups", keep=True)
        cells = cut(held.join(groups, ["lang", "source"]), "divergence-cells", keep=True)
        paired = cut(pairs(cells, groups), "divergence-pairs", keep=True)
    names = groups.select("lang", F.col("k").cast("long").alias("k"), "source")
    pair = paired.join(names.withColumnRenamed("k", "a"), ["lang", "a"]).join(names.select("lang", F.col("k").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    likelier = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (probability("n", "total", "terms") - probability("n_lang", "lang_total", "terms")).alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pair, likelier)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


#: The report in SQL, over all kept terms of every pair.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
keep AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM keep GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN keep USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN keep k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) r
WHERE part = 'pair' OR rank <= 50
"""
