"""Queries on candidate sets and bootstraps: the whole suite, and any metric over draws of recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as cs
from ..operators import metrics, relabel, resample, sampling
from ..operators.lineage import settled
from ..session import table
from .base import SCORED, Book, r6, scored

book = Book()
WITH = f"WITH {SCORED}"
FOLDS, REPLICATES = 5, 100


def candidates(spark, d):
    """Orders as items of a customer, their lines but the first as candidates: ``rec, item, label, y, ind, con``."""
    lines = table(spark, d, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("label"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("ind"), ((F.round(F.col("l_discount") * 100) + F.col("l_partkey") % 97) / 110).alias("con"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("rec"), F.col("o_orderkey").alias("item"))
    return lines.join(orders, "item").groupBy("rec", "item", "label").agg(*[F.max(c).alias(c) for c in ("y", "ind", "con")])


CANDIDATES = "cand AS (SELECT o_custkey AS rec, o_orderkey AS item, l_linenumber AS label, max(CAST(l_returnflag = 'R' AS INT)) AS y, max(l_quantity / 50.0) AS ind, max((round(l_discount * 100) + l_partkey % 97) / 110.0) AS con FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1 GROUP BY 1, 2, 3)"


def items_sql(score, tau, source):
    """An item's sums, in SQL: ``source`` has the candidates and what ``tau`` names."""
    return f"""SELECT rec, item, tp, fp, fn, 1 AS items, CAST(tp + fn > 0 AS INT) AS compound, CAST(tp + fn = 0 AS INT) AS atomic, CAST(fp = 0 AND fn = 0 AS INT) AS exact, CAST(fp = 0 AND fn = 0 AND tp > 0 AS INT) AS compound_exact, CAST(tp + fn = 0 AND fp = 0 AS INT) AS empty, CASE WHEN tp + fn = 0 THEN fp ELSE 0 END AS atomic_fp, abs(fp - fn) AS card,
      CAST(coalesce(best <= 1, false) AS INT) AS recalled_1, CAST(coalesce(best <= 2, false) AS INT) AS recalled_2, CAST(coalesce(best <= 3, false) AS INT) AS recalled_3
      FROM (SELECT rec, item, count(*) FILTER (WHERE y = 1 AND {score} > {tau}) AS tp, count(*) FILTER (WHERE y = 0 AND {score} > {tau}) AS fp, count(*) FILTER (WHERE y = 1 AND NOT {score} > {tau}) AS fn, min(k) FILTER (WHERE y = 1) AS best
        FROM (SELECT *, row_number() OVER (PARTITION BY rec, item ORDER BY {score} DESC, label) AS k FROM {source}) q GROUP BY rec, item) z"""


RATIOS = {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"), "empty_accuracy": ("empty", "atomic"), "fp_per_atomic": ("atomic_fp", "atomic"), "exact": ("exact", "items"), "compound_exact": ("compound_exact", "compound"), "cardinality_mae": ("card", "items"), "recall_at_1": ("recalled_1", "compound"), "recall_at_2": ("recalled_2", "compound"), "recall_at_3": ("recalled_3", "compound")}


def ratio_sql(name):
    a, b = RATIOS[name]
    empty = "0" if name in ("precision", "recall", "f1") else "NULL"
    return f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE {empty} END"


TOTALS = ", ".join(f"sum({c}) AS {c}" for c in cs.SUMS)


def curve_sql(name, source, by="", weight="1"):
    """AUROC and PR-AUC of weighted rows (``source`` has ``b``, the score and y) in SQL."""
    return f"""{name}_c AS (SELECT b, s, CAST(sum(m * y) AS DOUBLE) AS p, CAST(sum(m * (1 - y)) AS DOUBLE) AS q FROM {source} GROUP BY b, s HAVING sum(m) > 0),
    {name}_k AS (SELECT *, sum(p) OVER w - p AS tp, sum(q) OVER w - q AS fp, sum(p) OVER (PARTITION BY b) AS ap, sum(q) OVER (PARTITION BY b) AS aq FROM {name}_c WINDOW w AS (PARTITION BY b ORDER BY s DESC)),
    {name} AS (SELECT b, sum(q * (tp + p / 2)) / (max(ap) * max(aq)) AS auroc, sum(p / ap * ((tp + p) / (tp + p + fp + q) + CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END) / 2) AS pr_auc FROM {name}_k GROUP BY b)"""


#: The best threshold of rows by group ``g``: cuts are "score > observed score".
def tau_sql(name, source, score):
    return f"""{name}_c AS (SELECT g, {score} AS s, count(*) AS n, sum(y) AS p FROM {source} GROUP BY 1, 2), {name}_k AS (SELECT g, s, sum(n) OVER w - n AS n, sum(p) OVER w - p AS tp, sum(p) OVER (PARTITION BY g) AS ap FROM {name}_c WINDOW w AS (PARTITION BY g ORDER BY s DESC)),
    {name} AS (SELECT g, arg_max(s, {{'f': round(CASE WHEN n + ap > 0 THEN 2 * tp / CAST(n + ap AS DOUBLE) ELSE 0 END, 9), 't': -s}}) AS tau FROM {name}_k GROUP BY g)"""


@book.add("a31_candidate_suite", f"WITH {CANDIDATES}, e AS (SELECT f AS g, ind, y FROM cand, (SELECT unnest(generate_series(0, {FOLDS - 1})) AS f) q WHERE rec % {FOLDS} <> f), {tau_sql('t', 'e', 'ind')}, x AS (SELECT cand.*, tau FROM cand JOIN t ON rec % {FOLDS} = g), i AS ({items_sql('ind', 'tau', 'x')}), n AS (SELECT {TOTALS} FROM i), one AS (SELECT 0 AS b, ind AS s, y, 1 AS m FROM cand), {curve_sql('v', 'one')} SELECT CAST(items AS BIGINT) AS items, round(auroc, 6) AS auroc, round(pr_auc, 6) AS pr_auc, {', '.join(f'round({ratio_sql(c)}, 6) AS {c}' for c in RATIOS)} FROM n, v")
def a31(spark, d):
    """The whole report, each item decided by the threshold of the other folds."""
    rows = candidates(spark, d).withColumn("fold", (F.col("rec") % FOLDS).cast("int"))
    out = cs.report(rows, ["rec", "item"], "fold", "ind", "y", "label", FOLDS)
    return out.select("items", r6("auroc").alias("auroc"), r6("pr_auc").alias("pr_auc"), *[r6(c).alias(c) for c in RATIOS])


#: The number that slot j of replicate b draws, as ``resample.slot``.
def scatter(b, j):
    return f"((({j}) % 1000003) * ((({b}) * 7919 + 104729) % 1000003) + (({j}) % 10007) * (({j}) % 10007) * (({b}) + 17)) % 1000003"


def drawn_sql(names, key, replicates, name="rep"):
    """``b, key, m``: how often replicate b draws each of ``names``."""
    return f"{name}_g AS (SELECT {key}, row_number() OVER (ORDER BY {key} NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {names}) q), {name}_s AS (SELECT b, (({scatter('b', 'k')}) * 1000003 + ({scatter('b + 101', 'k + 7')})) % n AS k FROM {name}_g, (SELECT unnest(generate_series(0, {replicates - 1})) AS b) q), {name} AS (SELECT b, {key}, count(*) AS m FROM {name}_s JOIN {name}_g USING (k) GROUP BY b, {key})"


SHOWN = ("auroc", "pr_auc", *RATIOS)


@book.add(
    "b05_paired_suite",
    f"WITH {CANDIDATES}, e AS (SELECT 0 AS g, * FROM cand), {tau_sql('ta', 'e', 'ind')}, {tau_sql('tc', 'e', 'con')}, xa AS (SELECT cand.*, tau FROM cand, ta), xc AS (SELECT cand.*, tau FROM cand, tc), {drawn_sql('cand', 'rec', REPLICATES)}, "
    + ", ".join(f"i{k} AS ({items_sql(c, 'tau', f'x{k}')}), n{k} AS (SELECT b, {', '.join(f'sum(m * {s}) AS {s}' for s in cs.SUMS)} FROM i{k} JOIN rep USING (rec) GROUP BY b), r{k} AS (SELECT b, {', '.join(f'{ratio_sql(s)} AS {s}' for s in RATIOS)} FROM n{k}), w{k} AS (SELECT b, {c} AS s, y, m FROM cand JOIN rep USING (rec)), {curve_sql(f'v{k}', f'w{k}')}" for k, c in (("a", "ind"), ("c", "con")))
    + f" SELECT ra.b, {', '.join(f'round(vc.{c} - va.{c}, 6) AS {c}' for c in SHOWN[:2])}, {', '.join(f'round(rc.{c} - ra.{c}, 6) AS {c}' for c in RATIOS)} FROM ra JOIN rc USING (b) JOIN va USING (b) JOIN vc USING (b)",
)
def b05(spark, d):
    """The change of every metric of the suite from one score to another on the same draws; thresholds are fixed beforehand."""
    rows = settled(candidates(spark, d))
    out, times = None, settled(resample.draws(rows, "rec", REPLICATES))
    for c in ("ind", "con"):
        tau = metrics.best_f1(rows, [], c, "y").select("tau")  # one row
        items = cs.by_item(rows.join(F.broadcast(tau)), ["rec", "item"], c, "y", "label", F.col("tau"))
        suite = resample.bootstrap(items, "rec", {s: F.col(s) for s in cs.SUMS}, cs.suite(), REPLICATES, times)
        both = suite.join(resample.bootstrap_curves(rows, "rec", c, "y", REPLICATES, times), "b").where("b >= 0").select("b", *[F.col(s).alias(f"{c}_{s}") for s in SHOWN])
        out = both if out is None else out.join(both, "b")
    return out.select("b", *[r6(F.col(f"con_{s}") - F.col(f"ind_{s}")).alias(s) for s in SHOWN])


BOOT = f"{WITH}, {drawn_sql('scored', 'source', 200)}, g AS (SELECT source, sum(y) AS k, count(*) AS n FROM scored GROUP BY source), bs AS (SELECT b, sum(m * k) / CAST(sum(m * n) AS DOUBLE) AS ratio FROM rep JOIN g ON rep.source IS NOT DISTINCT FROM g.source GROUP BY b)"


@book.add("b01_b02_bootstrap_ratio", f"{BOOT} SELECT b, round(ratio, 6) AS ratio FROM bs")
def b02(spark, d):
    return resample.bootstrap_ratio(scored(spark, d), "source", F.col("y"), F.lit(1), 200).select("b", r6("ratio").alias("ratio"))


@book.add("b02_bootstrap_interval", f"{BOOT}, l AS (SELECT list_sort(list(ratio)) AS v FROM bs) SELECT round(v[6], 6) AS low, round(v[196], 6) AS high FROM l")
def b02_interval(spark, d):
    return resample.interval(resample.bootstrap_ratio(scored(spark, d), "source", F.col("y"), F.lit(1), 200), "ratio", 200).select(r6("low").alias("low"), r6("high").alias("high"))


@book.add("b01_any_metric", f"{WITH}, {drawn_sql('scored', 'source', REPLICATES)}, g AS (SELECT source, count(*) FILTER (WHERE s >= 0.6 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 0.6) AS kept, count(*) AS n, sum(s) AS s, sum(s * s) AS ss FROM scored GROUP BY source), t AS (SELECT b, sum(m * tp) AS tp, sum(m * kept) AS kept, sum(m * n) AS n, sum(m * s) AS s, sum(m * ss) AS ss FROM rep JOIN g ON rep.source IS NOT DISTINCT FROM g.source GROUP BY b) SELECT b, round(CASE WHEN kept > 0 THEN tp / CAST(kept AS DOUBLE) END, 6) AS precision, round(kept / CAST(n AS DOUBLE), 6) AS coverage, round(sqrt(ss / n - (s / n) * (s / n)), 6) AS spread FROM t")
def b01_any(spark, d):
    """Metrics of the caller's own over sums: precision and coverage of a cut, and the spread of the scores."""
    kept = F.col("s") >= 0.6
    sums = {"tp": (kept & (F.col("y") == 1)).cast("long"), "kept": kept.cast("long"), "n": F.lit(1).cast("long"), "sx": F.col("s"), "sxx": F.col("s") * F.col("s")}
    mean = F.col("sx") / F.col("n")
    own = {"precision": F.col("tp") / F.when(F.col("kept") > 0, F.col("kept")), "coverage": F.col("kept") / F.col("n"), "spread": F.sqrt(F.col("sxx") / F.col("n") - mean * mean)}
    return resample.bootstrap(scored(spark, d), "source", sums, own, REPLICATES).where("b >= 0").select("b", *[r6(c).alias(c) for c in own])


@book.add("b03_paired_auroc_delta", f"{WITH}, {drawn_sql('scored', 'source', REPLICATES)}, wa AS (SELECT b, s, y, m FROM scored JOIN rep ON rep.source IS NOT DISTINCT FROM scored.source), wc AS (SELECT b, s2 AS s, y, m FROM scored JOIN rep ON rep.source IS NOT DISTINCT FROM scored.source), {curve_sql('va', 'wa')}, {curve_sql('vc', 'wc')} SELECT b, round(vc.auroc - va.auroc, 6) AS delta FROM va JOIN vc USING (b)")
def b03(spark, d):
    r = resample.bootstrap_auroc(scored(spark, d), "source", ["s", "s2"], "y", REPLICATES)
    return r.select("b", r6(F.col("auroc_s2") - F.col("auroc_s")).alias("delta"))


@book.add("b04_two_sample", f"{WITH}, en AS (SELECT * FROM scored WHERE lang = 'en'), xx AS (SELECT * FROM scored WHERE lang <> 'en'), {drawn_sql('en', 'source', REPLICATES, 're')}, {drawn_sql('xx', 'source', REPLICATES, 'rx')}, a AS (SELECT b, sum(m * y) / CAST(sum(m) AS DOUBLE) AS v FROM en JOIN re ON re.source IS NOT DISTINCT FROM en.source GROUP BY b), c AS (SELECT b, sum(m * y) / CAST(sum(m) AS DOUBLE) AS v FROM xx JOIN rx ON rx.source IS NOT DISTINCT FROM xx.source GROUP BY b) SELECT b, round(a.v - c.v, 6) AS difference FROM a JOIN c USING (b)")
def b04(spark, d):
    rows = scored(spark, d)
    a = resample.bootstrap_ratio(rows.where("lang = 'en'"), "source", F.col("y"), F.lit(1), REPLICATES).withColumnRenamed("ratio", "a")
    b = resample.bootstrap_ratio(rows.where("lang <> 'en'"), "source", F.col("y"), F.lit(1), REPLICATES).withColumnRenamed("ratio", "c")
    return a.join(b, "b").select("b", r6(F.col("a") - F.col("c")).alias("difference"))


@book.add("b15_relabel_impact")
def b15(spark, d):
    """What corrected labels change, refitted with every label set: matched rows, unchanged rows, random flips, and each label set on its own rows."""
    rows = scored(spark, d)
    n = table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("size"))
    # reviewers call toxic documents bad, and left those of one language undecided
    decided = F.when(F.col("lang") != "es", F.when(F.col("z") == 1, 0).otherwise(F.col("y")))
    told = rows.join(sampling.grouped_folds(rows, "source", 5), "source").join(n, "doc_id").withColumn("y2", decided)
    features = ["s", "s2", "size"]
    matched = relabel.verdict(relabel.impact(told, "doc_id", "fold", features, "y", "y2", 5, 40))
    full = [relabel.full_population(told, "doc_id", "fold", features, y, 5).select(F.col("n").alias(f"full_n_{y}"), F.col("auroc").alias(f"full_auroc_{y}")) for y in ("y", "y2")]
    one = matched.join(F.broadcast(full[0])).join(F.broadcast(full[1]))  # a row each
    return one.select(*[c if c.startswith("full_n") or c in ("n", "draws") else F.round(c, 4).alias(c) for c in one.columns])
