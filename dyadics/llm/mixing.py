"""Mixing documents to target weights of soft domains, in DataFrame functions alone.

Domains are the classes of the labelled table: clean, poor and toxic. A naive Bayes classifier over binned text
statistics gives each document a posterior over domains. Nonnegative document rates are fitted so that the expected
domain token totals sum(rate * tokens * posterior) match targets: projected gradient descent on the least squares, in
the metric that weighs a document by its tokens. In that metric a document's rate depends on its posterior alone, so
documents with equal bins share a rate and one pass over the corpus sums their tokens; the iterations fold over that
table, one row of arrays whose length is bounded by the number of bin combinations, until they have converged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

DOMAINS = ("clean", "poor", "toxic")
#: Shares of the mixed tokens by domain, and the mixed clean tokens as a multiple of the clean tokens there are.
WEIGHTS = {"clean": 0.94, "poor": 0.05, "toxic": 0.01}
CLEAN_SCALE = 1.25
#: The bounded sample that the classifier is fitted on: labelled rows, the first by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: Words that tell the domains apart: at most so many of each domain, of so many sampled texts at least.
CUES, CUE_TEXTS = 60, 5
#: Weight of the rates' squared distance from 1 beside the squared distance of the totals from their targets: of the rates
#: that match, those nearest to 1; and a target out of reach cannot cost the corpus.
RIDGE = 1e-3
#: The fit has converged where a gradient step moves no rate by more than STILL. ITERATIONS bounds the fold; the result says
#: if it was reached.
STILL, ITERATIONS = 1e-7, 5_000
SEED = 2
#: Upper ends of each statistic's bins (the last bin is open).
BINS = {
    "symbols": (0.02, 0.2, 0.6),
    "lines": (0.0, 0.1, 0.3),
    "variety": (0.5, 0.7, 0.8),
    "upper": (0.08, 0.2, 0.5),
    "poor_cues": (0.0, 1.0),
    "toxic_cues": (0.0, 1.0, 3.0),
}


def _bin(value: Column, ends: tuple[float, ...]) -> Column:
    return reduce(lambda out, i: out.when(value <= ends[i], i), range(1, len(ends)), F.when(value <= ends[0], 0)).otherwise(len(ends))


def _split(text: Column) -> Column:
    for space in "\n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with tokens, the distinct words and the plain statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"_words": _split(text), "_lines": F.array_remove(F.split(text, "\n"), "")})
    out = out.withColumns({"_distinct": F.array_distinct("_words"), "tokens": F.size("_words").cast("long")})
    n = F.greatest(F.col("tokens"), F.lit(1))
    chars = F.greatest(F.char_length(text), F.lit(1))
    lines = F.greatest(F.size("_lines"), F.lit(1))
    return out.withColumns(
        {
            "_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")) / n,
            "_same_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))) / lines,
            # Herdan's measure: unlike the plain ratio it hardly falls with the length of a text
            "_variety": F.when(n > 1, F.log(F.size("_distinct").cast("double")) / F.log(n.cast("double"))).otherwise(1.0),
            "_upper": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) / chars,
        }
    ).drop("_words", "_lines")


def binned(rows: DataFrame, cues: dict[str, list[str]]) -> DataFrame:
    """The bins of each row's statistics; cues count as the distinct ones that the text has."""

    def found(name: str) -> Column:
        words = cues.get(name) or []
        return F.size(F.array_intersect("_distinct", F.array(*map(F.lit, words)))) if words else F.lit(0)

    values = {
        "symbols": F.col("_symbols"),
        "lines": F.col("_same_lines"),
        "variety": F.col("_variety"),
        "upper": F.col("_upper"),
        "poor_cues": found("poor"),
        "toxic_cues": found("toxic"),
    }
    return rows.withColumns({k: _bin(v, BINS[k]) for k, v in values.items()}).drop("_distinct", "_symbols", "_same_lines", "_variety", "_upper")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, domain of the sampled labelled rows. Of several labels of a doc_id the worst counts."""
    worst = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = worst.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE_ROWS)
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("clean")
    return docs.select("doc_id", "text").join(F.broadcast(marks.select("doc_id", domain.alias("domain"))), "doc_id")


def cue_words(sample: DataFrame) -> dict[str, list[str]]:
    """For the poor and the toxic domain, the words most often in their texts relative to others: CUES at most."""
    texts = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    seen = sample.select("domain", F.explode("_distinct").alias("word")).groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS))
    out = {}
    for name in ("poor", "toxic"):
        own = F.col(name) / max(texts.get(name, 0), 1)
        others = reduce(lambda a, b: a + b, (F.col(d) for d in DOMAINS if d != name)) / max(sum(n for d, n in texts.items() if d != name), 1)
        ratio = own / (others + 1e-4)
        best = seen.where((F.col(name) >= CUE_TEXTS) & (ratio > 10)).orderBy(ratio.desc(), "word").limit(CUES)
        out[name] = [r["word"] for r in best.select("word").collect()]
    return out


def posteriors(bins: DataFrame, counts: dict[tuple[str, str, int], int], texts: dict[str, int]) -> DataFrame:
    """``bins`` with ``posterior``, an array by domain: naive Bayes with a half count added to each bin."""
    total = sum(texts.values())

    def log_odds(domain: str) -> Column:
        n = texts.get(domain, 0)
        terms = [F.log(F.lit((n + 1) / (total + len(DOMAINS))))]
        for name, ends in BINS.items():
            table = [(counts.get((domain, name, b), 0) + 0.5) / (n + 0.5 * (len(ends) + 1)) for b in range(len(ends) + 1)]
            terms.append(F.log(F.element_at(F.array(*map(F.lit, table)), F.col(name) + 1)))
        return reduce(lambda a, b: a + b, terms)

    raw = bins.withColumn("_z", F.array(*map(log_odds, DOMAINS)))
    raw = raw.withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    whole = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return raw.withColumn("_s", whole).withColumn("posterior", F.transform("_e", lambda e: e / F.col("_s"))).drop("_z", "_e", "_s")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _totals(groups: Column, rates: Column) -> Column:
    """The sums by domain of rate * share * posterior."""
    parts = F.zip_with(groups, rates, lambda g, r: F.transform(g["posterior"], lambda p: p * g["share"] * r))
    return F.aggregate(parts, F.array(*(F.lit(0.0) for _ in DOMAINS)), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))


def fit_rates(groups: DataFrame, weights: dict[str, float], clean_scale: float) -> DataFrame:
    """``groups`` (posterior, tokens and others) with rate, missed and converged.

    Projected gradient steps with momentum, which starts anew where it leads uphill, all in one plan. ``missed`` is the largest
    difference of a domain's total from its target, as a share of all mixed tokens. All equations count alike: a domain that
    the corpus hardly has is missed by little in tokens, and must not pull the others off their targets.
    """
    k = len(DOMAINS)
    names = [c for c in groups.columns if c != "tokens"]
    whole = groups.agg(F.greatest(F.sum("tokens"), F.lit(1)).alias("all"), F.collect_list(F.struct(*names, "tokens")).alias("each"))  # bounded: a row for each combination of bins
    # shares of the corpus, so that no total overflows or loses digits
    whole = whole.select(F.transform("each", lambda g: F.struct(*(g[c].alias(c) for c in names), (g["tokens"] / F.col("all")).alias("share"))).alias("groups"))
    whole = whole.withColumn("have", _totals(F.col("groups"), F.transform("groups", lambda g: F.lit(1.0))))
    # the trace of the Gram matrix bounds its greatest eigenvalue
    gram = F.aggregate("groups", F.lit(0.0), lambda a, g: a + g["share"] * F.aggregate(g["posterior"], F.lit(0.0), lambda b, p: b + p * p))
    clean = F.when(F.col("have")[0] > 0, F.col("have")[0]).otherwise(1.0)
    whole = whole.select("groups", (gram + RIDGE).alias("bound"), (clean * (clean_scale / weights[DOMAINS[0]])).alias("budget"))
    problem = stored(whole.withColumn("target", F.array(*(F.col("budget") * weights[d] for d in DOMAINS))), "mix-problem")
    table, bound = F.col("groups"), F.col("bound")

    def off(rates: Column) -> Column:
        return F.zip_with(F.col("target"), _totals(table, rates), lambda t, x: t - x)

    def largest(values: Column) -> Column:
        return F.array_max(F.transform(values, F.abs))

    def less(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x - y)

    def moved(state: Column, miss: Column) -> Column:
        def step(group: Column, rate: Column) -> Column:
            pull = reduce(lambda a, b: a + b, (miss[d] * group["posterior"][d] for d in range(k)))
            return F.greatest(F.lit(0.0), rate + (pull - RIDGE * (rate - 1)) / bound)

        return _let(F.zip_with(table, state["ahead"], step), lambda new: _let(less(state["ahead"], new), lambda back: settled(state, new, back)))

    def settled(state: Column, new: Column, back: Column) -> Column:
        uphill = F.zip_with(table, F.zip_with(back, less(new, state["rate"]), lambda x, y: x * y), lambda g, x: g["share"] * x)
        n = F.when(F.aggregate(uphill, F.lit(0.0), lambda a, x: a + x) > 0, F.lit(0)).otherwise(state["n"] + 1)
        ahead = _let(n, lambda m: F.zip_with(new, state["rate"], lambda x, y: F.greatest(F.lit(0.0), x + (x - y) * m / (m + 3))))
        return F.struct(new.alias("rate"), ahead.alias("ahead"), n.alias("n"), (largest(back) < STILL).alias("done"))

    ones = F.transform(table, lambda g: F.lit(1.0))
    start = F.struct(ones.alias("rate"), ones.alias("ahead"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, lambda state, _: F.when(state["done"], state).otherwise(_let(off(state["ahead"]), lambda miss: moved(state, miss))))
    fitted = stored(problem.withColumn("end", fold), "mix-fit")
    out = fitted.select(F.arrays_zip("groups", F.col("end.rate").alias("rate")).alias("each"), (largest(off(F.col("end.rate"))) / F.col("budget")).alias("missed"), F.col("end.done").alias("converged"))
    each = out.select(F.explode("each").alias("g"), "missed", "converged")
    return each.select(*(F.col("g.groups")[c].alias(c) for c in names), F.col("g.rate").alias("rate"), "missed", "converged")


def _planned(docs: DataFrame, labels: DataFrame, weights: dict[str, float], clean_scale: float, training: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Of each row all columns but the text, with tokens, bins and a hash; the rates by bins; the cue words."""
    sample = stored(measured(labelled(training, labels)).drop("text"), "mix-sample")
    cues = cue_words(sample)
    train = stored(binned(sample, cues), "mix-bins")
    texts = {r["domain"]: r["count"] for r in train.groupBy("domain").count().collect()}
    spread = train.select("domain", F.explode(F.create_map(*(x for n in BINS for x in (F.lit(n), F.col(n))))).alias("name", "bin"))
    counts = {(r["domain"], r["name"], r["bin"]): r["count"] for r in spread.groupBy("domain", "name", "bin").count().collect()}
    rows = binned(measured(docs), cues).withColumn("_row", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    narrow = stored(rows.drop("text"), "mix-rows")
    groups = stored(posteriors(narrow.groupBy(*BINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), counts, texts), "mix-groups")
    rates = fit_rates(groups, weights, clean_scale)
    return narrow, rates.select(*BINS, "posterior", "rate", "missed", "converged"), cues


def _copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    # the bins' combinations are bounded (4 * 4 * 4 * 4 * 3 * 4 here), so their table is small on any corpus
    chance = F.pmod(F.col("_row"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(rates), list(BINS)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int")).drop("_row", *BINS)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, clean_scale: float = CLEAN_SCALE, training: DataFrame | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, with tokens, posterior (array by domain), rate, missed, converged and copies.

    ``copies`` is the rate rounded up or down by a hash of doc_id and text, so that its expectation is the rate. A
    null text has no tokens; it has a posterior and a rate like others. Repeated rows have equal rates and copies.
    With no labels, posteriors are equal for all. ``missed`` and ``converged`` tell how near the fit came to the targets. Columns that clash with the added ones are replaced. ``training`` has the
    texts of the labels where ``docs`` lacks some of them.
    """
    own = docs.drop("tokens", "posterior", "rate", "copies", "missed", "converged", *BINS)
    narrow, rates, _ = _planned(own, labels, weights or WEIGHTS, clean_scale, docs if training is None else training)
    return _copies(narrow, rates)


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, clean_scale: float = CLEAN_SCALE, training: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with its columns alone, each as often as its copies say. Texts are read twice, never exchanged."""
    names = docs.columns
    own = docs.select("doc_id", "text", F.struct(*(F.col(c) for c in names if c not in ("doc_id", "text"))).alias("_others")) if len(names) > 2 else docs.select("doc_id", "text")
    _, rates, cues = _planned(own, labels, weights or WEIGHTS, clean_scale, docs if training is None else training)
    rows = binned(measured(own), cues).withColumn("_row", F.xxhash64(F.lit(SEED), "doc_id", "text"))
    chosen = _copies(rows, rates).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return chosen.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in names))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed.select("doc_id", "source", "tokens", *(F.col("posterior")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)), "rate", "copies", "missed", "converged")
