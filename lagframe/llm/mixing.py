"""Mixing to target weights: domain posteriors from labelled rows, and document rates whose expected domain totals match.

Only DataFrame and SQL functions touch the rows; the driver sees one small matrix an iteration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import stratified_ids
from .scratch import drop, store

#: Labelled rows of a domain that the classifier learns from, about, chosen by a hash of the id; words that it keeps.
SAMPLE_ROWS, VOCABULARY = 5_000, 2048
#: A word's log-odds are cut to this, so that no word decides alone; smoothing counts.
LIMIT, SMOOTH = 3.0, 0.5
#: Rounds of the fit at most, the relative error at which it ends, and the smallest part of a step that it tries.
ROUNDS, CLOSE, LEAST_STEP = 40, 1e-6, 1 / 64
_SEPARATORS = r"[\x20\x09-\x0D]+"


def _words(text: str = "text") -> Column:
    """Distinct words and one empty string, which every text has."""
    return F.array_distinct(F.concat(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SEPARATORS), F.array(F.lit(""))))


def _n_words() -> Column:
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), _SEPARATORS)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")).cast("long")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_tokens`` (words) and one column ``p0``, ``p1``, ... for the probability of each domain.

    A naive Bayes classifier over distinct words: trained on ``labelled(doc_id, domain)``, keeping the words that tell most.
    About ``SAMPLE_ROWS`` labelled documents of each domain, or all it has, are learned from; the prior counts all of them. Labels without
    a document teach nothing. Without labelled documents all domains are equally likely.
    """
    size = len(domains)
    number = F.lit(None).cast("int")
    for i, d in enumerate(domains):
        number = F.when(F.col("domain") == d, i).otherwise(number)
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("k"))
    picked, marks = stratified_ids(marked.join(own.select("doc_id"), "doc_id", "left_semi"), "k", SAMPLE_ROWS)
    known = {r.k: r.n for r in marks.collect()}  # a row a domain
    sample = own.join(F.broadcast(picked), "doc_id").select("k", F.explode(_words()).alias("word"))  # SAMPLE_ROWS a domain
    counts = sample.groupBy("word").agg(*[F.count_if(F.col("k") == i).alias(f"n{i}") for i in range(size)])
    counts = store(counts)
    totals = counts.where("word = ''").first()
    n = [float(totals[f"n{i}"]) if totals else 0.0 for i in range(size)]
    every = sum(n)
    share = [(F.col(f"n{i}") + SMOOTH) / (n[i] + 2 * SMOOTH) for i in range(size)]
    overall = (sum((F.col(f"n{i}") for i in range(1, size)), F.col("n0")) + SMOOTH) / (every + 2 * SMOOTH)
    odds = [F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.log(s / overall))) for s in share]
    # how much a word tells: occurrences times the divergence of its domains from all of them
    tells = sum((F.col(f"n{i}") * F.log(share[i] / overall) for i in range(1, size)), F.col("n0") * F.log(share[0] / overall))
    words = counts.where("word <> ''").select("word", *[o.alias(f"w{i}") for i, o in enumerate(odds)], tells.alias("tells")).orderBy(F.desc("tells"), "word").limit(VOCABULARY).drop("tells")
    none = docs.sparkSession.range(1).select(F.lit("").alias("word"), *[F.lit(0.0).alias(f"w{i}") for i in range(size)])
    words = store(words.union(none))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), _n_words().alias("n_tokens"), _words().alias("words"))
    rows = rows.select("row", "doc_id", "text_hash", "n_tokens", F.explode("words").alias("word"))
    hit = rows.join(F.broadcast(words), "word")  # at most VOCABULARY + 1 rows
    sums = hit.groupBy("row", "doc_id", "text_hash", "n_tokens").agg(*[F.sum(f"w{i}").alias(f"s{i}") for i in range(size)])
    prior = [float(np.log((known.get(i, 0) + 1) / (sum(known.values()) + size))) for i in range(size)]
    logit = [F.col(f"s{i}") + prior[i] for i in range(size)]
    top = F.greatest(*logit) if size > 1 else logit[0]
    e = [F.exp(x - top) for x in logit]
    total = sum(e[1:], e[0])
    return sums.select("doc_id", "text_hash", "n_tokens", *[(x / total).alias(f"p{i}") for i, x in enumerate(e)])


def fit_rates(table: DataFrame, targets: list[float]) -> DataFrame:
    """Add ``rate`` >= 0 to ``table(n_tokens, p0, p1, ...)`` so that the sums of rate * n_tokens * p match the targets.

    Least squares by projected gradients from rate 1: r <- max(0, r - s * p . c), where c is the gradient (the domains'
    excess) times the inverse of the domains' Gram matrix over the documents with positive rates. A round is one
    aggregation of K + K * K sums. A round that doesn't lower the squared excess is taken back and its step s halved, so
    the excess falls from round to round; the fit ends when it is within ``CLOSE`` of the targets, or when no step down to
    ``LEAST_STEP`` lowers it by a thousandth part. Where the targets can't be met (a domain without mass), the excess is
    then as small as this gets it.
    """
    size = len(targets)
    p = [F.col(f"p{i}") for i in range(size)]
    goal = np.array(targets, float)
    kept = trial = table.withColumn("rate", F.lit(1.0))
    error, step, part, held, moves = np.inf, None, 1.0, None, 0
    for _ in range(ROUNDS):
        live = (F.col("rate") > 0).cast("double") * F.col("n_tokens")
        row = trial.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * x) for x in p], *[F.sum(live * x * y) for x in p for y in p]).first()
        values = np.array([float(v or 0) for v in row])
        excess, gram = values[:size] - goal, values[size:].reshape(size, size)
        now = float(excess @ excess)
        if now < error * 0.999:
            kept, error, part, moves = trial, now, min(1.0, 2 * part), moves + 1
            if np.abs(excess).sum() <= CLOSE * max(float(goal.sum()), 1.0):
                break
            step = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ excess
            if moves % 6 == 0:  # the expression of the rates stays short
                stored = store(kept)
                drop(held)
                kept = held = stored
        else:
            part /= 2
            if part < LEAST_STEP:
                break
        move = sum((x * float(part * step[i]) for i, x in enumerate(p[1:], 1)), p[0] * float(part * step[0]))
        trial = kept.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - move))
    return kept


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0) -> DataFrame:
    """Rates and whole copies of each document for the wanted domain weights.

    ``labelled`` has ``doc_id`` and ``domain``; ``weights`` are the wanted shares of tokens (words) by domain, scaled to sum
    to 1; ``budget`` is the wanted total as a multiple of all tokens. Returns ``doc_id``, ``text_hash`` (xxhash64 of the
    text), ``n_tokens``, ``domain`` (likeliest), ``posterior`` (by sorted domain name), ``rate`` and ``copies``: the rate
    rounded up or down by a hash of the id, with the rate's fraction as chance of up.

    One row per row of ``docs``, repeated ones included. Null and wordless texts have 0 tokens and the prior's posterior;
    null ids are rounded like any other. Domains outside ``weights`` are no labels; extra columns are ignored.
    """
    domains = sorted(weights)
    table = store(posteriors(docs, labelled, domains))
    tokens = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    scale = budget * tokens / (sum(weights.values()) or 1.0)
    fitted = fit_rates(table, [weights[d] * scale for d in domains])
    p = [F.col(f"p{i}") for i in range(len(domains))]
    likeliest = F.lit(domains[-1])
    for i in range(len(domains) - 2, -1, -1):
        likeliest = F.when(p[i] >= F.greatest(*p), domains[i]).otherwise(likeliest)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return fitted.select("doc_id", "text_hash", "n_tokens", (likeliest if len(domains) > 1 else F.lit(domains[0])).alias("domain"), F.array(*p).alias("posterior"), "rate", F.floor(F.col("rate") + chance).cast("long").alias("copies"))


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``domain`` of ``labels(doc_id, quality, toxic)``: toxic, else low or good by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain")).where("domain is not null")


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``domain`` of ``labels(doc_id, quality)``: low or good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain")).where("domain is not null")
