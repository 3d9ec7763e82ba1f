"""Mixing sources to target weights by soft-membership rates.

A classifier fitted on labelled documents gives each text a posterior over the
sources. Rates per text, between 0 and the mix's cap for its label, are fitted by
projected-gradient least squares so that the expected token totals per source,
weighted by posteriors, meet the targets. Texts of equal label and rounded posterior have equal gradients, so one distributed
aggregate over all texts leaves cells, bounded in number, on which the steps run. Rates
are then settled per label, so that the totals by label meet the targets too, and
rounded to whole repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import materialize, small_or_plain
from .tokens import DEFAULT, Chunks

#: Bound of the classifier's sample of labelled documents, of whose whole texts only counts reach the driver; two thirds train it, the others are held out for its temperature.
SAMPLE_DOCS = 1500
#: Posteriors are rounded to at most so many parts, fewer where sources are many, so that a label has at most CELLS different ones.
PARTS, CELLS = 8, 8192
#: Starting points tried when rates become whole repeats.
OFFSETS = 64
STEPS = 24
#: As a mix's total: as many tokens as all texts have.
ALL = math.inf


def parts_for(k: int) -> int:
    """The most parts, PARTS at most and 1 at least, in which posteriors over ``k`` sources take at most CELLS values."""
    return max([n for n in range(2, PARTS + 1) if math.comb(n + k - 1, k - 1) <= CELLS], default=1)


def label(source: str) -> Column:
    """A source's one spelling: trimmed, lower case; blank is null."""
    c = F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def size_class(n: np.ndarray) -> np.ndarray:
    """Half powers of two of a number of tokens, as a feature."""
    return np.minimum(63, np.round(2 * np.log2(np.maximum(n, 1)))).astype(np.int64)


class Classifier:
    """Naive Bayes over token numbers and text size; the tokens' part is flattened by a temperature fitted on held-out documents.

    ``accuracy`` and ``prior_accuracy`` are held-out shares of right guesses, with and without looking at the text.
    """

    def __init__(self, classes: list[str], counts: np.ndarray, docs: np.ndarray, sizes: np.ndarray, smooth: float = 0.02) -> None:
        """Of the training documents the tokens (vocabulary x classes), their number (classes) and their size classes (64 x classes)."""
        self.classes, self.parts = classes, parts_for(len(classes))
        counts, sizes, docs = counts + smooth, sizes + 0.5, docs + 1
        self.prior = np.log(docs / docs.sum())
        self.weights = np.log(counts / counts.sum(axis=0))
        self.weights -= self.weights.mean(axis=1, keepdims=True)
        self.sizes = np.log(sizes / sizes.sum(axis=0))
        self.temperature, self.accuracy, self.prior_accuracy = 1.0, float("nan"), float("nan")

    def temper(self, labels: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        """Fit the temperature on held-out documents: numbers of their labels, tokens, and sums of the weights."""
        losses = {}
        for t in [2.0**i for i in range(13)]:
            p = self.posterior(sums, n, t)
            losses[t] = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()
        self.temperature = min(losses, key=losses.get)
        self.accuracy = float((self.posterior(sums, n).argmax(axis=1) == labels).mean())
        self.prior_accuracy = float((self.prior.argmax() == labels).mean())

    def posterior(self, sums: np.ndarray, n: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = self.prior + self.sizes[size_class(n)] + sums / (temperature or self.temperature)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, doc: str, text: str, source: str, path: str = DEFAULT, sample: int = SAMPLE_DOCS) -> Classifier | None:
    """Fitted on at most ``sample`` labelled documents, those with the smallest hashes of their ids; None without any.

    Token counts are summed where the texts are: what comes to the driver is at most vocabulary x sources counts, and a row a held-out document.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(doc).alias("d"), F.xxhash64(doc).alias("h"), label(source).alias("label"), F.col(text).alias("text")).filter("label is not null and text <> ''")
    ids = [(r["h"], r["d"]) for r in known.select("h", "d").orderBy("h", "d").limit(sample).collect()]
    if not ids:
        return None
    cut = ids[max(1, len(ids) * 2 // 3) - 1][0]
    chosen = known.filter(F.col("h") <= ids[-1][0]).join(F.broadcast(spark.createDataFrame([(i,) for _, i in ids], known.select("d").schema)), "d", "left_semi")
    train, held = chosen.filter(F.col("h") <= cut).select("label", "text"), chosen.filter(F.col("h") > cut).select("label", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = Chunks(path)
        for b in batches:
            rows = []
            for x, t in zip(b["label"], b["text"]):
                ids, n = np.unique(np.array(chunks.encoding.encode_ordinary(t), dtype=np.int64), return_counts=True)
                size = int(size_class(n.sum()))
                rows.append(pd.DataFrame({"label": x, "token": np.concatenate([ids, [-1, -2 - size]]), "n": np.concatenate([n, [1, 1]])}))
            if rows:
                yield pd.concat(rows)

    rows = train.mapInPandas(counted, "label string, token bigint, n bigint").groupBy("label", "token").agg(F.sum("n").alias("n")).toPandas()
    classes = sorted(set(rows["label"]))
    at = rows["label"].map(classes.index).to_numpy(np.int64)
    token, n = rows["token"].to_numpy(), rows["n"].to_numpy(float)
    counts, number, sizes = np.zeros((Chunks(path).vocabulary, len(classes))), np.zeros(len(classes)), np.zeros((64, len(classes)))
    counts[token[token >= 0], at[token >= 0]] = n[token >= 0]
    number[at[token == -1]] = n[token == -1]
    sizes[-2 - token[token < -1], at[token < -1]] = n[token < -1]
    model = Classifier(classes, counts, number, sizes)
    shared = spark.sparkContext.broadcast(model.weights)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks = Chunks(path, shared.value)
        for b in batches:
            got = [chunks.measure(t) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "n": [g[0] for g in got], "sums": [g[1] for g in got]})

    seen = held.filter(F.col("label").isin(classes)).mapInPandas(scored, "label string, n bigint, sums array<double>").toPandas()
    if len(seen):
        model.temper(seen["label"].map(classes.index).to_numpy(np.int64), seen["n"].to_numpy(), np.stack(seen["sums"].to_list()))
    return model


def measured(docs: DataFrame, model: Classifier | None, doc: str, text: str, source: str, path: str = DEFAULT) -> DataFrame:
    """Each distinct text once: (doc, source, tokens, q), its smallest labelled document's id and label, its tokens and rounded posterior.

    Documents of null source or null or empty text are left out. Equal texts are found by their digests before any is tokenised.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, w = shared.value
        chunks = Chunks(path, w)
        for b in batches:
            if not len(b):
                continue
            got = [chunks.measure(t) for t in b["text"]]
            n = np.array([g[0] for g in got], dtype=np.int64)
            p = m.posterior(np.stack([g[1] for g in got]), n)
            q = rounded(p, np.array([int(x[:13], 16) / 16**13 for x in b["same"]]), m.parts)
            yield pd.DataFrame({"doc": b["doc"], "source": b["source"], "same": b["same"], "tokens": n, "q": list(q)})

    rows = docs.select(F.col(doc).alias("doc"), label(source).alias("source"), F.md5(F.col(text).cast("binary")).alias("same"), F.col(text).alias("text")).filter("source is not null and text <> ''")
    one = rows.groupBy("same").agg(F.min(F.struct("doc", "source")).alias("x")).select("same", F.col("x.doc").alias("doc"), F.col("x.source").alias("source"))
    # the join also spreads the texts over all cores; of a document that comes several times one row is kept, once its text is gone
    texts = one.join(rows.select("doc", "same", "source", "text"), ["doc", "same", "source"])
    return texts.select("doc", "source", "same", "text").mapInPandas(run, "doc bigint, source string, same string, tokens bigint, q array<bigint>").dropDuplicates(["same"]).drop("same").filter("tokens > 0")


def rounded(p: np.ndarray, u: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Posteriors in whole parts that sum to ``parts``; with ``u`` evenly spread over texts each source's mean stays what it was."""
    upto = np.floor(np.cumsum(p, axis=1) / p.sum(axis=1, keepdims=True) * parts + u[:, None] + 1e-9)
    upto[:, -1] = parts
    return np.diff(np.minimum(upto, parts), axis=1, prepend=0).astype(np.int64)


def targets(mixes: DataFrame) -> DataFrame:
    """(mix, source, share, cap); a source named twice in a mix has the sum of shares and the greatest cap; null and negative ones count 0."""
    return mixes.filter(F.col("mix").isNotNull()).select("mix", label("source").alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("mix", "source").agg(
        F.greatest(F.coalesce(F.sum("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("bigint").alias("cap"))


def plan(mixes: list[tuple[str, str, float, int]], mass: dict[str, int], total: float | None = None) -> dict[str, tuple[float, dict[str, tuple[float, int]]]]:
    """Per mix its total of tokens and its sources' (wanted tokens, cap).

    Without ``total`` it is the largest for which every source that has texts can be filled within its cap.
    """
    by: dict[str, dict[str, tuple[float, int]]] = {}
    for m, s, share, cap in mixes:
        by.setdefault(m, {})[s] = (share, cap)
    out = {}
    for m, sources in by.items():
        can = [mass[s] * c / x for s, (x, c) in sources.items() if x > 0 and mass.get(s, 0) * c > 0]
        t = total if total is not None else min(can, default=0.0)
        out[m] = (t, {s: (x * t, c) for s, (x, c) in sources.items()})
    return out


def fitted(q: np.ndarray, cap: np.ndarray, tokens: np.ndarray, want: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Rates of a mix's cells by projected-gradient least squares.

    ``q`` are the cells' posteriors, ``want`` the tokens wanted by source. In the metric scaled by tokens
    and by the sources' expected masses a step of length 1 never overshoots; each is projected to 0 and the cap.
    """
    mass = tokens @ q
    there = mass > 0
    r, gap = np.zeros(len(cap)), float("inf")
    for _ in range(steps):
        left = want - (r * tokens) @ q
        before, gap = gap, float(np.sum(left[there] ** 2 / mass[there]))
        if np.isfinite(before) and before - gap <= 1e-3 * before:  # caps or overlapping posteriors leave the rest
            break
        r = np.clip(r + q @ np.divide(left, mass, out=np.zeros(len(mass)), where=there), 0.0, cap)
    return r


def settled(r: np.ndarray, tokens: np.ndarray, cap: float, want: float) -> np.ndarray:
    """Rates of a label's cells scaled by one factor, within the cap, so that the label's total is ``want``, or as near as the cap lets it."""
    if not len(r) or want <= 0 or cap <= 0:
        return np.zeros(len(r))
    r = np.maximum(r, 1e-6 * cap)
    if cap * tokens.sum() <= want:
        return np.full(len(r), float(cap))
    low, high = 0.0, cap / r.min()
    for _ in range(200):
        f = (low + high) / 2
        low, high = (f, high) if (np.minimum(cap, f * r) * tokens).sum() < want else (low, f)
    return np.minimum(cap, high * r)


class Mixture:
    """A fitted mixture: ``selection()`` and ``report()``."""

    def __init__(self, docs: DataFrame, mixes: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, path: str = DEFAULT, sample: int = SAMPLE_DOCS) -> None:
        spark = docs.sparkSession
        model = fit(docs, doc, text, source, path, sample)
        self.model, self.classes = model, model.classes if model else []
        wanted = [tuple(r) for r in targets(mixes).select("mix", "source", "share", "cap").collect()]  # a table of wanted shares is small by its nature
        self.wanted = wanted
        self.texts = materialize(measured(docs, model, doc, text, source, path), "texts") if model else None
        if self.texts is None:
            self.mass, self.plans = {}, plan(wanted, {}, None if total == ALL else total)
            self.chosen = spark.createDataFrame([], "mix string, source string, q array<bigint>, rate double, soft double")
            return
        names = [r[1] for r in wanted]
        self.mass = dict(self.texts.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens")).collect())
        if total is not None and math.isinf(total):
            total = float(self.texts.agg(F.sum("tokens")).first()[0] or 0)
        self.plans = plan(wanted, self.mass, total)
        # bounded: labels of the mixes, and CELLS posteriors of each
        c = self.texts.filter(F.col("source").isin(names)).groupBy("source", "q").agg(F.sum("tokens").alias("tokens")).toPandas()
        goals = pd.DataFrame([(m, s, cap) for m, s, share, cap in wanted if cap > 0 and share > 0], columns=["mix", "source", "cap"])
        c = c.merge(goals, on="source").reset_index(drop=True)
        c["rate"] = 0.0
        for m, x in c.groupby("mix"):
            q, t, cap = np.stack(x["q"].to_list()) / model.parts, x["tokens"].to_numpy(float), x["cap"].to_numpy(float)
            r = fitted(q, cap, t, np.array([self.plans[m][1].get(k, (0.0, 0))[0] for k in self.classes]))
            for s, at in x.reset_index(drop=True).groupby("source").groups.items():
                r[at] = settled(r[at], t[at], float(cap[at[0]]), self.plans[m][1][s][0])
            c.loc[x.index, "rate"] = r
        self.expected = {}
        for m, x in c.groupby("mix"):
            e = (x["rate"] * x["tokens"]).to_numpy() @ (np.stack(x["q"].to_list()) / model.parts)
            self.expected |= {(m, k): float(v) for k, v in zip(self.classes, e)}
        self.cells = len(c)
        c["q"] = [[int(v) for v in q] for q in c["q"]]
        self.chosen = spark.createDataFrame(c[["mix", "source", "q", "rate"]], "mix string, source string, q array<bigint>, rate double") if len(c) else spark.createDataFrame([], "mix string, source string, q array<bigint>, rate double")

    def selection(self) -> DataFrame:
        """(mix, doc_id, source, tokens, repeats): the texts used, each at most max_repeats times.

        Rates become whole repeats by running sums over texts in order of size, within
        hashed groups of bounded size. Of OFFSETS starting points each mix and source takes the one
        whose tokens come nearest its plan; what is still left is met by one text of nearest size, used once more or once less.
        """
        spark = self.chosen.sparkSession
        if self.texts is None:
            return spark.createDataFrame([], "mix string, doc_id bigint, source string, tokens bigint, repeats bigint")
        groups = max(1, -(-self.texts.count() // 50_000))
        rated = self.texts.join(small_or_plain(self.chosen, self.cells, 16 * (8 + len(self.classes))), ["source", "q"]).filter("rate > 0").withColumn("g", F.pmod(F.xxhash64("doc"), F.lit(groups)))
        w = W.partitionBy("mix", "source", "g").orderBy("tokens", "doc").rowsBetween(W.unboundedPreceding, 0)
        rated = materialize(rated.select("mix", "source", "doc", "tokens", "rate", F.sum("rate").over(w).alias("upto")), "rated")

        def repeats(offset: float | Column) -> Column:
            start = offset if isinstance(offset, Column) else F.lit(offset)
            return (F.floor(F.col("upto") + start + 1e-9) - F.floor(F.col("upto") - F.col("rate") + start + 1e-9)).cast("bigint")

        tried = rated.groupBy("mix", "source").agg(*[F.sum(F.col("tokens") * repeats((i + 0.5) / OFFSETS)).alias(f"t{i}") for i in range(OFFSETS)]).collect()
        best = []
        for r in tried:
            want, cap = self.plans[r["mix"]][1][r["source"]]
            i = min(range(OFFSETS), key=lambda i: abs(r[f"t{i}"] - want))
            best.append((r["mix"], r["source"], (i + 0.5) / OFFSETS, want - r[f"t{i}"], cap))
        start = spark.createDataFrame(best, "mix string, source string, start double, left double, cap bigint")
        out = rated.join(small_or_plain(start, len(best), 120), ["mix", "source"]).withColumn("repeats", repeats(F.col("start")))
        can = F.when(F.col("left") > 0, F.col("repeats") < F.col("cap")).otherwise(F.col("repeats") > 0)
        off = F.abs(F.col("tokens") - F.abs("left"))
        nearest = out.filter(can & (off < F.abs("left"))).groupBy("mix", "source").agg(F.min(F.struct(off.alias("off"), "doc")).alias("x"), F.first("left").alias("left"))
        fix = nearest.select("mix", "source", F.col("x.doc").alias("doc"), F.signum("left").cast("bigint").alias("more"))
        out = out.join(small_or_plain(fix, len(best), 120), ["mix", "source", "doc"], "left").withColumn("repeats", F.col("repeats") + F.coalesce("more", F.lit(0)))
        return out.filter("repeats > 0").select("mix", F.col("doc").alias("doc_id"), "source", "tokens", "repeats")

    def report(self) -> DataFrame:
        """Per mix and source what was wanted, what there is, and what was reached.

        ``actual_share`` is of the tokens used in the mix, ``plan_share`` of its planned total; ``reachable``
        tells whether the source's tokens times its cap suffice for its part of the plan.
        """
        spark = self.chosen.sparkSession
        used = self.selection().groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
        rows = [(m, s, share, cap, int(self.mass.get(s, 0)), self.plans[m][1][s][0], self.plans[m][0], self.mass.get(s, 0) * cap >= self.plans[m][1][s][0] and self.mass.get(s, 0) > 0, getattr(self, "expected", {}).get((m, s), 0.0)) for m, s, share, cap in self.wanted]
        goal = spark.createDataFrame(rows, "mix string, source string, target_share double, max_repeats bigint, available_tokens bigint, wanted_tokens double, plan_tokens double, reachable boolean, expected_tokens double")
        out = goal.join(used, ["mix", "source"], "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
        share = F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(W.partitionBy("mix")), F.lit(0))
        return out.withColumn("actual_share", F.coalesce(share, F.lit(0.0))).withColumn("plan_share", F.coalesce(F.col("used_tokens") / F.nullif("plan_tokens", F.lit(0.0)), F.lit(0.0))).drop("plan_tokens")
