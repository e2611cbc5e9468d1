"""Fragment-size model, fragment-length mixture and hidden-Markov states: distributed counts, small NumPy fits."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals, peaks, pileup, step, tracks
from tidemark.operators.ordered import along
from tidemark.plans.tables import stage


class NotEnoughPairs(ValueError):
    """Fewer strand-paired peaks than the model needs."""


def smooth(x: np.ndarray, width: int = 11) -> np.ndarray:
    """Flat moving average with reflected ends."""
    half = width // 2
    padded = np.concatenate([x[half:0:-1], x, x[-2 : -half - 2 : -1]]) if len(x) > half else np.pad(x, half, mode="edge")
    return np.convolve(padded, np.ones(width) / width, mode="valid")


def strand_model(tags: DataFrame, genome_size: float, bandwidth: int = 300, mfold: tuple[float, float] = (5, 50), d_min: int = 20, least_pairs: int = 100) -> dict:
    """Fragment size ``d`` from the offset of forward and reverse tag densities around paired peaks.

    Peaks of each strand hold between the two fold bounds of tags; a forward peak pairs with a later reverse one within
    the peak size. Tags around the centres are counted by offset in Spark; what reaches the driver is one number per
    offset (a window of fixed size). Raises NotEnoughPairs below ``least_pairs``.
    """
    size = 2 * bandwidth
    total = tags.count()
    low, high = (int(round(total * m * size / genome_size / 2)) for m in mfold)
    found = []
    for strand in (0, 1):
        wide = tags.where(F.col("strand") == strand).select("chrom", (F.greatest(F.col("pos") - size // 2, F.lit(0))).cast("long").alias("l"), (F.col("pos") + size // 2).cast("long").alias("r"))
        p = peaks.call(pileup.pileup(wide), float(max(low, 1)), 200, 50, strict=True).where(F.col("score") < high)
        found.append(p.select("chrom", F.col("summit").alias("p"), F.col("score").alias("n")))
    plus, minus = found
    near = intervals.points_in_windows(plus.select("chrom", F.col("p").alias("pos"), F.col("n").alias("np")), minus.select("chrom", F.col("p").alias("start"), F.col("p").alias("end"), F.col("n").alias("nm")), size)
    pairs = near.where((F.col("pos") < F.col("b_start")) & (F.col("np") / F.col("b_nm") > 0.5) & (F.col("np") / F.col("b_nm") < 2))
    centres = pairs.select("chrom", F.floor((F.col("pos") + F.col("b_start")) / 2).cast("long").alias("start")).withColumn("end", F.col("start")).distinct()
    n = centres.count()
    if n < least_pairs:
        raise NotEnoughPairs(f"{n} pairs of peaks; {least_pairs} are needed")
    reach = size + 5
    hits = intervals.points_in_windows(tags, centres, reach)
    counts = hits.groupBy("strand", (F.col("pos") - F.col("b_start")).cast("int").alias("offset")).count().collect()
    lines = np.zeros((2, 2 * reach + 1))
    for r in counts:
        lines[r["strand"], r["offset"] + reach] = r["count"]
    lines = np.array([np.convolve(x, np.ones(11), mode="same") for x in lines])  # each tag spread over +-5
    z = [(x - x.mean()) / (x.std() or 1) / len(x) for x in lines]
    lags = np.arange(-size, size + 1)
    full = np.correlate(z[1] * len(z[1]), z[0], mode="full")[len(z[0]) - 1 - size : len(z[0]) + size]
    y = smooth(full)
    tops = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1] and lags[i] > d_min]
    tops.sort(key=lambda i: -y[i])
    if not tops:
        raise NotEnoughPairs("no offset above the least fragment size")
    return {"d": int(lags[tops[0]]), "alternatives": sorted(int(lags[i]) for i in tops), "pairs": n, "plus": lines[0].tolist(), "minus": lines[1].tolist(), "correlation": y.tolist()}


def model_table(spark: SparkSession, model: dict) -> DataFrame:
    """``(curve, offset, value)``: what the plots of a model show, the tags of both strands around the centres and their correlation by offset."""
    rows = [(name, k - len(model[name]) // 2, float(v)) for name in ("plus", "minus", "correlation") for k, v in enumerate(model[name])]
    return spark.createDataFrame(rows, "curve string, offset int, value double")


def mixture(frags: DataFrame, means=(50, 200, 400, 600), stddevs=(20, 20, 20, 20), share: float = 0.1, jump: float = 1.5, epsilon: float = 0.05, rounds: int = 20, seed: int = 0) -> tuple[list[float], list[float]]:
    """Means and deviations of the mono-, di- and tri-nucleosomal lengths by hard-assignment EM; the shortest class stays.

    It iterates on the histogram of a sample's lengths from 100 to 1000: at most 901 rows reach the driver.
    """
    some = tracks.sample(frags.select("chrom", "l", "r"), ["chrom"], share, seed=seed) if share < 1 else frags
    rows = tracks.length_histogram(some).where("len between 100 and 1000").collect()
    x, n = np.array([r["len"] for r in rows], float), np.array([r["n"] for r in rows], float)
    mu, sd = np.array(means[1:], float), np.array(stddevs[1:], float)
    w = np.full(3, 1 / 3)
    for _ in range(rounds if len(x) else 0):
        dens = w[:, None] * np.exp(-((x - mu[:, None]) ** 2) / (2 * sd[:, None] ** 2)) / (sd[:, None] * math.sqrt(2 * math.pi))
        best = dens.argmax(0)
        clear = (dens == dens.max(0)).sum(0) == 1
        new_mu, new_sd, new_w = mu.copy(), sd.copy(), w.copy()
        for k in range(3):
            own = clear & (best == k)
            m = n[own].sum()
            if m > 1:
                mean = (x[own] * n[own]).sum() / m
                dev = math.sqrt((n[own] * (x[own] - mean) ** 2).sum() / m)
                new_mu[k], new_sd[k] = mu[k] + jump * (mean - mu[k]), max(1e-3, sd[k] + jump * (dev - sd[k]))
                new_w[k] = m / n[clear].sum()
        moved = np.abs(new_mu - mu).max()
        mu, sd, w = new_mu, new_sd, new_w
        if moved < epsilon:
            break
    return [round(float(v), 1) for v in (means[0], *mu)], [round(float(v), 1) for v in (stddevs[0], *sd)]


CLASSES = ["short", "mono", "di", "tri"]
#: The least signal of a bin.
FLOOR = 1e-4


def length_weights(lengths: DataFrame, means: list[float], stddevs: list[float], least: float = 0.001) -> DataFrame:
    """``(len, short, mono, di, tri)``: each length's share of the four densities; 0 where all are below ``least``."""
    dens = [F.exp(-F.pow(F.col("len") - float(m), F.lit(2.0)) / (2 * s * s)) / (s * math.sqrt(2 * math.pi)) for m, s in zip(means, stddevs)]
    rows = lengths.select("len").distinct().select("len", *(d.alias(f"_{c}") for d, c in zip(dens, CLASSES)))
    total = sum((F.col(f"_{c}") for c in CLASSES), F.lit(0.0))
    low = F.greatest(*(F.col(f"_{c}") for c in CLASSES)) < least
    return rows.select("len", *(F.when(low, 0.0).otherwise(F.col(f"_{c}") / total).alias(c) for c in CLASSES))


def digested(frags: DataFrame, weights: DataFrame) -> dict[str, DataFrame]:
    """Four weighted coverages: nucleosome-free, mono-, di- and tri-nucleosomal."""
    return pileup.weighted_by_length(frags, weights, CLASSES)


def bin_signals(signals: dict[str, DataFrame], regions: DataFrame, size: int = 10) -> DataFrame:
    """``(chrom, start, end, bin_end, short, mono, di, tri)``: each signal at the bin's last base, ``FLOOR`` where there is less or none."""
    rows = intervals.bins(regions, size).select("chrom", F.col("region.start").alias("start"), F.col("region.end").alias("end"), "bin_end")
    sampled = step.sample_many(signals, rows)
    return sampled.select(*rows.columns, *(F.greatest(F.coalesce(n, F.lit(0.0)), F.lit(FLOOR)).alias(n) for n in signals))


class StateModel:
    """Hidden Markov model with Gaussian (full covariance) or Poisson emissions."""

    def __init__(self, kind: str, start, trans, means, covars=None):
        self.kind, self.start, self.trans, self.means = kind, np.asarray(start, float), np.asarray(trans, float), np.asarray(means, float)
        self.covars = None if covars is None else np.asarray(covars, float)

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "poisson":
            x = np.floor(np.maximum(x, 0))
            const = np.vectorize(math.lgamma)(x + 1).sum(1)
            lam = np.maximum(self.means, 1e-4)
            return x @ np.log(lam).T - lam.sum(1) - const[:, None]
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covars)):
            chol = np.linalg.cholesky(c)
            y = np.linalg.solve(chol, (x - m).T)
            out[:, k] = -0.5 * (y * y).sum(0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def forward_backward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Posteriors, summed transition posteriors and log likelihood of one sequence, scaled at every step."""
        logb = self.log_emission(x)
        peak = logb.max(1, keepdims=True)
        b = np.exp(logb - peak)
        n, k = b.shape
        alpha, beta, scale = np.empty((n, k)), np.ones((n, k)), np.empty(n)
        a = self.start * b[0]
        for t in range(n):
            if t:
                a = (alpha[t - 1] @ self.trans) * b[t]
            scale[t] = a.sum() or 1e-300
            alpha[t] = a / scale[t]
        xi = np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            right = b[t + 1] * beta[t + 1] / scale[t + 1]
            xi += self.trans * np.outer(alpha[t], right)
            beta[t] = self.trans @ right
        post = alpha * beta
        return post / post.sum(1, keepdims=True), xi, float(np.log(scale).sum() + peak.sum())

    def labels(self) -> dict[str, int]:
        """open is the state of the greatest summed means, bg of the least, nuc the other."""
        order = np.argsort(self.means.sum(1))
        return {"open": int(order[-1]), "bg": int(order[0]), "nuc": int(order[1])}

    def dump(self, bin_size: int = 10) -> str:
        return json.dumps({"startprob": self.start.tolist(), "transmat": self.trans.tolist(), "means": self.means.tolist(), "covars": None if self.covars is None else self.covars.tolist(), "hmm_type": self.kind, "hmm_binsize": bin_size, "labels": self.labels()})

    @classmethod
    def load(cls, text: str) -> StateModel:
        m = json.loads(text)
        kind = m.get("hmm_type", "gaussian")
        return cls(kind, m["startprob"], m["transmat"], m.get("means", m.get("lambdas")), m.get("covars"))


def train_states(x: np.ndarray, lengths: list[int], kind: str = "gaussian", states: int = 3, rounds: int = 100, tol: float = 1e-2, seed: int = 12345) -> StateModel:
    """Baum-Welch on sequences laid end to end (a bounded training sample), started from k-means of the bins."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(10):  # several starts, each centre drawn far from those before
        centres = x[[rng.integers(len(x))]].astype(float)
        while len(centres) < states:
            far = ((x[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]])
        for _ in range(50):
            own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
            new = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(states)])
            if np.allclose(new, centres):
                break
            centres = new
        spread = ((x - centres[own]) ** 2).sum()
        if best is None or spread < best[0]:
            best = (spread, centres, own)
    _, centres, own = best
    eye = np.eye(x.shape[1]) * 1e-3
    covars = np.array([(np.cov(x[own == k].T).reshape(x.shape[1], -1) if (own == k).sum() > 1 else np.zeros_like(eye)) + eye for k in range(states)])
    m = StateModel(kind, np.full(states, 1 / states), np.full((states, states), 1 / states), centres, None if kind == "poisson" else covars)
    ends, last = np.cumsum([0, *lengths]), -np.inf
    for _ in range(rounds):
        post, xi, first, like = np.empty((len(x), states)), np.zeros((states, states)), np.zeros(states), 0.0
        for a, b in zip(ends[:-1], ends[1:]):
            post[a:b], part, ll = m.forward_backward(x[a:b])
            xi += part
            first += post[a]
            like += ll
        mass = post.sum(0)[:, None] + 1e-10
        m.start, m.trans, m.means = first / first.sum(), xi / np.maximum(xi.sum(1, keepdims=True), 1e-300), post.T @ (np.floor(np.maximum(x, 0)) if kind == "poisson" else x) / mass
        if kind != "poisson":
            m.covars = np.array([((post[:, k, None] * (x - m.means[k])).T @ (x - m.means[k])) / mass[k] + eye for k in range(states)])
        if like - last < tol:
            break
        last = like
    return m


#: Bins of a region that are decoded at a time; what stands on both sides of them enters as one vector each.
CHUNK = 512
#: Chunks that a worker takes through the model side by side.
SIDE_BY_SIDE = 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def _blocks(pdf: pd.DataFrame, model: StateModel) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Some chunks at a time: their rows, which bins each has, and emissions (chunk, bin, state), the greatest of a bin 1."""
    for at in range(0, len(pdf), SIDE_BY_SIDE):
        rows = pdf.iloc[at : at + SIDE_BY_SIDE]
        sizes = rows["n"].to_numpy()
        held = np.arange(sizes.max()) < sizes[:, None]
        logb = model.log_emission(np.concatenate(rows["x"].to_list()).reshape(-1, len(CLASSES)))
        b = np.ones((*held.shape, logb.shape[1]))
        b[held] = np.exp(logb - logb.max(1, keepdims=True))
        yield rows, held, b


def decode_states(bins: DataFrame, model: StateModel, chunk: int = CHUNK) -> DataFrame:
    """``(chrom, start, end, bin_end, p_open, p_nuc, p_bg)``: posteriors of each region's bins; a region's bins are one sequence.

    A long region is cut into chunks of its bins, which stand at equal distances. What a chunk does to a distribution over
    the states is a small matrix; one such row per chunk meets in a task per region, where the vectors that enter each
    chunk from both sides are multiplied up. Then every chunk is decoded on its own, many side by side, as it is in the
    whole sequence.
    """
    label, region, k = model.labels(), ["chrom", "start", "end"], len(model.start)
    span = bins.groupBy(*region).agg(F.min("bin_end").alias("_a"), F.max("bin_end").alias("_b"), F.count("*").alias("_n"))
    step = F.when(F.col("_n") > 1, (F.col("_b") - F.col("_a")) / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    placed = bins.join(span, region).withColumn("c", F.floor((F.col("bin_end") - F.col("_a")) / F.greatest(step, F.lit(1e-9)) / chunk).cast("int"))
    held = F.sort_array(F.collect_list(F.struct("bin_end", F.array(*(F.col(c).cast("double") for c in CLASSES)).alias("v")))).alias("h")
    chunks = placed.groupBy(*region, "c").agg(held).select(*region, "c", F.size("h").alias("n"), F.col("h.bin_end").alias("at"), F.flatten("h.v").alias("x"))
    chunks = stage(chunks, "state-chunks")

    def effect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The matrix of every chunk; that of a region's first one leads from anywhere to what the start makes of it."""
        for pdf in parts:
            out = []
            for rows, held, b in _blocks(pdf, model):
                first = (rows["c"].to_numpy() == 0)[:, None, None]
                m = np.broadcast_to(np.eye(k), (len(rows), k, k))
                for t in range(b.shape[1]):
                    moved = m @ model.trans
                    moved = (np.where(first, model.start, moved) if t == 0 else moved) * b[:, t, None, :]
                    m = np.where(held[:, t, None, None], moved / np.maximum(moved.sum((1, 2), keepdims=True), 1e-300), m)
                out += list(m.reshape(len(rows), -1))
            yield pdf[[*region, "c"]].assign(m=out)

    def sides(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of every region the vectors that enter each chunk."""
        for pdf in parts:
            out = []
            for chrom, start, end, at, flat in pdf[[*region, "c", "m"]].itertuples(index=False):
                m = np.asarray(flat).reshape(-1, k, k)
                before, after = np.full((len(m), k), 1 / k), np.ones((len(m), k))
                for c in range(1, len(m)):
                    before[c] = _unit(before[c - 1] @ m[c - 1])
                for c in range(len(m) - 1, 0, -1):
                    after[c - 1] = _unit(m[c] @ after[c])
                out += zip([chrom] * len(m), [start] * len(m), [end] * len(m), at, before, after)
            yield pd.DataFrame(out, columns=[*region, "c", "before", "after"])

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for rows, held, b in _blocks(pdf, model):
                first = (rows["c"].to_numpy() == 0)[:, None]
                alpha, beta = np.empty_like(b), np.empty_like(b)
                a, z = np.stack(rows["before"].to_list()), np.stack(rows["after"].to_list())
                for t in range(b.shape[1]):
                    moved = a @ model.trans
                    moved = (np.where(first, model.start, moved) if t == 0 else moved) * b[:, t]
                    a = alpha[:, t] = np.where(held[:, t, None], _unit(moved), a)
                for t in range(b.shape[1] - 1, -1, -1):
                    beta[:, t] = z
                    z = np.where(held[:, t, None], _unit((b[:, t] * z) @ model.trans.T), z)
                post, n = _unit(alpha * beta)[held], rows["n"].to_numpy()
                own = {c: np.repeat(rows[c].to_numpy(), n) for c in region} | {"bin_end": np.concatenate(rows["at"].to_list())}
                yield pd.DataFrame(own | {f"p_{x}": post[:, label[x]] for x in ("open", "nuc", "bg")})

    key = "chrom string, start long, end long, c int"
    matrices = chunks.select(*region, "c", "n", "x").mapInPandas(effect, f"{key}, m array<double>")
    held = F.sort_array(F.collect_list(F.struct("c", "m"))).alias("h")
    rows = matrices.groupBy(*region).agg(held).select(*region, F.col("h.c").alias("c"), F.flatten("h.m").alias("m"))
    vectors = rows.mapInPandas(sides, f"{key}, before array<double>, after array<double>")
    return chunks.join(vectors, [*region, "c"]).mapInPandas(decode, "chrom string, start long, end long, bin_end long, p_open double, p_nuc double, p_bg double")


def state_runs(posteriors: DataFrame, size: int = 10) -> DataFrame:
    """``(chrom, start, end, state)``: neighbouring bins of equal label merged; of equal posteriors open, then nuc, then bg."""
    o, n, b = F.col("p_open"), F.col("p_nuc"), F.col("p_bg")
    label = F.when((o >= n) & (o >= b), "open").when(n >= b, "nuc").otherwise("bg")
    cells = posteriors.select("chrom", (F.col("bin_end") - size).alias("start"), F.col("bin_end").alias("end"), label.alias("state"))
    return step.rle(cells, ["state"])


def accessible(runs: DataFrame, min_length: int = 100) -> DataFrame:
    """``(chrom, start, end, open_start, open_end)``: open runs between two touching nuc runs, longer than ``min_length`` in all."""
    sides = along(runs, ["chrom"], "start", lags={"_pl": F.struct("start", "end", "state")}, leads={"_nx": F.struct("start", "end", "state")})
    ok = (F.col("state") == "open") & (F.col("_pl.state") == "nuc") & (F.col("_nx.state") == "nuc") & (F.col("_pl.end") == F.col("start")) & (F.col("_nx.start") == F.col("end"))
    out = sides.where(ok & (F.col("_nx.end") - F.col("_pl.start") > min_length))
    return out.select("chrom", F.col("_pl.start").alias("start"), F.col("_nx.end").alias("end"), F.col("start").alias("open_start"), F.col("end").alias("open_end"))
