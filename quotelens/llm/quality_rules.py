"""Quality rules: counted statistics, two plain rules, and robust multivariate outliers per language and source.

Each text becomes a vector of transformed statistics. For every (lang, source) the minimum-covariance-determinant
estimate is found from three deterministic starts, each concentrated until its determinant falls no further, and the
one of least determinant is taken. A concentration step is a pair of distributed aggregations over all rows: no group
is gathered in one task and nothing is sampled. The covariance, and so the determinant, is the regularised one, with
the squares of ``FLOORS`` on its diagonal. A document whose robust Mahalanobis distance is beyond the chi-square cut is
rejected.

Defined cases: null or empty text has zero counts and fails the base rules; null lang or source form groups of their
own; repeated rows are judged one by one; a group of fewer than ``min_rows`` usable rows uses the estimate of all
rows; if there is no usable row at all, nothing beyond the base rules is rejected. Other columns of the input are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import Words, _BASE, U64, batches, mix, record, slice_hashes, stored

SYMBOLS = b"#*$%&|<>"
FEATURES = ("log_words", "log_word_chars", "symbols", "dup_lines", "repeats", "upper")
#: Least standard deviation of each feature: statistics that hardly vary in clean text must not turn noise into outliers.
FLOORS = (0.7, 0.12, 0.22, 0.25, 0.18, 0.06)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class OutlierConfig:
    core: float = 0.75  #: share of a group's rows that the estimate is concentrated on
    steps: int = 50  #: concentration steps of a start at most; they end where the determinant falls no further
    least_fall: float = 1e-6  #: of the determinant's logarithm in a step
    tail: float = 1e-5  #: chi-square tail beyond which a vector is an outlier
    min_rows: int = 60  #: groups with fewer usable rows take the estimate of all rows
    broadcast_groups: int = 20_000  #: estimates of more groups are joined by shuffle


def _flags(words: Words, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their document."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    hit = np.zeros(len(v), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    out = np.zeros(len(v), dtype=bool)
    out[order] = hit
    return out


def count_batch(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text, by vectorised passes over the bytes of the batch."""
    w = Words(texts, lower=False)
    n = len(texts)
    gap = np.ones(len(w.data), dtype=bool)
    inside = np.zeros(len(w.data) + 1, dtype=np.int32)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    gap = np.cumsum(inside[:-1]) == 0

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[w.text_start[1:]] - total[w.text_start[:-1]]

    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    word_chars = per_text(~gap & ((w.data & 0xC0) != 0x80))
    upper = per_text((w.data >= 65) & (w.data <= 90))
    ends = np.flatnonzero(w.data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    line_doc = np.searchsorted(w.text_start, starts, "right") - 1
    starts, ends, line_doc = starts[filled], ends[filled], line_doc[filled]
    lines = slice_hashes(w.data, starts, ends)
    order = np.lexsort((lines, line_doc))
    again = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = np.bincount(line_doc[order][1:][again], minlength=n)
    h, first = w.hashes, w.first
    repeated = np.zeros(n, dtype=np.int64)
    if len(h) >= 3:
        windows = mix(mix(h[:-2] * U64(_BASE) + h[1:-1]) * U64(_BASE) + h[2:])
        doc = w.doc[:-2]
        own = w.doc[2:] == doc
        hit = np.zeros(len(h) + 1, dtype=np.int32)
        at = np.flatnonzero(own)[_flags(w, windows[own], doc[own])]
        np.add.at(hit, at, 1)
        np.add.at(hit, np.minimum(at + 3, len(h)), -1)
        repeated = np.bincount(w.doc[np.cumsum(hit[:-1]) > 0], minlength=n)
    return {
        "n_words": w.counts, "word_chars": word_chars, "n_symbols": per_text(symbol[w.data]), "n_dup_lines": dup_lines,
        "n_repeat_words": repeated, "n_lines": np.bincount(line_doc, minlength=n), "n_upper": upper,
    }


def features(c: dict[str, np.ndarray]) -> list[np.ndarray]:
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return [
        np.log1p(c["n_words"]), np.log(chars / words), np.log1p(20 * c["n_symbols"] / chars), np.sqrt(c["n_dup_lines"] / lines),
        np.sqrt(c["n_repeat_words"] / words), c["n_upper"] / chars,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, ``base_failed`` and the transformed vector x0.. of every document."""
    kept = docs.select("doc_id", "lang", "source", "text")
    names = ["doc_id", "lang", "source", *COUNTS]
    fields = [(f.name, {"long": "bigint"}.get(f.dataType.typeName(), f.dataType.simpleString())) for f in kept.schema[:3]]
    ddl = ", ".join([f"{n} {t}" for n, t in fields] + [f"{n} bigint" for n in COUNTS] + [f"x{i} double" for i in range(len(FEATURES))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(source, "text"):
            c = count_batch(texts)
            cols = [batch.column(n) for n in ("doc_id", "lang", "source")]
            cols += [pa.array(c[n].astype(np.int64)) for n in COUNTS] + [pa.array(x.astype(float)) for x in features(c)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *(f"x{i}" for i in range(len(FEATURES)))])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return kept.mapInArrow(run, ddl).withColumn("base_failed", failed)


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the incomplete gamma function."""
    import math

    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= half / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_PARAMS = [f"m{i}" for i in range(_P)] + [f"w{i}_{j}" for i, j in _PAIRS]
_FOUND = ["g_lang", "g_source", "g_start", "g_n", "logdet", "before", *_PARAMS]


def _distance() -> F.Column:
    """The squared Mahalanobis distance of x from m under the inverse covariance w, as one codegen expression."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_P)]
    terms = [d[i] * d[j] * F.col(f"w{i}_{j}") * F.lit(1.0 if i == j else 2.0) for i, j in _PAIRS]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group: medians, and the covariance by quartile ranges alone, with the correlation of tanh and with spatial signs."""
    for pdf in frames:
        rows = []
        for r in pdf.to_dict("records"):
            m, scale = (np.array([r[f"{c}{i}"] for i in range(_P)]) for c in ("med", "scale"))
            tanh, sign = np.zeros((_P, _P)), np.zeros((_P, _P))
            for i, j in _PAIRS:
                tanh[i, j] = tanh[j, i] = r[f"t{i}_{j}"] - r[f"t{i}"] * r[f"t{j}"]
                sign[i, j] = sign[j, i] = r[f"u{i}_{j}"]
            spread = np.sqrt(np.maximum(np.diag(tanh), 1e-12))
            shapes = np.eye(_P), tanh / np.outer(spread, spread), sign * _P / max(np.trace(sign), 1e-12)
            for k, shape in enumerate(shapes):
                inv = np.linalg.inv(shape * np.outer(scale, scale) + np.diag(np.square(FLOORS)))
                rows.append([r["g_lang"], r["g_source"], k, r["g_n"], np.inf, np.inf, *m, *(inv[i, j] for i, j in _PAIRS)])
        yield pd.DataFrame(rows, columns=_FOUND)


def _inverse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group and start: mean, inverse and log determinant of the floored covariance from the moments."""
    for pdf in frames:
        rows = []
        for r in pdf.to_dict("records"):
            m = np.array([r[f"s{i}"] for i in range(_P)])
            cov = np.zeros((_P, _P))
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] - m[i] * m[j]
            cov += np.diag(np.square(FLOORS))
            inv = np.linalg.inv(cov)
            rows.append([r["g_lang"], r["g_source"], r["g_start"], r["g_n"], np.linalg.slogdet(cov)[1], r["before"], *m, *(inv[i, j] for i, j in _PAIRS)])
        yield pd.DataFrame(rows, columns=_FOUND)


def _with(rows: DataFrame, params: DataFrame, config: OutlierConfig, few: bool) -> DataFrame:
    on = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    return rows.join(F.broadcast(params) if few else params, on)


def outliers(stats: DataFrame, config: OutlierConfig = OutlierConfig()) -> DataFrame:
    """``stats`` (a stored table) with the robust squared distance ``robust_d2`` of each row that passes the base rules."""
    usable = stats.where(~F.col("base_failed"))
    keys = [F.col("lang").alias("g_lang"), F.col("source").alias("g_source")]
    sizes = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("g_n"))
    few = sizes.count() <= config.broadcast_groups
    moments = [F.avg(f"x{i}").alias(f"s{i}") for i in range(_P)] + [F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i, j in _PAIRS]
    ddl = "g_lang string, g_source string, g_start int, g_n bigint, " + ", ".join(f"{c} double" for c in ["logdet", "before", *_PARAMS])
    half = "array(" + ", ".join(f"percentile_approx(x{i}, array(0.25D, 0.5D, 0.75D), 1000)" for i in range(_P)) + ")"

    def starts(rows: DataFrame, broadcast: bool) -> DataFrame:
        q = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("g_n"), F.expr(half).alias("q"))
        scale = [F.sqrt(F.pow((F.col("q")[i][2] - F.col("q")[i][0]) / 1.349, 2) + FLOORS[i] ** 2).alias(f"scale{i}") for i in range(_P)]
        middle = stored(q.select("g_lang", "g_source", "g_n", *[F.col("q")[i][1].alias(f"med{i}") for i in range(_P)], *scale))
        z = _with(rows, middle, config, broadcast).withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"med{i}")) / F.col(f"scale{i}") for i in range(_P)})
        z = z.withColumn("far", F.greatest(F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P))), F.lit(1e-12)))
        z = z.withColumns({f"t{i}": F.tanh(f"z{i}") for i in range(_P)} | {f"u{i}": F.col(f"z{i}") / F.col("far") for i in range(_P)})
        shapes = [F.avg(f"t{i}").alias(f"t{i}") for i in range(_P)] + [F.avg(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}_{j}") for c in "tu" for i, j in _PAIRS]
        own = [F.first(c).alias(c) for c in ["g_n", *(f"{c}{i}" for c in ("med", "scale") for i in range(_P))]]
        return z.groupBy("g_lang", "g_source").agg(*own, *shapes).mapInPandas(_starts, ddl)

    def concentrate(rows: DataFrame, params: DataFrame, broadcast: bool) -> DataFrame:
        """One step: the rows nearest to the present centre give the next mean and covariance."""
        near = _with(rows, params, config, broadcast).withColumn("d2", _distance())
        named = [F.col(c).alias(f"c_{c[2:]}") for c in ("g_lang", "g_source", "g_start")]
        cut = near.groupBy(*named).agg(F.percentile_approx("d2", config.core, 10_000).alias("cut"))
        on = F.col("g_lang").eqNullSafe(F.col("c_lang")) & F.col("g_source").eqNullSafe(F.col("c_source")) & (F.col("g_start") == F.col("c_start"))
        core = near.drop("g_n").join(F.broadcast(cut) if broadcast else cut, on).where(F.col("d2") <= F.col("cut"))
        return core.groupBy("g_lang", "g_source", "g_start").agg(F.count(F.lit(1)).alias("g_n"), F.first("logdet").alias("before"), *moments).mapInPandas(_inverse, ddl)

    def least(rows: DataFrame, broadcast: bool) -> DataFrame:
        """Every start is concentrated until its determinant falls no further; the least of each group is taken."""
        active, ended = stored(starts(rows, broadcast)), []
        falls = F.col("logdet") < F.col("before") - config.least_fall
        for _ in range(config.steps):
            found = stored(concentrate(rows, active, broadcast))
            ended.append(found.where(~falls))
            active = found.where(falls)
            if active.isEmpty():
                break
        else:
            ended.append(active)
        every = ended[0]
        for e in ended[1:]:
            every = every.union(e)
        best = every.groupBy("g_lang", "g_source").agg(F.min_by(F.struct("g_n", *_PARAMS), F.struct("logdet", "g_start")).alias("best"))
        return best.select("g_lang", "g_source", "best.*")

    def scaled(rows: DataFrame, params: DataFrame, broadcast: bool) -> DataFrame:
        """Distances are scaled so that their median is that of chi-square."""
        mid = _with(rows, params, config, broadcast).groupBy(*keys).agg(F.percentile_approx(_distance(), 0.5, 1000).alias("mid"), F.count(F.lit(1)).alias("n_all"))
        return mid.select(F.col("g_lang").alias("h_lang"), F.col("g_source").alias("h_source"), F.greatest(F.col("mid") / chi2_quantile(0.5, _P), F.lit(1.0)).alias("ratio"), "n_all")

    def estimate(rows: DataFrame, broadcast: bool) -> DataFrame:
        params = stored(least(rows, broadcast))
        r = scaled(rows, params, broadcast)
        on = F.col("g_lang").eqNullSafe(F.col("h_lang")) & F.col("g_source").eqNullSafe(F.col("h_source"))
        return stored(params.join(r, on).drop("h_lang", "h_source", "g_n"))

    own = estimate(usable, few).where(F.col("n_all") >= config.min_rows).drop("n_all")
    everyone = estimate(usable.withColumns({"lang": F.lit("*"), "source": F.lit("*")}), True).drop("n_all", "g_lang", "g_source")
    named = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    base = stats.join(F.broadcast(own) if few else own, named, "left")
    common = everyone.select(*[F.col(c).alias(f"all_{c}") for c in [*_PARAMS, "ratio"]], F.lit(1).alias("one"))
    base = base.withColumn("one", F.lit(1)).join(F.broadcast(common), "one", "left").drop("one")
    base = base.withColumns({c: F.coalesce(c, f"all_{c}") for c in [*_PARAMS, "ratio"]})
    return base.withColumn("robust_d2", F.when(~F.col("base_failed"), _distance() / F.col("ratio")))


def quality_rules(docs: DataFrame, config: OutlierConfig = OutlierConfig()) -> DataFrame:
    """The counts, ``base_failed``, ``robust_d2`` and ``kept`` of every document."""
    stats = stored(statistics(docs))
    out = outliers(stats, config)
    cut = chi2_quantile(1 - config.tail, _P)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("robust_d2"), F.lit(0.0)) <= cut)
    return out.select("doc_id", "lang", "source", *COUNTS, "base_failed", kept.alias("kept"), "robust_d2")
