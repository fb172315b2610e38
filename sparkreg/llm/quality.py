"""Quality rules: fixed rules, then robust multivariate outliers.

Each text gives a vector of transformed statistics. For each language and source the minimum
covariance determinant (MCD) is estimated over all documents that the fixed rules pass: of all
subsets of h = SUPPORT of the rows, that whose covariance has the least determinant, sought by
concentration steps from several deterministic starts (as in DetMCD: coordinate-wise spreads, the
correlation of hyperbolic tangents, spatial signs; and two halves of the rows, parted by a hash). A step measures every row's Mahalanobis distance,
takes the h nearest and estimates mean and covariance from them alone; it is repeated until the
determinant falls no more, and the start with the least determinant wins. A document is rejected
where its squared distance exceeds the cutoff.

Groups of at most LOCAL rows are estimated in one task each. In larger ones a step is a few
aggregations, whatever the size: moments are summed by group, start and distance bin; the bins below
that of the h-th row count whole, and this one is cut again, down to single distances. So exactly h
rows count (rows at the very distance of the h-th share what is left of h), and rows need neither be
sorted nor be brought together. There the bin of the h-th row is taken in proportion until the
determinant settles, and the best start goes on with exact steps.

No statistic is taken to vary less than its counts do by chance: where, in some direction, the
estimated covariance is below the mean sampling variance of the rows it rests on (1/n for the
logarithm of a count n, 1/4n for the arcsine root of a share of n, times the number that one event
brings), it is raised to that. This alone keeps estimates of groups without spread from being
singular (most clean texts have no symbol and no repeated line).

Groups with under MIN_ROWS documents use the estimate of all documents of their language, languages
with fewer that of all documents. Models are broadcast while their number is small, else joined by
salted keys.

Nulls and edges: a null or blank text has no words and fails the base rule; null lang or source form
groups of their own; a statistic without spread has its sampling variance; where no document passes
the fixed rules there is no distance (null); rows with equal doc_id are judged one by one; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, released, slices

MIN_WORDS = 50
MAX_REPEAT = 50
SYMBOLS = b"#*$%&|<>"
#: Share of a group's documents that the estimate rests on.
SUPPORT = 0.75
#: Concentration steps at most; the determinant settles after three to ten.
STEPS = 60
#: Rows of a group that one task estimates.
LOCAL = 10_000
BINS = 96
#: Rows of a cut bin that are summed by single distances.
FEW = 20_000
MIN_ROWS = 60
#: Probability that a document of a normal population is rejected.
ALPHA = 1e-6
#: Models that are broadcast; a model has some 600 bytes.
BROADCAST_MODELS = 20_000
SALTS = 64
P = 6
V = [f"v{k}" for k in range(P)]
#: What one event brings: symbols come in runs of 3, lines repeat singly, a repeated clause is two times
#: 8 words, a number or a word in capitals has 5 signs.
RUNS = {"symbols": 3, "lines": 1, "repeats": 16, "shout": 5}
#: Sampling variance of a statistic: so many over the row's words, and over its word characters.
NOISE_N = np.array([1, 0, 0, RUNS["lines"] / 4, RUNS["repeats"] / 4, 0])
NOISE_C = np.array([0, 1, RUNS["symbols"] / 4, 0, 0, RUNS["shout"] / 4])

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SPACES = b" \t\n\v\f\r"
CONTINUE = bytes(range(0x80, 0xC0))
SHOUT = bytes(range(65, 91)) + bytes(range(48, 58))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(words)
    if n < 3:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number) + 1
    if k < 1 << 20:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        key = pair * k + ids[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    if not again.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[:-2] |= again
    hit[1:-1] |= again
    hit[2:] |= again
    return int(hit.sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text.translate(None, SPACES + CONTINUE))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def vector(x: np.ndarray, shout: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows of BASE and of capitals and digits: logarithms, and arcsine
    roots of shares, so that clean text is near normal."""
    n_words, chars, symbols, dups, repeats = x.T
    n, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    share = lambda v: np.arcsin(np.sqrt(np.clip(v, 0, 1)))
    return np.stack([np.log(n), np.log(c / n), share(symbols / c), share(dups / n), share(repeats / n), share(shout / c)], axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, 1024)):
        texts = [t or b"" for t in pc.cast(b.column(3), pa.binary()).to_pylist()]
        x = np.array([statistics(t) for t in texts], dtype=np.int64).reshape(-1, len(BASE))
        shout = np.array([len(t) - len(t.translate(None, SHOUT)) for t in texts], dtype=np.int64)
        v = vector(x, shout)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), *map(pa.array, x.T), *map(pa.array, v.T)],
            ["doc_id", "lang", "source", *BASE, *V],
        )


def measured(docs: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id of that kind, lang, source, the base statistics and the transformed vector v0, v1, ..."""
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in V])
    return docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text").mapInArrow(released(_measure), schema)


def chi2_quantile(p: float, df: int) -> float:
    """Wilson and Hilferty's approximation."""
    return df * (1 - 2 / (9 * df) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * df))) ** 3


def chi2_cdf(x: float, df: int) -> float:
    return NormalDist().cdf(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def consistency(support: float) -> float:
    """What the covariance of the nearest share of normal data is to be multiplied by."""
    return support / chi2_cdf(chi2_quantile(support, P), P + 2)


def _distance():
    """Squared Mahalanobis distance of v0.. from c0.. under the inverse q0_0.."""
    d = [F.col(v) - F.col(f"c{k}") for k, v in enumerate(V)]
    terms = [F.col(f"q{i}_{j}") * d[i] * d[j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    return reduce(lambda a, b: a + b, terms)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Sums over rows: their number, inverse counts, statistics, products.
SUMS = ["n", "a", "b", *[f"s{k}" for k in range(P)], *[f"m{i}_{j}" for i, j in PAIRS]]
CENTRE, FORM = [f"c{k}" for k in range(P)], [f"q{i}_{j}" for i, j in PAIRS]
DOUBLES = ["logdet", *CENTRE, *FORM]
MODEL = "g string, k int, " + ", ".join(f"{c} double" for c in DOUBLES)
STATE = MODEL + ", h double, need double, lo double, hi double, inside double, " + ", ".join(f"{c} double" for c in SUMS)
CARRIED = [c.split()[0] for c in STATE.split(", ")]


def _sums(v: list) -> list:
    """The SUMS of rows as aggregates, for statistics given as Columns."""
    values = [F.lit(1.0), F.col("ia"), F.col("ib"), *v, *[v[i] * v[j] for i, j in PAIRS]]
    return [F.sum(x).cast("double").alias(c) for x, c in zip(values, SUMS, strict=True)]


def moments_of(sums, n: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and mean sampling variances from a mapping of SUMS."""
    n = max(sums["n"], 1e-300)
    centre = np.array([sums[f"s{k}"] for k in range(P)]) / n
    cov = np.zeros((P, P))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = sums[f"m{i}_{j}"] / n - centre[i] * centre[j]
    return centre, cov, (NOISE_N * sums["a"] + NOISE_C * sums["b"]) / n


def raised(cov: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of cov, raised to the sampling variances in every direction."""
    scale = np.sqrt(noise)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    values = np.maximum(values, 1)
    return (vectors / values) @ vectors.T / np.outer(scale, scale), float(np.log(values).sum() + 2 * np.log(scale).sum())


def _model(g: str, k: int, centre: np.ndarray, cov: np.ndarray, noise: np.ndarray) -> dict:
    inverse, logdet = raised(cov, noise)
    return {"g": g, "k": k, "logdet": logdet, **dict(zip(CENTRE, centre, strict=True)), **{f"q{i}_{j}": inverse[i, j] for i, j in PAIRS}}


def _steps(v: np.ndarray, a: np.ndarray, b: np.ndarray, model: dict) -> dict:
    """Concentration steps from a model, until the determinant falls no more."""
    h = math.ceil(SUPPORT * len(v))
    while True:
        q = np.zeros((P, P))
        for i, j in PAIRS:
            q[i, j] = q[j, i] = model[f"q{i}_{j}"]
        d = v - np.array([model[c] for c in CENTRE])
        dist = ((d @ q) * d).sum(axis=1)
        edge = np.partition(dist, h - 1)[h - 1]
        w = (dist < edge).astype(float)
        w[dist == edge] = (h - w.sum()) / (dist == edge).sum()
        sums = dict(zip(SUMS, [w.sum(), w @ a, w @ b, *(w @ v), *(((v * w[:, None]).T @ v)[i, j] for i, j in PAIRS)], strict=True))
        centre, cov, noise = moments_of(sums)
        new = _model(model["g"], model["k"], centre, cov * consistency(SUPPORT), noise)
        if new["logdet"] >= model["logdet"] - 1e-9:
            return model
        model = new


def _dense(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of a group of LOCAL rows at most."""
    pdf = pdf.sort_values(V)
    v, a, b = pdf[V].to_numpy(), pdf["ia"].to_numpy(), pdf["ib"].to_numpy()
    lo, centre, hi = np.quantile(v, [0.25, 0.5, 0.75], axis=0)
    noise = NOISE_N * a.mean() + NOISE_C * b.mean()
    w = np.maximum((hi - lo) / 1.349, np.sqrt(noise))
    z = (v - centre) / w
    models = [_model(key[0], 0, centre, np.diag(w * w), noise)]
    for k, x in ((1, np.tanh(z)), (2, z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-9))):
        cov = np.cov(x.T, bias=True)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        models.append(_model(key[0], k, centre, cov / np.outer(sd, sd) * np.outer(w, w), noise))
    for k in (0, 1):  # every other row of the sorted ones
        half = z[k::2] if len(z) > 1 else z
        models.append(_model(key[0], 3 + k, centre + half.mean(axis=0) * w, np.cov(half.T, bias=True) * np.outer(w, w), noise))
    for m in models:
        m["logdet"] = math.inf  # of no subset yet
    best = min((_steps(v, a, b, m) for m in models), key=lambda m: (m["logdet"], m["k"]))
    return pd.DataFrame([best])[["g", *DOUBLES]]


def attached(x: DataFrame, model: DataFrame, how: str = "inner", few: bool | None = None) -> DataFrame:
    """x with the columns of model (g, ...), which is written: broadcast while it is small, else by salted
    keys; few: whether it is known to be small."""
    if model.count() <= BROADCAST_MODELS if few is None else few:
        return x.join(F.broadcast(model), "g", how)
    x = x.withColumn("_salt", F.pmod(F.xxhash64(*V), F.lit(SALTS)).cast("int"))
    model = model.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return x.join(model, ["g", "_salt"], how).drop("_salt")


def grouped(x: DataFrame) -> DataFrame:
    """x with g, whose model judges the row: its language and source where they have MIN_ROWS rows that
    pass the fixed rules, else its language where that has, else all; and with feeds, the models that
    rest on the row. A model of a language or of all rests on all of its rows, and is made where some
    group needs it."""
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    x = x.withColumn("g", F.concat_ws("\x01", F.length(lang), lang, source)).withColumn("_l", lang)
    sizes = x.groupBy("g", "_l").agg(F.count_if(~F.col("base_failed")).alias("_n"))
    langs = sizes.groupBy("_l").agg(F.sum("_n").alias("_m"), F.min("_n").alias("_least"))
    fewest = langs.agg(F.min("_m")).first()[0] or 0
    own, ofl, all_ = F.concat(F.lit("s"), "g"), F.concat(F.lit("l"), "_l"), F.lit("all")
    large = F.col("_n") >= MIN_ROWS
    name = F.when(large, own).when(F.col("_m") >= MIN_ROWS, ofl).otherwise(all_)
    feeds = F.array_compact(F.array(
        F.when(large, own), F.when((F.col("_m") >= MIN_ROWS) & (F.col("_least") < MIN_ROWS), ofl), F.when(F.lit(fewest < MIN_ROWS), all_)
    ))
    names = materialize(sizes.join(langs, "_l").select("g", name.alias("name"), feeds.alias("feeds")))
    return attached(x.drop("_l"), names).drop("g").withColumnRenamed("name", "g")


def starts(x: DataFrame) -> DataFrame:
    """The models that the steps begin with, five for each group."""
    spots = [F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(f"p{k}") for k, v in enumerate(V)]
    spot = materialize(x.groupBy("g").agg(*spots, F.avg("ia").alias("a"), F.avg("ib").alias("b")))
    noise = [F.sqrt(F.col("a") * float(NOISE_N[k]) + F.col("b") * float(NOISE_C[k])) for k in range(P)]
    wide = [F.greatest((F.col(f"p{k}")[2] - F.col(f"p{k}")[0]) / 1.349, noise[k]) for k in range(P)]
    scale = spot.select("g", "a", "b", *[F.col(f"p{k}")[1].alias(f"c{k}") for k in range(P)], *[wide[k].alias(f"w{k}") for k in range(P)])
    z = attached(x, scale).select("g", "ia", "ib", *[((F.col(v) - F.col(f"c{k}")) / F.col(f"w{k}")).alias(v) for k, v in enumerate(V)])
    length = F.sqrt(reduce(lambda a, b: a + b, (F.col(v) * F.col(v) for v in V)))
    z = z.withColumn("_r", F.greatest(length, F.lit(1e-9)))
    kinds = {1: [F.tanh(v) for v in V], 2: [F.col(v) / F.col("_r") for v in V]}
    sums = [z.groupBy("g").agg(F.lit(k).alias("k"), *_sums(v)) for k, v in kinds.items()]
    sums.append(z.groupBy("g", (F.lit(3) + F.pmod(F.xxhash64(*V), F.lit(2))).cast("int").alias("k")).agg(*_sums([F.col(v) for v in V])))
    sums = reduce(DataFrame.unionByName, sums)
    joined = sums.join(scale.drop("a", "b"), "g")

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.to_dict("records"):
            centre, w = np.array([r[f"c{k}"] for k in range(P)]), np.array([r[f"w{k}"] for k in range(P)])
            mean, cov, noise = moments_of(r)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            if not rows:
                rows.append(_model(key[0], 0, centre, np.diag(w * w), noise))
            if r["k"] > 2:  # the moments themselves
                rows.append(_model(key[0], int(r["k"]), centre + mean * w, cov * np.outer(w, w), noise))
                continue
            rows.append(_model(key[0], int(r["k"]), centre, cov / np.outer(sd, sd) * np.outer(w, w), noise))
        out = pd.DataFrame(rows)
        out["logdet"] = np.inf  # of no subset yet
        return out

    out = materialize(joined.groupBy("g").applyInPandas(first, MODEL))
    discard(spot)
    return out


def _reach(exact: bool):
    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group's bins with its state -> its state with the bins that count whole, and the bounds of
        the one that holds the h-th row. Rows of one distance, or of the whole bin where it need not be
        exact, share what is left of h."""
        pdf = pdf.sort_values("lo_")
        state = {c: pdf[c].iloc[0] for c in CARRIED}
        if state["h"] < 0:
            state["h"] = state["need"] = float(math.ceil(SUPPORT * pdf["n_"].sum()))
        n = pdf["n_"].to_numpy()
        last = min(int(np.searchsorted(np.cumsum(n), state["need"], "left")), len(n) - 1)
        below, at = pdf.iloc[:last], pdf.iloc[last]
        state["need"] -= float(below["n_"].sum())
        whole = at["lo_"] == at["hi_"] or state["need"] >= at["n_"] or not exact
        share = state["need"] / at["n_"] if whole else 0.0
        for c in SUMS:
            state[c] += float(below[f"{c}_"].sum()) + share * float(at[f"{c}_"])
        state["lo"], state["hi"], state["inside"] = at["lo_"], at["hi_"], 0.0 if whole else at["n_"]
        state["need"] = 0.0 if whole else state["need"]
        return pd.DataFrame([state])

    return reach


def nearest(x: DataFrame, model: DataFrame, exact: bool = True, few: bool = True) -> DataFrame:
    """The state of each (g, k) of model with the SUMS of its h nearest rows."""
    first = {"h": -1.0, "lo": -1.0, "hi": math.inf}
    state = model.select("*", *[F.lit(first.get(c, 0.0)).alias(c) for c in CARRIED[len(DOUBLES) + 2 :]])
    scale = (BINS - 1) / math.log(1e12)
    bin_of = F.floor(F.log(F.greatest("dist", F.lit(1e-6)) / 1e-6) * scale)
    while True:
        todo = state.filter("h < 0 or need > 0")
        rows = attached(x, todo.drop(*SUMS), few=few).withColumn("dist", _distance()).filter("dist between lo and hi")
        bins = rows.groupBy("g", "k", bin_of.alias("bin")).agg(*[s.alias(f"{c}_") for s, c in zip(_sums([F.col(v) for v in V]), SUMS, strict=True)], F.min("dist").alias("lo_"), F.max("dist").alias("hi_"))
        new = bins.drop("bin").join(todo, ["g", "k"]).groupBy("g", "k").applyInPandas(_reach(exact), STATE)
        done = materialize(state.filter("h >= 0 and need = 0").unionByName(new))
        discard(state)
        state = done
        left = state.agg(F.max("inside")).first()[0] if exact else 0
        if not left:
            return state
        if left <= FEW:
            bin_of = F.col("dist")
        else:
            bin_of = F.floor((F.col("dist") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * BINS)


def _concentrated(fall: float):
    def concentrated(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """States -> models of the rows they sum; the old one, marked by a negative k, where its
        logarithmic determinant fell by no more than `fall`."""
        for pdf in pdfs:
            rows = []
            for r in pdf.to_dict("records"):
                centre, cov, noise = moments_of(r)
                new = _model(r["g"], int(r["k"]), centre, cov * consistency(SUPPORT), noise)
                if new["logdet"] >= r["logdet"] - fall:
                    new = {c: r[c] for c in ["g", *DOUBLES]} | {"k": -1 - int(r["k"])}
                rows.append(new)
            yield pd.DataFrame(rows, columns=["g", "k", *DOUBLES])

    return concentrated


def _settled(x: DataFrame, active: DataFrame, steps: int, exact: bool) -> DataFrame:
    """Concentration steps of the models in active until each has settled; the best of each group."""
    few, settled = active.count() <= BROADCAST_MODELS, []
    for _ in range(steps):
        state = nearest(x, active, exact, few)
        models = materialize(state.mapInPandas(_concentrated(1e-9 if exact else 1e-3), MODEL))
        discard(state)
        settled.append(models.filter("k < 0"))
        active = models.filter("k >= 0")
        if active.isEmpty():
            break
    every = reduce(DataFrame.unionByName, [*settled, active])
    best = every.groupBy("g").agg(F.min_by(F.struct(*DOUBLES), F.struct("logdet", "k")).alias("m"))
    return materialize(best.select("g", "m.*"))


def estimates(x: DataFrame, steps: int = STEPS, local: int = LOCAL) -> DataFrame:
    """x (g, ia, ib, v0, ...) -> the model of each group: centre c0.. and inverse covariance q0_0..,
    logdet of the covariance."""
    sizes = materialize(x.groupBy("g").agg((F.count("*") > local).alias("large")))
    x = attached(x, sizes)
    small = x.filter("not large").select("g", "ia", "ib", *V).groupBy("g").applyInPandas(_dense, MODEL.replace("k int, ", ""))
    if sizes.filter("large").isEmpty():
        return materialize(small)
    x = materialize(x.filter("large").select("g", "ia", "ib", *V))
    begun = _settled(x, starts(x), steps, False)
    again = begun.select("g", F.lit(0).alias("k"), F.lit(math.inf).alias("logdet"), *CENTRE, *FORM)
    out = materialize(small.unionByName(_settled(x, again, steps, True)))
    discard(x, begun)
    return out


def judged(docs: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id (of that kind), the base statistics, base_failed, distance, kept: one row per row of docs."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    rows = materialize(measured(docs, kind).withColumn("base_failed", failed))
    x = materialize(grouped(rows).drop("lang", "source"))
    discard(rows)
    fed = x.filter(~F.col("base_failed")).select(F.explode("feeds").alias("g"), *[(1 / F.greatest(c, F.lit(1))).alias(k) for c, k in (("n_words", "ia"), ("word_chars", "ib"))], *V)
    model = estimates(fed)
    far = F.coalesce(F.col("distance") > chi2_quantile(1 - ALPHA, P), F.lit(False))
    return attached(x, model, "left").withColumn("distance", _distance()).select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "distance"
    )


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs)


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject. Rows are judged one by one, whatever their doc_id;
    a verdict depends on text, language and source, by whose hash rows meet theirs."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("lang", "source"))
    text = F.coalesce("text", F.lit(""))
    row = F.unhex(F.md5(F.concat_ws("\x01", F.length(lang), F.length(source), lang, source, text)))
    good = judged(docs.withColumn("doc_id", row), "binary").filter("kept").select(F.col("doc_id").alias("hash")).distinct()
    rows = docs.select(row.alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(good, "hash", "left_semi").select("row.*")
