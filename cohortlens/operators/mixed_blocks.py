"""Mixed logistic models over packed clusters: every pass solves the conditional modes where the rows are.

Patterns are hashed to partitions by cluster once and packed into rows that each hold whole clusters as flat arrays.
A pass is then one map over those rows for all models of a sweep: no join, no shuffle and no state between passes,
because the modes of a cluster follow from the parameters alone.

Two kinds of blocks share one format.  Wide blocks hold every outcome and design column and serve all models.  For a
model whose covariates have few values, clusters with the same patterns and counts are one profile: its own blocks
hold each profile once, with the number of clusters that have it.

Blocks are staged uncompressed in small row groups, every column in its smallest exact type, so the size of a file
split bounds what a task holds in memory.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.staging import stage
from cohortlens.functions.sums import array_sums

BLOCKS = "model int, clusters binary, houses binary, times binary, kinds string, data binary"
PROFILES = "model int, kinds string, profile binary, times long"
#: The number of wide blocks in the column ``model``.
WIDE = -1
#: A split reads whole row groups, and the writer holds one; binary rows are long, so sizes are checked at every row.
BOUNDED = {
    "compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}
#: How a column of small whole numbers holds a missing value.
GAP = -128
#: Smallest deviation of a random effect; one that the data drive below it rests there.
SD_FLOOR = 1e-3


def _narrowed(values: np.ndarray) -> np.ndarray:
    """``values`` in the smallest type that holds them exactly: whole numbers of a byte with gaps as ``GAP``, or floats."""
    gap = np.isnan(values)
    small = np.where(gap, GAP, values)
    if np.abs(small[~gap]).max(initial=0) < -GAP and np.array_equal(small, np.rint(small)):
        return small.astype("i1")
    with np.errstate(over="ignore"):
        single = values.astype("<f4")
    return single if np.array_equal(single.astype(float), values, equal_nan=True) else values.astype("<f8")


def _block(model: int, clusters: np.ndarray, houses: np.ndarray, times: np.ndarray, columns: list[np.ndarray]) -> dict:
    """``clusters``: of each household; ``houses``: of each pattern; ``times``: of each cluster; then n, outcomes, design."""
    narrow = [_narrowed(c) for c in columns]
    return {
        "model": model, "clusters": clusters.astype("<i4").tobytes(), "houses": houses.astype("<i4").tobytes(),
        "times": times.astype("<i8").tobytes(), "kinds": "".join(c.dtype.str[1:] for c in narrow),
        "data": b"".join(c.tobytes() for c in narrow),
    }


def _wide(table: DataFrame, outcomes: list[Column], columns: list[Column]) -> DataFrame:
    """Cluster, household, count, outcomes and design columns as numbers; whole clusters in order in every partition."""
    names = [f"y{i}" for i in range(len(outcomes))] + [f"x{i}" for i in range(len(columns))]
    wide = table.select(
        "_cluster", "_household", F.col("_n").cast("double").alias("_n"),
        *[c.cast("double").alias(name) for c, name in zip([*outcomes, *columns], names)],
    )
    return wide.repartition("_cluster").sortWithinPartitions("_cluster", "_household")


def _whole_clusters(batches: Iterator[pd.DataFrame], block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Stretches of about ``block_rows`` rows: cluster of each household, household of each row, columns from ``_n`` on."""

    def numbered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        new = {}
        for level in ("_cluster", "_household"):
            values = rows[level].to_numpy()
            new[level] = np.r_[True, values[1:] != values[:-1]]
        first = np.flatnonzero(new["_cluster"] | new["_household"])
        house = np.cumsum(new["_cluster"] | new["_household"]) - 1
        cluster = (np.cumsum(new["_cluster"]) - 1)[first]
        return cluster, house, [rows[c].to_numpy(dtype=float) for c in rows.columns[2:]]

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < block_rows:
            continue
        rows = pd.concat(held, ignore_index=True)
        # the last cluster may go on in the next batch
        same = (rows["_cluster"] == rows["_cluster"].iloc[-1]).to_numpy()
        cut = len(rows) - int(same.sum())
        if cut:
            yield numbered(rows.iloc[:cut])
        held, size = [rows.iloc[cut:]], len(rows) - cut
    if size:
        yield numbered(pd.concat(held, ignore_index=True))


def pack(table: DataFrame, outcomes: list[Column], columns: list[Column], block_rows: int = 50_000) -> DataFrame:
    """Whole clusters as rows of flat arrays, staged.

    ``table`` has ``_cluster``, ``_household`` and ``_n``; every block holds the cluster number of each household, the
    household number of each pattern, counts, the outcomes and the design columns, missing ones as NaN.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cluster, house, values in _whole_clusters(batches, block_rows):
            yield pd.DataFrame([_block(WIDE, cluster, house, np.ones(cluster[-1] + 1), values)])

    return stage(_wide(table, outcomes, columns).mapInPandas(run, BLOCKS), BOUNDED)


def block_profiles(
    cluster: np.ndarray, n: np.ndarray, ys: list[np.ndarray], xs: list[np.ndarray], models: dict[int, tuple[int, list[int]]]
) -> Iterator[tuple[int, str, bytes]]:
    """(model, kinds, profile) of every cluster in a stretch: its distinct patterns in order, as records of n, y and x.

    ``models`` has the outcome and the design columns of each; rows that miss one of them are left out of the model.
    """
    ranks = {j: np.unique(xs[j], return_index=True, return_inverse=True)[1:] for _, columns in models.values() for j in columns}
    sides: dict[tuple, tuple] = {}
    for model, (outcome, columns) in models.items():
        side = tuple(columns)
        if side not in sides:
            code = np.zeros(len(n), dtype=np.int64)
            for j in columns:
                first, rank = ranks[j]
                code = np.unique(code * len(first) + rank, return_inverse=True)[1]
            first = np.unique(code, return_index=True)[1]
            sides[side] = code, first, np.logical_or.reduce([np.isnan(xs[j]) for j in columns])
        code, first, gap = sides[side]
        levels, level = np.unique(ys[outcome], return_inverse=True)
        used = ~(gap | np.isnan(ys[outcome]))
        if not used.any():
            continue
        cells, cell = np.unique(((cluster * len(first) + code) * len(levels) + level)[used], return_inverse=True)
        which = first[cells // len(levels) % len(first)]
        values = [np.bincount(cell, n[used]), levels[cells % len(levels)], *[xs[j][which] for j in columns]]
        values = [_narrowed(v) for v in values]
        records = np.empty(len(cells), dtype=[(str(i), v.dtype) for i, v in enumerate(values)])
        for i, v in enumerate(values):
            records[str(i)] = v
        owner = cells // (len(levels) * len(first))
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) * records.itemsize
        raw, name = records.tobytes(), "".join(v.dtype.str[1:] for v in values)
        bounds = starts.tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield model, name, raw[a:b]


def profiles(
    table: DataFrame, outcomes: list[Column], columns: list[Column], models: dict[int, tuple[int, list[int]]],
    block_rows: int = 50_000, held_bytes: int = 32 << 20,
) -> DataFrame:
    """Blocks of the distinct cluster profiles of each model, staged.

    Equal profiles are counted in the task first, as far as ``held_bytes`` go, and then over all tasks.
    """
    k = len(outcomes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        size = 0

        def frames() -> Iterator[pd.DataFrame]:
            rows = [(*key, times) for key, times in held.items()]
            for i in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[i : i + 10_000], columns=["model", "kinds", "profile", "times"])

        for cluster, house, (n, *values) in _whole_clusters(batches, block_rows):
            before = len(held)
            for key in block_profiles(cluster[house], n, values[:k], values[k:], models):
                held[key] += 1
                if len(held) > before:
                    before += 1
                    size += len(key[2]) + 200
            if size > held_bytes:
                yield from frames()
                held.clear()
                size = 0
        yield from frames()

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
        sizes: Counter = Counter()

        def block(key: tuple[int, str]) -> pd.DataFrame:
            found, times = held.pop(key)
            del sizes[key]
            model, kinds = key
            record = np.dtype([(str(i), f"<{kinds[2 * i : 2 * i + 2]}") for i in range(len(kinds) // 2)])
            records = np.frombuffer(b"".join(found), record)
            house = np.repeat(np.arange(len(found)), [len(f) // record.itemsize for f in found])
            values = [records[name].astype(float) for name in record.names]
            return pd.DataFrame([_block(model, np.arange(len(found)), house, np.array(times), values)])

        for batch in batches:
            for model, kinds, profile, times in zip(batch.model.tolist(), batch.kinds, batch.profile, batch.times.tolist()):
                key = model, kinds
                found, counts = held[key]
                found.append(profile)
                counts.append(times)
                sizes[key] += 2 * len(profile) // len(kinds)
                if sizes[key] >= block_rows:
                    yield block(key)
        for key in list(held):
            yield block(key)

    found = _wide(table, outcomes, columns).mapInPandas(count, PROFILES)
    distinct = found.groupBy("model", "kinds", "profile").agg(F.sum("times").alias("times"))
    return stage(distinct.mapInPandas(bundle, BLOCKS), BOUNDED)


@dataclass
class Spec:
    """One model of a sweep: its outcome and design columns in the blocks, and the parameters of the next pass.

    ``model`` is the number of its own blocks of profiles; without one it reads the wide blocks.
    """

    key: str
    outcome: int
    columns: list[int]
    beta: np.ndarray
    sd: np.ndarray
    model: int = WIDE


def _by(code: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` per code."""
    if values.ndim == 1:
        return np.bincount(code, values, size)
    return np.column_stack([np.bincount(code, v, size) for v in values.T])


def _modes(fixed, n, y, house, cluster, b, c) -> tuple[np.ndarray, np.ndarray]:
    """Conditional modes (v per cluster, u per household) by joint Newton steps.

    A cluster rests when it has settled, so its modes do not depend on its neighbours in the block to the last digit.
    """
    n_clusters, n_houses = int(cluster[-1]) + 1, len(cluster)
    v, u = np.zeros(n_clusters), np.zeros(n_houses)
    total = _by(house, n_houses, n * y)
    moving = np.ones(n_clusters, dtype=bool)
    for _ in range(60):
        eta = fixed + (b * v[cluster] + c * u)[house]
        mu = 1 / (1 + np.exp(-eta))
        m = n * mu
        w, g = _by(house, n_houses, m - m * mu), total - _by(house, n_houses, m)
        d = 1 + c * c * w
        ru = c * g - u
        a, cg = _by(cluster, n_clusters, w / d), _by(cluster, n_clusters, g)
        cwr = _by(cluster, n_clusters, w * ru / d)
        dv = (b * cg - v - b * c * cwr) / (1 + b * b * a)
        du = (ru - c * b * w * dv[cluster]) / d
        # far from the mode the curvature says little, so the predictor moves by two at most
        v += np.where(moving, np.clip(dv, -2 / max(b, 1e-9), 2 / max(b, 1e-9)), 0.0)
        u += np.where(moving[cluster], np.clip(du, -2 / max(c, 1e-9), 2 / max(c, 1e-9)), 0.0)
        moving &= (np.abs(dv) >= 1e-9) | (_by(cluster, n_clusters, np.abs(du) >= 1e-9) > 0)
        if not moving.any():
            break
    return v, u


def joint_sums(h: dict[str, np.ndarray], b: float, c: float, times: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
    """Global sums for one joint step, from household rows that carry their cluster's sums and count ``times`` each.

    The log determinant of a cluster is L = Σ log D_h + log(1 + b² A) with D_h = 1 + c² W_h and
    A = Σ W_h / D_h; q_h below is its derivative in W_h.  Derivatives of the modes follow from
    differentiating their estimating equations.  Of the rows' residuals and curvatures times x only Σ (r - q_h dq / 2) is
    needed: ``direct`` gives it for given q_h, or else the household sums ``r`` and ``q`` do.
    """
    w, g, t, u, v = (h[k] for k in ("w", "g", "t", "u", "v"))
    s, big_s, a = (h[k] for k in ("s", "cs", "ca"))
    weight = np.broadcast_to(np.asarray(times, dtype=float), w.shape)
    d, e = 1 + c * c * w, 1 + b * b * a
    one = 1.0 / h["ch"]  # share of the cluster carried by this household
    q = c * c / d + b * b / e / d**2
    ru = c * g - u
    rv = b * h["cg"] - v - b * c * h["cwr"]
    # modes in beta: dv = -b S / e, du = -(c s + b c W dv) / D
    dv = -b * big_s / e[:, None]
    du = -(c * s + b * c * w[:, None] * dv) / d[:, None]
    # through the rows at fixed modes, then through the modes
    direct = h["direct"](q) if "direct" in h else weight @ h["r"] - 0.5 * (weight * q) @ h["q"]
    grad = direct - 0.5 * ((weight * q * t) @ (b * dv + c * du))
    schur = -(s * (times * c * c / d)[:, None]).T @ s - (big_s * (times * one * b * b / e)[:, None]).T @ big_s
    back = s * (c * ru / d)[:, None] + big_s * (one * b * rv / e)[:, None]
    # modes in b: direct change v of the predictor, plus Σ g in the equation of v
    wu, gg = h["cwu"], h["cg"]
    dvb = (gg - b * v * a) / e
    dub = -(c * w * (v + b * dvb)) / d
    lb = 2 * b * a / e * one
    gb = v * g - 0.5 * lb - 0.5 * q * t * (v + b * dvb + c * dub)
    # modes in c: direct change u, plus g in the equation of u
    wg = h["cwgd"]
    dvc = (-b * (wu + c * wg)) / e
    duc = (g - c * w * u - b * c * w * dvc) / d
    w2 = w * w / d**2
    lc = 2 * c * w / d - b * b / e * 2 * c * w2
    gc = u * g - 0.5 * lc - 0.5 * q * t * (u + b * dvc + c * duc)
    ll = h["l"] - 0.5 * u * u - 0.5 * one * v * v
    ll = ll - 0.5 * np.log(d) - 0.5 * one * np.log(e)
    # expected information about the log variances
    ib, ic = 0.5 * one * (b * b * a / e) ** 2, 0.5 * (c * c * w / d) ** 2
    return {
        "ll": np.array([weight @ x for x in (ll, one, gb, gc, ib, ic)]), "grad": grad,
        "back": weight @ back, "schur": schur.ravel(),
        "mode": np.array([weight @ (ru * ru + one * rv * rv)]),
    }


@dataclass
class _Block:
    """An opened block; columns become numbers where a model asks for them."""

    model: int
    clusters: np.ndarray
    houses: np.ndarray
    times: np.ndarray
    kinds: str
    data: memoryview

    def columns(self, positions: list[int]) -> list[np.ndarray]:
        rows = len(self.houses)
        kinds = [np.dtype(f"<{self.kinds[i : i + 2]}") for i in range(0, len(self.kinds), 2)]
        at = np.r_[0, np.cumsum([rows * k.itemsize for k in kinds])]
        out = []
        for i in positions:
            held = np.frombuffer(self.data, kinds[i], rows, int(at[i]))
            out.append(held.astype(float))
            if held.dtype.itemsize == 1 and held.min() == GAP:
                out[-1][held == GAP] = np.nan
        return out


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    """The blocks of a batch, without a copy of their arrays."""
    of = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        whole = [np.frombuffer(of[name][i].as_buffer(), kind) for name, kind in (("clusters", "<i4"), ("houses", "<i4"), ("times", "<i8"))]
        yield _Block(of["model"][i].as_py(), *whole, of["kinds"][i].as_py(), memoryview(of["data"][i].as_buffer()))


@dataclass
class _Solved:
    """The rows of a block that a model uses, at the conditional modes; ``x`` has a row for each coefficient."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    house: np.ndarray
    cluster: np.ndarray
    times: np.ndarray
    v: np.ndarray
    u: np.ndarray
    eta: np.ndarray


def _solved(block: _Block, spec: Spec, n_outcomes: int) -> _Solved | None:
    first = 1 + (n_outcomes if block.model == WIDE else 1)
    n, y, *columns = block.columns([0, 1 + spec.outcome, *[first + i for i in spec.columns]])
    x, houses = np.stack(columns), block.houses
    # a maximum is missing where one value is
    gaps = [np.isnan(c) for c in (y, *x) if np.isnan(c.max())]
    if gaps:
        used = ~np.logical_or.reduce(gaps)
        if not used.any():
            return None
        n, y, x, houses = n[used], y[used], x[:, used], houses[used]
    # households and clusters are in order, so their numbers change where the next one begins
    new = np.r_[True, houses[1:] != houses[:-1]]
    house, clusters = np.cumsum(new) - 1, block.clusters[houses[new]]
    begins = np.r_[True, clusters[1:] != clusters[:-1]]
    cluster, times = np.cumsum(begins) - 1, block.times[clusters[begins]].astype(float)
    b, c = (float(s) for s in spec.sd)
    # term by term: equal rows have an equal predictor, wherever they stand
    fixed = np.zeros(len(y))
    for coefficient, column in zip(spec.beta, x):
        fixed += coefficient * column
    v, u = _modes(fixed, n, y, house, cluster, b, c)
    return _Solved(x, y, n, house, cluster, times, v, u, fixed + (b * v[cluster] + c * u)[house])


def block_sums(block: _Block, spec: Spec, n_outcomes: int) -> np.ndarray:
    """Log-likelihood, clusters, gradients and information of one model over one block, as a flat vector."""
    p = len(spec.columns)
    got = _solved(block, spec, n_outcomes)
    if got is None:
        return np.zeros(6 + p + 2 * p * p)
    x, y, n, house, cluster, v, u, eta = got.x, got.y, got.n, got.house, got.cluster, got.v, got.u, got.eta
    b, c = (float(s) for s in spec.sd)
    mu = 1 / (1 + np.exp(-eta))
    row_w, row_g = n * mu * (1 - mu), n * (y - mu)
    row_t = row_w * (1 - 2 * mu)
    # log(1 + exp(eta)), from whichever probability is not small
    soft = np.maximum(eta, 0) - np.log(np.maximum(mu, 1 - mu))
    size, clusters = len(cluster), int(cluster[-1]) + 1
    w, g = _by(house, size, row_w), _by(house, size, row_g)
    d = 1 + c * c * w
    weighted = x * row_w
    s = np.column_stack([np.bincount(house, row, size) for row in weighted])
    spread = lambda values: _by(cluster, clusters, values)[cluster]
    times = got.times[cluster]
    h = {
        "w": w, "g": g, "t": _by(house, size, row_t), "u": u, "v": v[cluster], "s": s,
        "l": _by(house, size, n * (y * eta - soft)), "ch": spread(np.ones(size)),
        "cg": spread(g), "ca": spread(w / d), "cwr": spread(w * (c * g - u) / d), "cwu": spread(w * u / d),
        "cwgd": spread(w * g / d), "cs": spread(s / d[:, None]),
        "direct": lambda q: x @ (times[house] * row_g - 0.5 * (times * q)[house] * row_t),
    }
    sums = joint_sums(h, b, c, times)
    if np.any(got.times != 1):
        weighted *= times[house]
    xwx = weighted @ x.T
    return np.concatenate([sums["ll"], sums["grad"], sums["schur"], xwx.ravel()])


def _read_by(blocks: DataFrame, specs: list[Spec]) -> DataFrame:
    return blocks.where(F.col("model").isin(sorted({spec.model for spec in specs})))


def fitted(blocks: DataFrame, specs: list[Spec], n_outcomes: int) -> DataFrame:
    """(model_id, y, p_hat, n) of every pattern at the conditional modes; lazy, one map over the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                for spec in specs:
                    got = _solved(block, spec, n_outcomes) if spec.model == block.model else None
                    if got is None:
                        continue
                    times = got.times[got.cluster][got.house]
                    key = pa.array(np.zeros(len(got.y), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.DictionaryArray.from_arrays(key, [spec.key]).dictionary_decode(), pa.array(got.y),
                         pa.array(1 / (1 + np.exp(-got.eta))), pa.array(got.n * times)],
                        names=["model_id", "y", "p_hat", "n"],
                    )

    return _read_by(blocks, specs).mapInArrow(run, "model_id string, y double, p_hat double, n double")


def one_pass(blocks: DataFrame, specs: list[Spec], n_outcomes: int) -> dict[str, np.ndarray]:
    """``block_sums`` of every model, added up over all blocks."""

    def sums(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for block in _blocks(batch):
            for spec in specs:
                if spec.model == block.model:
                    out[spec.key] = out.get(spec.key, 0.0) + block_sums(block, spec, n_outcomes)
        return out

    return array_sums(_read_by(blocks, specs), sums, arrow=True)


class Search:
    """Quasi-Newton search of one model over its coefficients and log deviations.

    The first curvature is the information of the coefficients and the expected information of the variances; BFGS
    updates it with every pass.  A pass that loses likelihood halves the step.  It ends when no coefficient would move
    by a thousandth of its error and no log variance by a thousandth of its own.
    """

    def __init__(self, spec: Spec, nested: bool):
        self.spec, self.p = spec, len(spec.beta)
        self.free = np.r_[np.ones(self.p, bool), True, nested]
        self.at = np.r_[spec.beta, np.log(np.maximum(spec.sd, SD_FLOOR))]
        self.best: np.ndarray | None = None
        self.loglik, self.steps, self.converged, self.clusters = -np.inf, 0, False, 0
        self.information = np.zeros((self.p, self.p))

    def take(self, sums: np.ndarray, tol: float) -> bool:
        p = self.p
        self.steps += 1
        sd = self.spec.sd
        gradient = np.r_[sums[6 : 6 + p], sums[2:4] * sd]
        if self.best is not None and not sums[0] >= self.loglik - 1e-10 * abs(self.loglik):
            self.step = self.step / 2
            if np.abs(self.step * self.free).max() < 1e-10:
                return True
            return self._go()
        schur, xwx = sums[6 + p : 6 + p + p * p].reshape(p, p), sums[6 + p + p * p :].reshape(p, p)
        self.information = xwx + schur
        if self.best is None:
            self.inverse = np.zeros((p + 2, p + 2))
            self.inverse[:p, :p] = np.linalg.pinv(self.information, hermitian=True)
            # information about a log deviation is four times that about a log variance
            self.inverse[[p, p + 1], [p, p + 1]] = 1 / np.maximum(4 * sums[4:6], 1e-6)
        else:
            moved, turned = self.at - self.best, self.gradient - gradient
            along = moved @ turned
            if along > 1e-12:
                left = np.eye(p + 2) - np.outer(moved, turned) / along
                self.inverse = left @ self.inverse @ left.T + np.outer(moved, moved) / along
        self.best, self.gradient, self.loglik, self.clusters = self.at, gradient, sums[0], sums[1]
        low = (self.best[p:] <= np.log(SD_FLOOR) + 1e-12) & (gradient[p:] <= 0)
        move = self.free & np.r_[np.ones(p, bool), ~low]
        inverse = np.where(np.outer(move, move), self.inverse, 0.0)
        self.step = inverse @ gradient
        error = np.sqrt(np.maximum(np.diag(inverse), 1e-300))
        if np.all(np.abs(self.step[move]) < tol * error[move]):
            self.converged = True
            return True
        self.step *= min(1.0, 1.5 / max(np.abs(self.step).max(), 1e-300))
        return self._go()

    def _go(self) -> bool:
        at = self.best + self.step
        at[self.p :] = np.maximum(at[self.p :], np.log(SD_FLOOR))
        self._set(at)
        return False

    def _set(self, at: np.ndarray) -> None:
        self.at = at
        self.spec.beta = at[: self.p]
        self.spec.sd = np.where(self.free[self.p :], np.exp(at[self.p :]), 0.0)

    def settle(self) -> None:
        """Leave the parameters at the best place found."""
        self._set(self.best)


def search(blocks: DataFrame, searches: list[Search], n_outcomes: int, max_steps: int, tol: float) -> None:
    """Run all searches together, one pass over the blocks a step."""
    running = list(searches)
    for _ in range(max_steps):
        sums = one_pass(blocks, [s.spec for s in running], n_outcomes)
        running = [s for s in running if not s.take(sums[s.spec.key], tol)]
        if not running:
            break
    for s in searches:
        s.settle()
