"""Additive forecaster: trend with changepoints, seasonality and regressors.

After Taylor and Letham, "Forecasting at Scale" (2018), as a penalized regression
on a design matrix: Gaussian priors, and a Laplace prior on the trend changes, so
most of them are exactly 0. The noise is estimated by a first fit. One pass adds up
the design's Gram matrix, which serves both fits.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.operators.encode import indexer
from tripledger.operators.gram import summed_matrix

# Default settings and prior scales; all of them are parameters of the fit.
TREND_PRIOR = 5.0
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
REGRESSOR_PRIOR = 10.0
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
#: Design columns of a fit: its Gram matrix then takes 128 MB.
SOLVER_COLUMNS = 4096
#: Rows of the design matrix that a task writes out at once.
DESIGN_ROWS = 4096
#: Penalty of the first fit, which only estimates the noise.
SLIGHT = 1e-6
#: Sweeps of the coordinate descent between two tries to finish it exactly.
SWEEPS = 50
MAX_ROUNDS = 2_000
YEARLY = ("yearly", 365.25, 10)
WEEKLY = ("weekly", 7.0, 3)


@dataclass(frozen=True)
class Calendar:
    """What the features need to know about the training days."""

    first_day: int
    last_day: int
    changepoints: tuple[float, ...]
    seasons: tuple[tuple[str, float, int], ...]

    @property
    def span(self) -> int:
        return max(self.last_day - self.first_day, 1)


@dataclass(frozen=True)
class Settings:
    changepoints: int = CHANGEPOINTS
    changepoint_range: float = CHANGEPOINT_RANGE
    trend_prior: float = TREND_PRIOR
    changepoint_prior: float = CHANGEPOINT_PRIOR
    seasonality_prior: float = SEASONALITY_PRIOR
    regressor_prior: float = REGRESSOR_PRIOR
    seasons: tuple[tuple[str, float, int], ...] = (YEARLY, WEEKLY)
    #: Laplace prior on the trend changes; Gaussian like the others without it.
    sparse_trend: bool = True


def smallest_gap(days: Column) -> Column:
    """Smallest distance between neighbours of a sorted array, null below two entries."""
    return F.array_min(
        F.zip_with(
            F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))),
            F.slice(days, 1, F.greatest(F.size(days) - 1, F.lit(0))),
            lambda later, earlier: later - earlier,
        )
    )


def fit_calendar(train: DataFrame, settings: Settings = Settings()) -> Calendar:
    """Day range, changepoints and seasons of the training trips.

    Trips are counted per day first; everything else is derived from that
    table, which has at most one row per day of the calendar.
    """
    days = train.groupBy(F.unix_date("ds").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _calendar(days, settings)[0]


def _calendar(days: DataFrame, settings: Settings, *more: Column) -> tuple[Calendar, dict]:
    """The calendar of a table of days, and ``more`` aggregates of that table."""

    def fractions(number: int) -> list[float]:
        return [settings.changepoint_range * j / number for j in range(1, number + 1)]

    def points(number: int) -> Column:
        return F.percentile("day", fractions(number), F.col("n")).alias("points")

    facts = days.agg(
        F.sum("n").alias("n"),
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        smallest_gap(F.sort_array(F.collect_set("day"))).alias("gap"),
        points(max(settings.changepoints, 1)),
        *more,
    ).first()
    if (facts["n"] or 0) < 2:
        raise ValueError("the additive model needs at least two trips")
    history = facts["last"] - facts["first"]
    gap = facts["gap"] or 0
    wanted = {"yearly": history >= 730, "weekly": history >= 14 and 0 < gap < 7}
    # Fewer changepoints where the covered history has fewer rows.
    covered = math.floor(facts["n"] * settings.changepoint_range)
    number = max(min(settings.changepoints, covered - 1), 0) if history > 0 else 0
    found = facts["points"]
    if number != max(settings.changepoints, 1):
        found = days.agg(points(number)).first()["points"] if number else []
    calendar = Calendar(
        facts["first"],
        facts["last"],
        tuple(found),
        tuple(s for s in settings.seasons if wanted.get(s[0], True)),
    )
    return calendar, facts.asDict()


# The design columns are SQL text: a model has about a hundred of them, and one
# parsed array is far cheaper to plan than as many column objects.
DAY = "unix_date(ds)"


def sql_double(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def trend(calendar: Calendar) -> str:
    """Position in the training history: 0 at its first day, 1 at its last."""
    return f"({DAY} - {calendar.first_day}) / {sql_double(calendar.span)}"


def hinge(point: float, calendar: Calendar) -> str:
    """Trend time passed since a changepoint, 0 before it."""
    return f"greatest({sql_double(0)}, ({DAY} - {sql_double(point)}) / {sql_double(calendar.span)})"


def season(period: float, order: int) -> tuple[str, str]:
    """Sine and cosine of one harmonic; the phase counts from the epoch."""
    angle = f"{sql_double(2.0 * math.pi * order / period)} * {DAY}"
    return f"sin({angle})", f"cos({angle})"


@dataclass(frozen=True)
class Design:
    """How a trip or a request becomes a row of the design matrix."""

    calendar: Calendar
    mean: float
    spread: float
    y_scale: float
    labels: tuple[str, ...]
    settings: Settings

    def numeric(self) -> list[tuple[str, str, float]]:
        """Name, value and prior scale of every numeric column."""
        prior = self.settings
        out = [("trend", trend(self.calendar), prior.trend_prior)]
        for j, point in enumerate(self.calendar.changepoints, 1):
            out.append((f"hinge_{j}", hinge(point, self.calendar), prior.changepoint_prior))
        for name, period, orders in self.calendar.seasons:
            for order in range(1, orders + 1):
                sine, cosine = season(period, order)
                out.append((f"{name}_sin_{order}", sine, prior.seasonality_prior))
                out.append((f"{name}_cos_{order}", cosine, prior.seasonality_prior))
        duration = f"(duration - {sql_double(self.mean)}) / {sql_double(self.spread)}"
        out.append(("duration", duration, prior.regressor_prior))
        return out

    def column_names(self) -> list[str]:
        names = [name for name, _, _ in self.numeric()]
        return names + [f"{side}_{code}" for side in ("home", "dest") for code in self.labels]

    def priors(self) -> list[float]:
        slots = [self.settings.regressor_prior] * (2 * len(self.labels))
        return [scale for _, _, scale in self.numeric()] + slots

    def with_inputs(self, df: DataFrame) -> DataFrame:
        """Adds ``home_pos`` and ``dest_pos``, positions of the codes; unknown ones come last."""
        return indexer(self.labels).transform(df) if self.labels else df

    def gram(self, rows: DataFrame) -> np.ndarray:
        """Products of all design columns, a leading one and the target, summed over the rows."""
        return part_of(segment_grams(rows, [self], F.lit(0), 1)[0], [self], 0)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Design:
        raw = json.loads(text)
        calendar, settings = raw.pop("calendar"), raw.pop("settings")
        calendar["changepoints"] = tuple(calendar["changepoints"])
        for part in (calendar, settings):
            part["seasons"] = tuple((n, p, o) for n, p, o in part["seasons"])
        raw["labels"] = tuple(raw["labels"])
        return cls(calendar=Calendar(**calendar), settings=Settings(**settings), **raw)


def segment_grams(
    rows: DataFrame, designs: Sequence[Design], segment: Column, segments: int
) -> np.ndarray:
    """Gram matrices of several designs of one domain, side by side, for each segment of the rows.

    The columns are a one, the numbers of each design, the shared codes and the
    target in EUR. Tasks write the design matrix out a few thousand rows at a
    time; rows are read once however many designs and segments there are.
    """
    codes = len(designs[0].labels)
    values = [value for design in designs for _, value, _ in design.numeric()]
    numbers = len(values)
    size = 2 + numbers + 2 * codes
    inputs = designs[0].with_inputs(rows).select(
        segment.cast("int").alias("segment"),
        F.expr(f"array({', '.join(values)})").alias("numbers"),
        F.col("y").cast("double").alias("target"),
        *(F.col(f"{side}_pos").cast("int") for side in ("home", "dest") if codes),
    )

    def add(total: np.ndarray, batches: Iterable[pa.RecordBatch]) -> None:
        for batch in batches:
            for at in range(0, batch.num_rows, DESIGN_ROWS):
                part = batch.slice(at, DESIGN_ROWS)
                n = part.num_rows
                design = np.zeros((n, size))
                design[:, 0] = 1.0
                flat = part.column("numbers").flatten().to_numpy(zero_copy_only=False)
                design[:, 1 : 1 + numbers] = flat.reshape(n, numbers)
                for k, side in enumerate(("home", "dest") if codes else ()):
                    position = part.column(f"{side}_pos").to_numpy(zero_copy_only=False)
                    known = np.flatnonzero(position < codes)
                    design[known, 1 + numbers + k * codes + position[known]] = 1.0
                design[:, -1] = part.column("target").to_numpy(zero_copy_only=False)
                where = part.column("segment").to_numpy(zero_copy_only=False)
                for s in np.unique(where).tolist():
                    some = design[where == s]
                    total[s * size : (s + 1) * size] += some.T @ some

    return summed_matrix(inputs, (segments * size, size), add).reshape(segments, size, size)


def part_of(gram: np.ndarray, designs: Sequence[Design], number: int) -> np.ndarray:
    """One design's own matrix, its target scaled as the design has it."""
    counts = [len(design.numeric()) for design in designs]
    first = 1 + sum(counts[:number])
    own = [0, *range(first, first + counts[number]), *range(1 + sum(counts), len(gram))]
    out = gram[np.ix_(own, own)].copy()
    out[-1, :] /= designs[number].y_scale
    out[:, -1] /= designs[number].y_scale
    return out


@dataclass(frozen=True)
class Normal:
    """Centred normal equations of a design: what every fit of it needs."""

    n: float
    mean: np.ndarray
    target_mean: float
    products: np.ndarray
    right: np.ndarray
    square: float  # of the centred target

    @classmethod
    def of(cls, gram: np.ndarray) -> Normal:
        n = gram[0, 0]
        mean, total = gram[0, 1:-1] / n, gram[0, -1] / n
        return cls(
            n,
            mean,
            total,
            gram[1:-1, 1:-1] - n * np.outer(mean, mean),
            gram[1:-1, -1] - n * mean * total,
            max(gram[-1, -1] - n * total**2, 0.0),
        )

    def mean_squared_error(self, beta: np.ndarray) -> float:
        error = self.square - 2 * beta @ self.right + beta @ self.products @ beta
        return max(float(error), 0.0) / self.n

    def intercept(self, beta: np.ndarray) -> float:
        return float(self.target_mean - self.mean @ beta)

    def ridge(self, penalty: np.ndarray) -> np.ndarray:
        """Least squares plus ``penalty`` times the squared coefficients, column by column."""
        return np.linalg.solve(self.products + np.diag(penalty), self.right)

    def fit(self, penalty: np.ndarray, sparse: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Half the squared error plus half of ``penalty`` times the squares; for the columns
        where ``sparse``, ``threshold`` times the absolute value instead of the squares.

        The other columns are eliminated, as they follow from the sparse ones
        by linear equations; coordinate descent finds these.
        """
        rest = ~sparse
        own = self.products[np.ix_(rest, rest)] + np.diag(penalty[rest])
        cross = self.products[np.ix_(rest, sparse)]
        solved = np.linalg.solve(own, np.column_stack([cross, self.right[rest]]))
        products = self.products[np.ix_(sparse, sparse)] - cross.T @ solved[:, :-1]
        right = self.right[sparse] - cross.T @ solved[:, -1]
        beta = np.zeros(len(penalty))
        beta[sparse] = lasso((products + products.T) / 2, right, threshold[sparse])
        beta[rest] = solved[:, -1] - solved[:, :-1] @ beta[sparse]
        return beta


def lasso(products: np.ndarray, right: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Minimum of b'Pb / 2 - r'b + sum(t |b|) by coordinate descent.

    Every few sweeps the columns that are not 0 are solved for exactly; the
    search ends when that solution meets the conditions of the minimum.
    """
    size = len(right)
    beta = np.zeros(size)
    live = np.flatnonzero(np.diag(products) > 0)
    for _ in range(MAX_ROUNDS):
        for _ in range(SWEEPS):
            for j in live:
                rest = right[j] - products[j] @ beta + products[j, j] * beta[j]
                beta[j] = np.sign(rest) * max(abs(rest) - threshold[j], 0.0) / products[j, j]
        exact = _solved(products, right, threshold, beta)
        if meets_conditions(products, right, threshold, exact):
            return exact
        if meets_conditions(products, right, threshold, beta):
            return beta
    raise RuntimeError(f"the trend's fit did not converge in {MAX_ROUNDS * SWEEPS} sweeps")


def _solved(products, right, threshold, beta: np.ndarray) -> np.ndarray:
    """The same columns and signs as ``beta``, with the values that balance exactly."""
    out = np.zeros(len(beta))
    kept = np.flatnonzero(beta)
    if len(kept):
        signs = np.sign(beta[kept])
        some = products[np.ix_(kept, kept)]
        found = np.linalg.lstsq(some, right[kept] - threshold[kept] * signs, rcond=None)[0]
        out[kept] = np.where(np.sign(found) == signs, found, 0.0)
    return out


def meets_conditions(products, right, threshold, beta: np.ndarray, tol: float = 1e-7) -> bool:
    """Whether the error's slope equals the threshold where ``beta`` is not 0, and is less elsewhere."""
    slope = right - products @ beta
    room = tol * (threshold + np.abs(right).max(initial=0.0) * 1e-6) + 1e-300
    apart = np.abs(slope - np.sign(beta) * threshold)
    return bool(np.all(np.where(beta != 0, apart <= room, np.abs(slope) <= threshold + room)))


@dataclass(frozen=True)
class AdditiveModel:
    """A design with the effect of each of its columns, in units of the scaled target."""

    design: Design
    intercept: float
    weights: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``additive``, the point forecast in EUR: arithmetic and two lookups by country."""
        numeric = self.design.numeric()
        parts = [sql_double(self.intercept)]
        parts += [f"({v}) * {sql_double(w)}" for (_, v, _), w in zip(numeric, self.weights) if w]
        codes = len(self.design.labels)
        for k, side in enumerate(("home", "dest") if codes else ()):
            start = len(numeric) + k * codes
            slots = ", ".join(map(sql_double, (*self.weights[start : start + codes], 0.0)))
            parts.append(f"get(array({slots}), CAST({side}_pos AS INT))")
        additive = F.expr(" + ".join(parts)) * F.lit(self.design.y_scale)
        return self.design.with_inputs(df).select(*df.columns, additive.alias("additive"))

    def coefficients(self) -> list[tuple[str, float]]:
        """Effect of each design column, in units of the scaled target."""
        return [
            ("intercept", self.intercept),
            *zip(self.design.column_names(), self.weights, strict=True),
        ]


def day_facts(rows: DataFrame, *keys: Column) -> DataFrame:
    """What a design needs to know of the trips, for each day and key."""
    return rows.groupBy(*keys, F.unix_date("ds").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs("y")).alias("largest"),
        F.sum(F.col("duration").cast("double")).alias("d"),
        F.sum(F.col("duration").cast("double") ** 2).alias("dd"),
        F.count("duration").alias("known"),
    )


def design_of(days: DataFrame, labels: Sequence[str], settings: Settings) -> Design:
    """The design of the trips that ``day_facts`` describes; a day may have several rows."""
    calendar, facts = _calendar(
        days,
        settings,
        F.max("largest").alias("y_scale"),
        F.sum("d").alias("d"),
        F.sum("dd").alias("dd"),
        F.sum("known").alias("known"),
    )
    y_scale, known = float(facts["y_scale"] or 1.0), facts["known"]
    mean = (facts["d"] or 0.0) / known if known else 0.0
    squares = (facts["dd"] or 0.0) - known * mean**2
    spread = math.sqrt(max(squares, 0.0) / (known - 1)) if known > 1 else 0.0
    # A constant duration is used as it is.
    if spread <= 1e-9 * max(abs(mean), 1.0):
        mean, spread = 0.0, 1.0
    design = Design(calendar, mean, spread, y_scale, tuple(labels), settings)
    if len(design.priors()) > SOLVER_COLUMNS:
        raise ValueError(
            f"{len(design.priors())} design columns; the normal equations take {SOLVER_COLUMNS} at most"
        )
    return design


def solved(design: Design, gram: np.ndarray) -> AdditiveModel:
    """Both fits of a design from its Gram matrix: the noise, then the model."""
    priors = np.array(design.priors())
    normal = Normal.of(gram)
    beta = normal.ridge(SLIGHT / priors**2)
    noise = normal.mean_squared_error(beta)
    if noise > 0 and normal.square > 0:
        sparse = np.array([n.startswith("hinge_") for n in design.column_names()])
        sparse &= design.settings.sparse_trend
        if sparse.any():
            beta = normal.fit(noise / priors**2, sparse, noise / priors)
        else:
            beta = normal.ridge(noise / priors**2)
    return AdditiveModel(design, normal.intercept(beta), tuple(beta.tolist()))


def fit_additive(
    train: DataFrame, labels: Sequence[str], settings: Settings = Settings()
) -> AdditiveModel:
    """Fit on trips with a known total.

    The noise is the residual variance of a nearly unpenalized first fit. Two
    passes: one over days and totals for the design, one for its Gram matrix,
    from which both fits follow on the driver.
    """
    rows = train.filter(F.col("y").isNotNull())
    design = design_of(day_facts(rows), labels, settings)
    return solved(design, design.gram(rows))
