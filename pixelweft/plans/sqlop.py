"""Operators as relational plans over pixel tables.

A raster is a table (image_id, x, y, band, v). An operator is a Python function that writes one SELECT over its inputs; it
runs on DataFrames through spark.sql, where Catalyst plans it, and renders as text for another engine to check it with.
Functions that differ between engines are written through a dialect.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame


#: Tasks that few rows are dealt to where each of them becomes many.
TASKS = 96


class Dialect:
    """Names and forms that Spark and DuckDB do not share; this class is Spark's."""

    name = "spark"

    def rint(self, e) -> str:
        return f"rint({e})"

    def xor(self, a, b) -> str:
        return f"(({a}) ^ ({b}))"

    def long(self, e) -> str:
        """Whole number of a value that is one."""
        return f"CAST({e} AS BIGINT)"

    def series(self, low, high, column: str) -> str:
        """Whole numbers low .. high - 1 as a subquery with one column."""
        return f"(SELECT CAST(id AS INT) AS {column} FROM range({low}, {high}))"

    def sorted_list(self, e) -> str:
        return f"array_sort(collect_list({e}))"

    def item(self, array, index) -> str:
        """Element of an array, counted from 0; null beyond its end."""
        return f"get({array}, CAST({index} AS INT))"

    def block(self, factor, n) -> str:
        """Side of blocks along n pixels: no more than all of these."""
        return f"least({factor}, {n})"

    def spread(self, rows: str) -> str:
        """Subquery of few rows that many are made of, dealt to tasks before these are made."""
        return f"(SELECT /*+ REPARTITION({TASKS}) */ * FROM {rows} dealt)"

    def end(self, e, over: Callable[[str], str], last: bool = False) -> str:
        """Value of the first or last row of a window; `over` writes the window with a frame. The frame is the whole partition, which is looked at once."""
        return f"{'last' if last else 'first'}_value({e}) OVER {over(' ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING')}"

    def shift_left(self, a, n) -> str:
        return f"shiftleft({a}, {n})"

    def shift_right(self, a, n) -> str:
        return f"shiftright({a}, {n})"

    def arg_max(self, value, key) -> str:
        return f"max_by({value}, {key})"

    def array(self, items) -> str:
        return f"array({', '.join(items)})"

    def sorted_present(self, array) -> str:
        """Elements of an array that are not null, in ascending order."""
        return f"array_sort(filter({array}, e -> e IS NOT NULL))"

    def length(self, array) -> str:
        return f"cardinality({array})"

    def expand(self, rows: str, count: str, column: str) -> str:
        """Subquery: each row once for every whole number below count, which is in `column`."""
        n = f"CAST({count} AS INT)"
        return f"(SELECT t.*, explode(CASE WHEN {n} > 0 THEN sequence(0, {n} - 1) ELSE array() END) AS {column} FROM {rows} t)"

    def looked_up(self, rows: str, joins: dict[str, str], values: dict[str, str]) -> tuple[str, dict[str, str]]:
        """FROM of rows p joined with tables one after the other, and the expression of each one's value; a value takes the place of what it is looked up in before the next join."""
        for n, join in joins.items():
            rows = f"(SELECT p.*, {values[n]} AS at_{n} FROM {rows} p {join})"
        return f"{rows} p", {n: f"p.at_{n}" for n in joins}

    # the same in both

    def u8_trunc(self, e) -> str:
        """Clamp to 0..255 and drop the fraction."""
        return f"CAST(floor(greatest(0e0, least(255e0, {e}))) AS DOUBLE)"

    def u8_round(self, e) -> str:
        """Round half to even, then clamp."""
        return f"CAST(greatest(0e0, least(255e0, {self.rint(e)})) AS DOUBLE)"

    def div(self, a, b) -> str:
        """Whole quotient of values that are not negative."""
        return f"floor(({a}) / ({b}))"

    def num(self, x: float) -> str:
        """A double literal."""
        text = f"{float(x)!r}"
        return text if "e" in text else text + "e0"

    def luma601(self, r, g, b) -> str:
        return self.div(f"299 * {r} + 587 * {g} + 114 * {b} + 500", "1000e0")


class DuckDialect(Dialect):
    name = "duckdb"

    def rint(self, e) -> str:
        return f"round_even(CAST({e} AS DOUBLE), 0)"

    def xor(self, a, b) -> str:
        return f"xor({a}, {b})"

    def series(self, low, high, column: str) -> str:
        return f"(SELECT CAST(range AS INTEGER) AS {column} FROM range(CAST({low} AS BIGINT), CAST({high} AS BIGINT)))"

    def sorted_list(self, e) -> str:
        return f"list_sort(list({e}))"

    def item(self, array, index) -> str:
        return f"({array})[CAST({index} AS INTEGER) + 1]"

    def block(self, factor, n) -> str:
        return factor

    def spread(self, rows: str) -> str:
        return rows

    def end(self, e, over: Callable[[str], str], last: bool = False) -> str:
        frame = "CURRENT ROW AND UNBOUNDED FOLLOWING" if last else "UNBOUNDED PRECEDING AND CURRENT ROW"
        return f"{'last' if last else 'first'}_value({e}) OVER {over(f' ROWS BETWEEN {frame}')}"

    def looked_up(self, rows: str, joins: dict[str, str], values: dict[str, str]) -> tuple[str, dict[str, str]]:
        return f"{rows} p {' '.join(joins.values())}", values

    def shift_left(self, a, n) -> str:
        return f"(({a}) << ({n}))"

    def shift_right(self, a, n) -> str:
        return f"(({a}) >> ({n}))"

    def arg_max(self, value, key) -> str:
        return f"arg_max({value}, {key})"

    def array(self, items) -> str:
        return f"[{', '.join(items)}]"

    def sorted_present(self, array) -> str:
        return f"list_sort(list_filter({array}, lambda e: e IS NOT NULL))"

    def length(self, array) -> str:
        return f"len({array})"

    def expand(self, rows: str, count: str, column: str) -> str:
        return f"(SELECT t.*, CAST(unnest(range(CAST({count} AS BIGINT))) AS INTEGER) AS {column} FROM {rows} t)"


SPARK, DUCKDB = Dialect(), DuckDialect()


class Operator:
    """Called with DataFrames it returns a DataFrame; `sql` renders the same plan over named inputs or subqueries."""

    def __init__(self, write: Callable[..., str], inputs: int):
        functools.update_wrapper(self, write)
        self.write, self.inputs = write, inputs

    def __call__(self, *frames: DataFrame, spark=None, **how) -> DataFrame:
        if len(frames) != self.inputs:
            raise TypeError(f"{self.__name__} takes {self.inputs} tables, not {len(frames)}")
        names = [f"t{i}" for i in range(len(frames))]
        text = self.write(SPARK, *("{" + n + "}" for n in names), **how)
        session = frames[0].sparkSession if frames else spark
        return session.sql(text, **dict(zip(names, frames)))

    def sql(self, *inputs: str, dialect: Dialect = DUCKDB, **how) -> str:
        return self.write(dialect, *inputs, **how)


def operator(inputs: int = 1):
    return lambda write: Operator(write, inputs)


KEY = "image_id, x, y, band"


def size_of(r: str) -> str:
    """Subquery (image_id, w, h): the sizes of the images of a raster, whose pixels are all there."""
    return f"(SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {r} GROUP BY image_id)"


def sized(r: str) -> str:
    """Subquery of the pixels of a raster with w and h of their image."""
    return f"(SELECT p.image_id, p.x, p.y, p.band, p.v, s.w, s.h FROM {r} p JOIN {size_of(r)} s ON s.image_id = p.image_id)"


def canvas(d: Dialect, r: str, width: str = "w", height: str = "h") -> str:
    """Subquery (image_id, band, w, h, ox, oy): the places of an output of these sizes for every image and band of a raster."""
    bands = f"(SELECT k.image_id, k.band, s.w, s.h FROM (SELECT DISTINCT image_id, band FROM {r}) k JOIN {size_of(r)} s ON s.image_id = k.image_id)"
    return d.expand(d.expand(bands, width, "ox"), height, "oy")


def point(expression: Callable[..., str]) -> Operator:
    """A pointwise operator: expression(dialect, **how) gives the new v from v, x, y and band."""
    def write(d, r, **how):
        return f"SELECT {KEY}, {expression(d, **how)} AS v FROM {r}"

    return Operator(functools.wraps(expression)(write), 1)


def pair(expression: Callable[..., str]) -> Operator:
    """Of two aligned images: expression gives v from l.v and q.v. The key includes image_id; see `as_image`."""
    def write(d, left, right, **how):
        return f"SELECT {', '.join(f'l.{k}' for k in KEY.split(', '))}, {expression(d, **how)} AS v FROM {left} l JOIN {right} q ON l.image_id = q.image_id AND l.x = q.x AND l.y = q.y AND l.band = q.band"

    return Operator(functools.wraps(expression)(write), 2)


def pel(r: str, bands: int) -> str:
    """Subquery (image_id, x, y, v0, v1, ...) of a raster: one aggregate by place."""
    return f"(SELECT image_id, x, y, {', '.join(f'max(CASE WHEN band = {b} THEN v END) AS v{b}' for b in range(bands))} FROM {r} GROUP BY image_id, x, y)"


def unpel(pels: str, values: list[str], where: str = "") -> str:
    """Rows by band of a subquery of pels: one cross join with the bands, which stay in the row's task."""
    cases = " ".join(f"WHEN {b} THEN CAST({v} AS DOUBLE)" for b, v in enumerate(values))
    bands = ", ".join(f"({b})" for b in range(len(values)))
    return f"SELECT image_id, x, y, band, CASE band {cases} END AS v FROM {pels} p CROSS JOIN (VALUES {bands}) AS bands(band) {where}"


def cross_band(bands: int):
    """An operator across bands: expression(dialect, **how) gives a list of new bands from v0, v1, ..."""
    def wrap(expression: Callable[..., list[str]]) -> Operator:
        def write(d, r, **how):
            return unpel(pel(r, bands), expression(d, **how))

        return Operator(functools.wraps(expression)(write), 1)

    return wrap


@operator(1)
def as_image(d, r, source: int = 0, image: int = 0) -> str:
    """One image of a raster under another number, so that it can be paired."""
    return f"SELECT {image} AS image_id, x, y, band, v FROM {r} WHERE image_id = {source}"
