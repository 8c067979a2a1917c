"""Cleaning and encoding: from categorical cells to sparse one-hot attributes.

``cells`` has unit_id (long), pos (int, from 1) and value (string, null where missing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partita.operators.ranks import ranked
from partita.sources.scratch import written

#: Letters of sequence files in the order of their codes, from 1.
SEQUENCE_LETTERS = ("a", "c", "g", "t", "u", "r", "y", "k", "m", "s", "w", "b", "d", "h", "v", "n", "x", "-", "e", "f", "i", "l", "o", "p", "q", "z", "*", "j")
#: Letters that usually stand for missing data.
MISSING_DNA = ("-", "?", "*", "#", "b", "d", "h", "k", "m", "n", "r", "s", "v", "w", "x", "y")
MISSING_PROTEIN = ("-", "?", "*", "#", "b", "j", "x", "z")


class Dataset:
    """Encoded data: units (unit_id, uid), sites, attributes and ones (unit_id, attr_id).

    ``ones`` may be given as what makes them; they are made when they are first asked for.
    """

    def __init__(self, units: DataFrame, sites: DataFrame, attributes: DataFrame, ones: DataFrame | Callable[[], DataFrame]):
        self.units, self.sites, self.attributes, self._ones = units, sites, attributes, ones

    @property
    def ones(self) -> DataFrame:
        if not isinstance(self._ones, DataFrame):
            self._ones = self._ones()
        return self._ones


def clean(value: Column, miss: tuple[str, ...] | list[str] = ()) -> Column:
    """Trimmed and lower-cased; empty values and those in ``miss`` (in any case) become null."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(~text.isin(*sorted({m.lower() for m in miss} | {""})), text)


def normalise(cells: DataFrame, miss: tuple[str, ...] | list[str] = ()) -> DataFrame:
    return cells.select("unit_id", "pos", clean(F.col("value"), miss).alias("value"))


def value_counts(cells: DataFrame) -> DataFrame:
    """pos, value, n: what every later step on columns needs, in one shuffle with a map-side combine."""
    return cells.groupBy("pos", "value").agg(F.count("*").alias("n"))


def profile_sites(counts: DataFrame) -> DataFrame:
    """pos, n_values, n_present, is_poly from ``value_counts``: polymorphic with two or more values that are present."""
    here = F.col("value").isNotNull()
    values = F.sum(here.cast("long"))
    return counts.groupBy("pos").agg(values.alias("n_values"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n_present"), (values > 1).alias("is_poly"))


def alphabet(counts: DataFrame) -> DataFrame:
    """value and code (from 1): numbers in order if every value is one, else letters in order."""
    number = F.expr("try_cast(value AS double)")
    values = counts.where(F.col("value").isNotNull()).select("value").distinct()
    numeric = values.agg(F.coalesce(F.bool_and(number.isNotNull()), F.lit(False)).alias("numeric"))
    keyed = values.crossJoin(numeric).select("value", F.when(F.col("numeric"), number).alias("number"))  # one row beside each
    return ranked(keyed, ["number", "value"], "code").select("value", "code")


def sequence_alphabet(counts: DataFrame) -> DataFrame:
    """value and code of the letters of sequence files."""
    return counts.sparkSession.createDataFrame([(v, k) for k, v in enumerate(SEQUENCE_LETTERS, 1)], "value string, code int")


def attribute_dictionary(counts: DataFrame, sites: DataFrame, codes: DataFrame) -> DataFrame:
    """attr_id, site_key, pos, value, code: one for each value of each polymorphic site, by site and code."""
    poly = ranked(sites.where("is_poly").select("pos"), ["pos"], "site_key")
    seen = counts.where(F.col("value").isNotNull()).select("pos", "value").join(poly, "pos").join(codes, "value")
    return ranked(seen, ["pos", "code"], "attr_id").select("attr_id", "site_key", "pos", "value", F.col("code").cast("int").alias("code"))


def one_hot(cells: DataFrame, attributes: DataFrame) -> DataFrame:
    """unit_id and attr_id of every present value of a polymorphic site."""
    return cells.join(attributes.select("pos", "value", "attr_id"), ["pos", "value"]).select("unit_id", "attr_id")


def encode(cells: DataFrame, units: DataFrame | None = None, *, codes: str = "values") -> Dataset:
    """A data set from clean cells; ``codes`` is ``values`` (all values in order) or ``sequence`` (fixed letters).

    Counts, attributes and, when they are asked for, ones are written once; the cells are read for the counts and for
    the ones, and no more.
    """
    counts = written(value_counts(cells))
    sites = written(profile_sites(counts))
    letters = alphabet(counts) if codes == "values" else sequence_alphabet(counts)
    attributes = written(attribute_dictionary(counts, sites, letters))
    if units is None:
        units = cells.select("unit_id").distinct().select("unit_id", F.col("unit_id").cast("string").alias("uid"))
    return Dataset(units, sites, attributes, lambda: written(one_hot(cells, attributes)))


def decode(data: Dataset) -> DataFrame:
    """unit_id, pos, value of every unit and site; blank where the value is missing or the site has only one."""
    values = data.ones.join(data.attributes.select("attr_id", "pos", "value"), "attr_id").select("unit_id", "pos", "value")
    grid = data.units.select("unit_id").crossJoin(data.sites.select("pos"))
    return grid.join(values, ["unit_id", "pos"], "left").select("unit_id", "pos", F.coalesce("value", F.lit("")).alias("value"))


def validate(cells: DataFrame, *, letters: tuple[str, ...] | None = None, least_units: int = 2) -> DataFrame:
    """problem, unit_id, detail: units with another number of cells than most, letters outside the alphabet, too few units.

    Of numbers of cells that are equally common the smallest decides.
    """
    sizes = cells.groupBy("unit_id").agg(F.count("*").alias("n"))
    usual = sizes.agg(F.mode("n", True).alias("usual"), F.count("*").alias("units"))
    uneven = sizes.crossJoin(usual).where(F.col("n") != F.col("usual")).select(F.lit("length").alias("problem"), "unit_id", F.format_string("%d cells, others have %d", "n", "usual").alias("detail"))
    few = usual.where(F.col("units") < least_units).select(F.lit("units").alias("problem"), F.lit(None).cast("long").alias("unit_id"), F.format_string("%d units", "units").alias("detail"))
    out = uneven.union(few)
    if letters is not None:
        odd = cells.where(F.col("value").isNotNull() & ~F.col("value").isin(*letters))
        out = out.union(odd.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("value")), "").alias("detail")).select(F.lit("letters").alias("problem"), "unit_id", "detail"))
    return out


def require_valid(cells: DataFrame, **rules) -> None:
    """Raises an error that names the first offending units."""
    found = validate(cells, **rules).orderBy("problem", "unit_id").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}{'' if r.unit_id is None else f' of unit {r.unit_id}'}: {r.detail}" for r in found))
