"""Cell-level result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import joins
from ..functions import terms as t
from .states import with_score


def analysed_cells(counts: DataFrame, linker: DataFrame | None = None, cell_list: DataFrame | None = None) -> DataFrame:
    """Cells that are listed, observed or in a set."""
    out = counts.select(*t.CELL)
    for more in (linker, cell_list):
        if more is not None:
            out = out.unionByName(more.select(*t.CELL))
    return joins.dealt(out, t.CELL, counts.count()).distinct()


def _each_once(cells: DataFrame) -> DataFrame:
    """The cells of a list, dealt by its rows: the tables that meet it are dealt like it."""
    return joins.dealt(cells.select(*t.CELL), t.CELL, cells.count()).distinct()


def choose_cell_list(linker: DataFrame | None, explicit: DataFrame | None) -> tuple[DataFrame | None, str]:
    """The cell list in force and where it came from. None is not an empty list: membership is then unknown."""
    if explicit is not None:
        return explicit.select(*t.CELL).distinct(), "cell list"
    if linker is not None:
        return linker.select(*t.CELL).distinct(), "clonotype linker"
    return None, "none"


def in_cell_list(cells: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """Adds `inCellList`: "true" or "false", "unknown" without a list."""
    if cell_list is None:
        return cells.withColumn("inCellList", F.lit("unknown"))
    marks = _each_once(cell_list).withColumn("inCellList", F.lit("true"))
    return joins.shuffled_join(cells, marks, t.CELL, "left").withColumn("inCellList", F.coalesce("inCellList", F.lit("false")))


def cell_list_table(cell_list: DataFrame | None, like: DataFrame) -> DataFrame:
    """(sampleId, cellId, "true") for every listed cell; empty without a list."""
    source = like.filter(F.lit(False)) if cell_list is None else cell_list
    return source.select(*t.CELL).distinct().withColumn("inCellList", F.lit("true"))


def listed(df: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """The rows of listed cells; all rows without a list."""
    return df if cell_list is None else joins.shuffled_join(df, _each_once(cell_list), t.CELL, "left_semi")


def cell_counts(floored: DataFrame, refs: DataFrame, reference: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """Floored counts without reference tags, with the cell's reference reading and list membership."""
    own = floored.join(refs.select("tag").distinct(), "tag", "left_anti")
    joined = own.join(reference.select(*t.CELL, "referenceCount"), t.CELL, "left")
    return in_cell_list(joined, cell_list).select(*t.CELL, "tag", "umiCount", "referenceCount", "inCellList")


def cell_raw_counts(counts: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """Raw counts of listed cells, reference tags included."""
    return listed(counts, cell_list).select(*t.CELL, "tag", "umiCount")


def cell_tag_pivot(raw: DataFrame, tags: list[str]) -> DataFrame:
    """One row per cell, a column per tag."""
    return raw.groupBy(*t.CELL).pivot("tag", sorted(tags)).agg(F.first("umiCount"))


def cell_scalars(admissibility: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """(sampleId, cellId, referenceCount, admissibility, inCellList) of every analysed cell."""
    return in_cell_list(admissibility, cell_list)


def cell_background(scalars: DataFrame, cell_list: DataFrame | None) -> DataFrame:
    """The reference reading of listed cells."""
    return listed(scalars, cell_list).select(*t.CELL, "referenceCount")


def cell_score(states: DataFrame, cell_list: DataFrame | None, source: str = "declared") -> DataFrame:
    """The score of every reliable listed reading; only the declared baseline has one."""
    if source != "declared":
        return with_score(states.filter(F.lit(False))).select(*t.CELL, "identity", "score")
    return with_score(listed(states, cell_list)).select(*t.CELL, "identity", "score")
