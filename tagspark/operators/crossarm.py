"""Do the arms of an experiment fit together: reads, receptor chains, expression and the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import joins
from ..functions import terms as t
from . import reads as R

# fixed values: expected gene ids and the marker genes of antigen-specific plasma cells
GENE_ID = r"^ENSG\d{11}$"
PLASMA_MARKERS = ["ENSG00000170476", "ENSG00000100219", "ENSG00000057657", "ENSG00000004468", "ENSG00000048462"]
HEAVY, LIGHT = "IGH", "IGK"


def recount_from_reads(reads: DataFrame, panel: DataFrame, geometry: R.Geometry, small: bool | None = None) -> DataFrame:
    """(sampleId, cellId, feature, umiCount): distinct molecules recounted from the reads; `panel` is (tag, feature)."""
    mols = R.molecules(R.extract_tags(reads, geometry))
    named = panel.select(F.col("tag").alias("code"), F.col("feature").alias("antigen")).distinct()
    # two barcodes of one antigen may share a molecule id, which is then one molecule of the antigen
    antigens = joins.lookup(mols.withColumnRenamed("FEATURE", "code"), named, ["code"], "inner", small)
    return (
        antigens.select("sampleId", F.col("CELL").alias("cellId"), "antigen", "UMI").distinct()
        .groupBy("sampleId", "cellId", F.col("antigen").alias("feature")).agg(F.count(F.lit(1)).alias("umiCount"))
    )


def read_geometry_report(reads: DataFrame, panel: DataFrame, geometry: R.Geometry, small: bool | None = None) -> DataFrame:
    """(sampleId, reads, geometryOk, offPanel, cells)."""
    g = geometry
    exact = (F.length("r1") == g.cell + g.umi) & (F.length("r2") >= g.offset + g.feature)
    cut = reads.select(
        "sampleId",
        F.coalesce(exact, F.lit(False)).alias("ok"),
        F.substring("r1", 1, g.cell).alias("CELL"),
        F.substring("r2", g.offset + 1, g.feature).alias("FEATURE"),
    )
    merged = cut.groupBy("sampleId", "CELL", "FEATURE").agg(F.count(F.lit(1)).alias("n"), F.min("ok").alias("ok"))
    marks = panel.select(F.col("tag").alias("FEATURE")).distinct().withColumn("on", F.lit(True))
    per_cell = (
        joins.lookup(merged, marks, ["FEATURE"], "left", small)
        .groupBy("sampleId", "CELL")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("on").isNull(), F.col("n")).otherwise(0)).alias("off"), F.min("ok").alias("ok"))
    )
    return per_cell.groupBy("sampleId").agg(
        F.sum("n").cast("bigint").alias("reads"),
        F.min("ok").alias("geometryOk"),
        F.sum("off").cast("bigint").alias("offPanel"),
        F.count(F.lit(1)).alias("cells"),
    )


def chain_faults(chains: DataFrame) -> DataFrame:
    """(sampleId, chains, badJunction, badCount, badGene) over receptor chains."""
    junction_ok = F.coalesce(F.col("junction").rlike("^[ACGT]*$") & (F.length("junction") % 3 == 0), F.lit(False))
    count_ok = F.coalesce(F.expr("try_cast(duplicate_count as bigint) >= 1"), F.lit(False))
    gene_ok = ~F.col("locus").isin(HEAVY, LIGHT) | F.col("v_call").startswith(F.col("locus"))
    return chains.groupBy("sampleId").agg(
        F.count(F.lit(1)).alias("chains"),
        F.count_if(~junction_ok).alias("badJunction"),
        F.count_if(~count_ok).alias("badCount"),
        F.count_if(~F.coalesce(gene_ok, F.lit(False))).alias("badGene"),
    )


def set_key_from_chains(chains: DataFrame, position: str = "position") -> DataFrame:
    """(sampleId, cellId, setKey): the cell's first heavy and first light chain; an unpaired cell has a null key."""

    def first(locus: str):
        value = F.concat_ws("|", "v_call", "j_call", "junction")
        return F.min_by(F.when(F.col("locus") == locus, value), F.when(F.col("locus") == locus, F.col(position)))

    pairs = chains.groupBy("sampleId", F.col("cell_id").alias("cellId")).agg(first(HEAVY).alias("h"), first(LIGHT).alias("l"))
    return pairs.select(*t.CELL, F.when(F.col("h").isNotNull() & F.col("l").isNotNull(), F.concat_ws("|", "h", "l")).alias("setKey"))


def linker_from_chains(chains: DataFrame, position: str = "position") -> DataFrame:
    """The linker of the paired cells."""
    keyed = set_key_from_chains(chains, position).filter("setKey is not null")
    return keyed.select(*t.CELL, F.substring(F.sha2("setKey", 256), 1, 12).alias("setId"))


def unpaired_cells(keys: DataFrame) -> DataFrame:
    """(sampleId, cells, unpaired)."""
    return keys.groupBy("sampleId").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("setKey").isNull()).alias("unpaired"))


def long_expression(wide: DataFrame, gene_column: str, sample: str) -> DataFrame:
    """(sampleId, gene, cellId, value) from genes in rows; a `-N` suffix of a cell is dropped."""
    cells = [c for c in wide.columns if c != gene_column]
    pairs = F.array(*[F.struct(F.lit(c.split("-")[0]).alias("cellId"), F.col(f"`{c}`").cast("string").alias("value")) for c in cells])
    return wide.select(F.lit(sample).alias("sampleId"), F.col(f"`{gene_column}`").alias("gene"), F.explode(pairs).alias("p")).select(
        "sampleId", "gene", F.col("p.cellId").alias("cellId"), F.col("p.value").alias("value")
    )


def expression_cells(expression: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """(sampleId, cellId, total, markerMean, badValues, badGenes) per cell of a long expression table."""
    markers = PLASMA_MARKERS if markers is None else markers
    value = F.expr("try_cast(value as bigint)")
    is_marker = F.col("gene").isin(markers)
    bad = value.isNull() | (value < 0)
    return expression.withColumn("cellId", F.regexp_replace("cellId", r"-.*$", "")).groupBy(*t.CELL).agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.avg(F.when(is_marker, value)), F.lit(0.0)).alias("markerMean"),
        F.count_if(bad).alias("badValues"),
        F.count_if(~F.col("gene").rlike(GENE_ID)).alias("badGenes"),
    )


def expression_checks(per_cell: DataFrame) -> DataFrame:
    """(sampleId, cells, geneIdsOk, valuesOk, noEmptyCell)."""
    return per_cell.groupBy("sampleId").agg(
        F.count(F.lit(1)).alias("cells"),
        (F.sum("badGenes") == 0).alias("geneIdsOk"),
        (F.sum("badValues") == 0).alias("valuesOk"),
        (F.min("total") > 0).alias("noEmptyCell"),
    )


def arm_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sampleId, onlyFirst, onlySecond, both): cells each arm holds, from one grouping of the two arms' cells."""
    arms = a.select(*t.CELL, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*t.CELL, F.lit(0).alias("x"), F.lit(1).alias("y")))
    cells = arms.groupBy(*t.CELL).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return cells.groupBy("sampleId").agg(
        F.count_if(F.col("x") > F.col("y")).alias("onlyFirst"),
        F.count_if(F.col("y") > F.col("x")).alias("onlySecond"),
        F.count_if((F.col("x") == 1) & (F.col("y") == 1)).alias("both"),
    )


def set_dominant_tag(counts: DataFrame, linker: DataFrame) -> DataFrame:
    """(setId, dominantTag, umiCount): the tag with the most molecules over the set's cells; ties by name."""
    summed = counts.join(linker, t.CELL).groupBy("setId", "tag").agg(F.sum("umiCount").cast("bigint").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("r"), "tag")).alias("best")
    return summed.groupBy("setId").agg(first).select("setId", F.col("best.tag").alias("dominantTag"), (-F.col("best.r")).alias("umiCount"))


def set_marker_mean(per_cell: DataFrame, linker: DataFrame) -> DataFrame:
    """(setId, cells, markerMean): mean marker expression of a set's cells; a cell without expression counts as 0."""
    return (
        linker.join(per_cell.select(*t.CELL, "markerMean"), t.CELL, "left")
        .groupBy("setId")
        .agg(F.count(F.lit(1)).alias("cells"), F.avg(F.coalesce("markerMean", F.lit(0.0))).alias("markerMean"))
    )


def marker_contrast(set_means: DataFrame, planted: DataFrame, clear: list[str]) -> DataFrame:
    """(kind, sets, markerMean): marker expression of sets planted on one clear antigen against ambiguous ones.

    `planted` is (setId, planted), one row per distinct planted value of a set's cells.
    """
    kinds = planted.groupBy("setId").agg(F.min("planted").alias("low"), F.max("planted").alias("high"))
    kind = F.when(F.col("low") != F.col("high"), None).when(F.col("low").isin(clear), "binder").when(F.col("low") == "ambiguous", "ambiguous")
    return (
        kinds.withColumn("kind", kind).filter("kind is not null").join(set_means, "setId")
        .groupBy("kind").agg(F.count(F.lit(1)).alias("sets"), F.avg("markerMean").alias("markerMean"))
    )
