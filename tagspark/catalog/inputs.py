"""Readers, writers and key translation."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import functions as F

from ..operators import keys as K
from ..operators import panels as P
from ..operators import quality as Q
from ..operators import reads as R
from ..plans import roles
from ..sources import sinks, tables
from ..sources.panel import read_panel
from .base import Bed, query, rounded


def _folder(spark, name: str) -> str:
    return f"{sinks.shared_dir(spark)}/io-{uuid.uuid4().hex}/{name}"


@query('SELECT "sampleId", "cellId", tag, "umiCount", "totalWeight" FROM counts')
def counts_read(spark, sf):
    """Counts written as text with padded keys and read back typed and stripped."""
    path = _folder(spark, "counts.csv")
    padded = roles.counts(spark, sf).withColumn("tag", F.concat(F.lit(" "), "tag", F.lit("\t")))
    padded.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_counts(spark, path)


@query('SELECT "sampleId", "cellId", "setId" FROM linker')
def linker_read(spark, sf):
    path = _folder(spark, "linker.csv")
    roles.linker(spark, sf).write.option("header", True).csv(path)
    return tables.read_keys(spark, path, ["sampleId", "cellId", "setId"], "linker file")


@query("""SELECT "sampleId", "cellId" AS "CELL", tag AS "FEATURE", "totalWeight" AS count, "totalWeight" * 2 AS "totalWeight", "umiCount" AS "unique_UMI" FROM counts""")
def tag_stat_read(spark, sf):
    """Each sample's statistics written tab-separated and read with a declared schema."""
    stat, out = sinks.stage(roles.tag_statistics(spark, sf), "tagstat"), None
    for row in roles.samples(spark, sf).orderBy("sampleId").collect():
        path = _folder(spark, "tagstat.tsv")
        stat.filter(F.col("sampleId") == row["sampleId"]).drop("sampleId").write.options(header=True, sep="\t").csv(path)
        read = tables.read_tag_stat(spark, path, row["sampleId"])
        out = read if out is None else out.unionByName(read)
    return out


@query("SELECT tag, sample, feature, role, family, coalesce(lot, '') AS lot FROM panel")
def panel_read(spark, sf):
    """The panel file with a row that has no barcode, read with its roles."""
    path = _folder(spark, "panel.csv")
    rows = roles.panel_rows(spark, sf).drop("_row")
    blank = rows.limit(1).withColumn("Sequence", F.lit("  "))
    sinks.write_sorted(rows.unionByName(blank), path, ["Sequence", "Samples"])
    return read_panel(spark, path, roles.ROLES).frame.withColumn("lot", F.coalesce("lot", F.lit("")))


@query('SELECT "sampleId", "FEATURE", "totalWeight" FROM raw')
def raw_feature_counts_read(spark, sf):
    path = _folder(spark, "raw.csv")
    R.raw_feature_stat(R.molecules(roles.tagged_reads(spark, sf))).drop("count").write.option("header", True).csv(path)
    return tables.read_raw_feature_counts(spark, path)


class BedReads:
    """The demonstration reads and what is counted of them. Reads and molecules are written once, however many figures follow."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @cached_property
    def tagged(self):
        return roles.tagged_reads(self.spark, self.sf)

    @cached_property
    def molecules(self):
        return sinks.stage(R.molecules(self.tagged), "molecules")

    @cached_property
    def panel(self):
        return sinks.stage(roles.coded_panel(self.spark, self.sf), "panel").select("sampleId", "tag")

    @cached_property
    def read_qc(self):
        """The per-sample read figures."""
        mols = self.molecules
        placed = sinks.stage(R.correct_to_panel(mols, self.panel), "placed")
        refine = R.refine_report([("CELL", mols, mols), ("FEATURE", mols, placed)])
        return sinks.stage(Q.read_qc(R.tag_stat(placed), R.parse_report(self.tagged), refine), "read-qc")

    @property
    def marked_sequences(self):
        """Sequences before correction, marked where the panel declares them."""
        return Q.undeclared_sequences(R.raw_feature_stat(self.molecules), self.panel)


def bed_read_qc(spark, sf):
    """The per-sample read figures of the demonstration reads."""
    return BedReads(spark, sf).read_qc


_QC_SHARES = ["matchedFraction", "panelAssignedFraction", "featureDroppedShare", "cellBarcodeValidFraction", "aggregateBarcodeFraction", "aggregateBarcodeThreshold"]
_QC_NUMBERS = ["readsTotal", "readsMatched", "cellsDetected", "featuresDetected", "totalUniqueUmis", "medianUmisPerCell", "cellBarcodeIn", "cellBarcodeOut", "aggregateBarcodesFlagged"]
_QC_SQL = f"""SELECT "sampleId", {", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _QC_NUMBERS)}, {", ".join(f'round("{c}", 6) AS "{c}"' for c in _QC_SHARES)} FROM readqc"""


@query(_QC_SQL)
def read_qc_read(spark, sf):
    path = _folder(spark, "qc.csv")
    sinks.write_sorted(bed_read_qc(spark, sf), path, ["sampleId"])
    return rounded(tables.read_read_qc(spark, path), *_QC_SHARES).select("sampleId", *_QC_NUMBERS, *_QC_SHARES)


@query('SELECT "sampleId", total, matched FROM parse')
def parse_report_read(spark, sf):
    """Wrapped JSON reports, one per sample."""
    path = _folder(spark, "parse.json")
    report = R.parse_report(roles.tagged_reads(spark, sf))
    report.select("sampleId", F.struct("total", "matched").alias("parseReport")).write.option("maxRecordsPerFile", 1).json(path)
    return tables.read_parse_reports(spark, path)


@query("""SELECT "sampleId", "tagName", "inputCount", "outputCount" FROM refine""")
def refine_report_read(spark, sf):
    path = _folder(spark, "refine.json")
    mols = R.molecules(roles.tagged_reads(spark, sf))
    panel = roles.coded_panel(spark, sf).select("sampleId", "tag")
    report = R.refine_report([("CELL", mols, mols), ("FEATURE", mols, R.correct_to_panel(mols, panel))])
    step = F.struct("tagName", "inputCount", "outputCount")
    report.groupBy("sampleId").agg(F.collect_list(step).alias("steps")).write.option("maxRecordsPerFile", 1).json(path)
    return tables.read_refine_reports(spark, path)


@query('SELECT "sampleId", "cellId", tag, "umiCount", true AS "inOrder" FROM counts')
def sorted_write(spark, sf):
    """Written in key order and read back: each row follows the one before it in its file, and each file the last."""
    from pyspark.sql.window import Window

    path = _folder(spark, "sorted.csv")
    keys = ["sampleId", "cellId", "tag"]
    sinks.write_sorted(roles.counts(spark, sf).select(*keys, "umiCount"), path, keys)
    back = spark.read.option("header", True).csv(path).select("*", "_metadata.file_name", F.monotonically_increasing_id().alias("at"))
    whole = F.struct(*keys)
    ends = back.groupBy("file_name").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    before = F.max("last").over(Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("file_name", F.coalesce(F.col("first") > before, F.lit(True)).alias("follows"))
    previous = F.lag(whole).over(Window.partitionBy("file_name").orderBy("at"))
    return back.withColumn("up", F.coalesce(whole > previous, F.lit(True))).join(starts, "file_name").select(
        *keys, F.col("umiCount").cast("bigint").alias("umiCount"), (F.col("up") & F.col("follows")).alias("inOrder")
    )


@query("""SELECT "sampleId", '{"matched":' || matched || ',"total":' || total || '}' AS json FROM parse""")
def json_report_write(spark, sf):
    """Records written with their fields in name order."""
    path = _folder(spark, "report.json")
    sinks.write_json_report(R.parse_report(roles.tagged_reads(spark, sf)), path)
    back = spark.read.schema("sampleId string, total bigint, matched bigint").json(path)
    return sinks.json_line(back, ["sampleId"])


@query("""SELECT "sampleId", "cellId", tag, "umiCount", "totalWeight" * 2 AS "totalWeight" FROM counts""")
def samples_gathered(spark, sf):
    """One table from a folder per sample."""
    stat, folder = roles.tag_statistics(spark, sf), _folder(spark, "tagstat")
    names = [r[0] for r in roles.samples(spark, sf).collect()]
    number = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, f"{i}.parquet")]), F.col("sampleId"))
    stat.withColumn("file", number).drop("sampleId").write.partitionBy("file").parquet(folder)
    columns = {"CELL": "cellId", "FEATURE": "tag", "unique_UMI": "umiCount", "totalWeight": "totalWeight"}
    return tables.gather_samples(spark, {s: f"{folder}/file={i}.parquet" for i, s in enumerate(names)}, columns)


_RECORDS = {
    "verdicts": ("verdicts WHERE state <> 'never asked'", ["setId", "identity"], {"state": "state", "cellsAsked": '"cellsAsked"', "cellsBound": '"cellsBound"', "cellsNotBound": '"cellsNotBound"'}),
    "setCounts": ("""(SELECT "setId", count(*) FILTER (WHERE state = 'bound') AS b, count(*) FILTER (WHERE state <> 'never asked') AS o FROM verdicts GROUP BY 1)""", ["setId"], {"boundCount": "b", "offeredCount": "o"}),
    "offered": ("offered", ["sampleId", "identity"], {}),
    "cellInList": ("listed", ["sampleId", "cellId"], {}),
    "tagIdentity": ("(SELECT DISTINCT tag, identity FROM grp)", ["tag", "identity"], {}),
    "cellRawCounts": ('counts k JOIN listed l USING ("sampleId", "cellId")', ["sampleId", "cellId", "tag"], {"umiCount": '"umiCount"'}),
    "cellBackground": ('ref f JOIN listed l USING ("sampleId", "cellId")', ["sampleId", "cellId"], {"referenceCount": '"referenceCount"'}),
    "cellCardRows": ('dense d JOIN states s USING ("sampleId", "cellId", identity)', ["sampleId", "cellId", "identity"], {"cellState": "d.state", "reason": "d.reason"}),
    "cellCardCells": ('linker l JOIN ref f USING ("sampleId", "cellId")', ["setId", "sampleId", "cellId"], {"reason": """CASE WHEN f."referenceCount" > 40 THEN 'cell set aside by the sticky cell limit' END"""}),
}


def _record_sql(table: str) -> str:
    """A table's rows as texts: its key, and what it holds beside it."""
    source, keys, held = _RECORDS[table]
    text = lambda parts: " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts) or "''"
    return f"""SELECT '{table}' AS "table", {text(k if k in ("tag", "identity") else f'"{k}"' for k in keys)} AS key, {text(held.values())} AS held FROM {source}"""


@query(" UNION ALL ".join(map(_record_sql, _RECORDS)))
def result_tables(spark, sf):
    """Tables of a whole run, row by row: the key and what is held beside it."""
    made = whole_run(Bed(spark, sf)).tables()
    out = None
    for name, (_, keys, held) in _RECORDS.items():
        text = lambda columns: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]) if columns else F.lit("")
        rows = made[name].select(F.lit(name).alias("table"), text(keys).alias("key"), text(list(held)).alias("held"))
        out = rows if out is None else out.unionByName(rows)
    return out


def whole_run(bed: Bed, source: str = "declared", **more):
    from ..plans.run import WIDE_TABLES, Settings, VerdictRun
    from ..sources.panel import Panel

    settings = Settings(
        source=source, gate=roles.GATE, role_column="role", reference_values=("Control",), grouping=roles.GROUPING,
        contending=tuple(map(tuple, roles.CONTENDING)), wide=WIDE_TABLES,
    )
    return VerdictRun(bed.counts, Panel(bed.panel, [], bed.small), settings, bed.linker, bed.cell_list, **more)


_SHORT = """CASE "sampleId" WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' ELSE "sampleId" END"""
_KEYED = {
    "offered": "offered", "cellInList": "listed", "samplePanel": "samples", "cellBackground": 'ref f JOIN listed l USING ("sampleId", "cellId")',
    "cellRawCounts": 'counts k JOIN listed l USING ("sampleId", "cellId")',
    "cellPunchLong": "dense",
    "cellCardRows": 'dense d JOIN states s USING ("sampleId", "cellId", identity)', "cellCardCells": "linker",
}


@query(" UNION ALL ".join(f"""SELECT '{name}' AS "table", {_SHORT} AS "sampleId", count(*) AS rows FROM {source} GROUP BY 1, 2""" for name, source in _KEYED.items()))
def run_translated(spark, sf):
    """Tables of a whole run under other sample names, and the card with every silent position: their rows by name."""
    run = whole_run(Bed(spark, sf))
    made = run.translated({v: k for k, v in roles.LABELS.items()}, {"cellPunchLong": run.cell_punch_long})
    out = None
    for name in _KEYED:
        rows = made[name].groupBy("sampleId").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "sampleId", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def sample_names(spark, inverse: bool = False):
    pairs = [(v, k) if inverse else (k, v) for k, v in sorted(roles.LABELS.items())]
    return spark.createDataFrame(pairs, "from string, to string")


@query("""SELECT CASE "sampleId" WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' ELSE "sampleId" END AS "sampleId",
    "cellId", tag, "umiCount" FROM counts""")
def keys_translated(spark, sf):
    counts = roles.counts(spark, sf).select("sampleId", "cellId", "tag", "umiCount")
    return K.translate_keys(counts, "sampleId", sample_names(spark, inverse=True))


@query("""SELECT tag, array_to_string(list(CASE s WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' ELSE s END ORDER BY s), ', ') AS samples
    FROM (SELECT DISTINCT tag, "sampleId" AS s FROM counts) GROUP BY 1""")
def joined_lists_translated(spark, sf):
    lists = roles.counts(spark, sf).groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("sampleId")), ", ").alias("samples"))
    return K.translate_joined_lists(lists, ["samples"], {v: k for k, v in roles.LABELS.items()})


@query("""SELECT DISTINCT p_brand AS "from", 'B' || substr(p_brand, 7) AS "to" FROM part""")
def map_inverted(spark, sf):
    brands = roles.table(spark, sf, "part").select("p_brand").distinct()
    return K.invert_map(brands.select(F.concat(F.lit("B"), F.substring("p_brand", 7, 10)).alias("from"), F.col("p_brand").alias("to")))


@query("""SELECT CASE "sampleId" WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' ELSE "sampleId" END AS "sampleId",
    total, matched FROM parse""")
def records_rekeyed(spark, sf):
    return K.rekey(R.parse_report(roles.tagged_reads(spark, sf)), "sampleId", sample_names(spark, inverse=True))


@query("""SELECT tag, array_to_string(list(CASE s WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' ELSE s END ORDER BY s), '/') AS samples
    FROM (SELECT DISTINCT tag, sample AS s FROM panel) GROUP BY 1""")
def list_elements_translated(spark, sf):
    lists = roles.panel(spark, sf).groupBy("tag").agg(F.array_sort(F.collect_set("sample")).alias("s"))
    moved = K.translate_list(lists, "s", {v: k for k, v in roles.LABELS.items()})
    return moved.select("tag", F.array_join("s", "/").alias("samples"))


@query("""SELECT tag, CASE sample WHEN 'S1' THEN 'S1' ELSE sample END AS sample FROM (
    SELECT tag, CASE sample WHEN '1-URGENT' THEN 'S1' WHEN '2-HIGH' THEN 'S2' WHEN '3-MEDIUM' THEN 'S3' ELSE sample END AS sample FROM panel)""")
def sample_labels_translated(spark, sf):
    """Panel labels as sample ids; a label outside the map is kept."""
    return P.translate_sample_labels(roles.panel(spark, sf), roles.LABELS).select("tag", "sample")
