import pytest
from helpers import rows

from tagspark.operators import keys as K
from tagspark.sources import sinks, tables


def test_counts_are_stripped_and_typed(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cellId,sampleId,tag,umiCount,other\n c1 , S ,\tAAAA ,3,x\nc2,S,,4,\n")
    df = tables.read_counts(spark, str(tmp_path / "c.csv"))
    assert rows(df) == {("S", "c1", "AAAA", 3), ("S", "c2", "", 4)} and dict(df.dtypes)["umiCount"] == "bigint"


@pytest.mark.parametrize("bad", ["1.5", "", "x"])
def test_a_count_that_is_no_count_is_named(spark, tmp_path, bad):
    (tmp_path / "c.csv").write_text(f"sampleId,cellId,tag,umiCount\nS,c,A,1\nS,c,B,{bad}\n")
    counts = tables.read_counts(spark, str(tmp_path / "c.csv"))
    with pytest.raises(Exception, match=f"umiCount.*whole numbers: '{bad}'.*a blank or a decimal is not one"):
        counts.collect()
    assert counts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_samples_are_gathered_by_file_in_one_read(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"s {i}.tsv").write_text(f"CELL\tFEATURE\tcount\ttotalWeight\tunique_UMI\nc{i}\tA\t1\t2\t{i}\n")
    (tmp_path / "folder").mkdir()
    for k in range(2):
        (tmp_path / "folder" / f"part{k}.tsv").write_text(f"CELL\tFEATURE\tcount\ttotalWeight\tunique_UMI\nx{k}\tB\t1\t2\t7\n")
    paths = {f"S{i}": str(tmp_path / f"s {i}.tsv") for i in range(40)} | {"whole": str(tmp_path / "folder")}
    gather = lambda p: tables.gather_samples(spark, p, {"CELL": "cellId", "unique_UMI": "umiCount"}, tables.tag_stat_schema())
    assert rows(gather(paths)) == {(f"S{i}", f"c{i}", i) for i in range(40)} | {("whole", "x0", 7), ("whole", "x1", 7)}
    nodes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert nodes(gather(paths)) == nodes(gather({"S0": paths["S0"]}))
    with pytest.raises(ValueError):
        gather({"a": paths["S0"], "b": paths["S0"]})


def test_a_missing_column_is_named(spark, tmp_path):
    (tmp_path / "l.csv").write_text("sampleId,cellId\nS,c\n")
    with pytest.raises(ValueError, match="setId"):
        tables.read_keys(spark, str(tmp_path / "l.csv"), ["sampleId", "cellId", "setId"])


def test_an_empty_table_keeps_its_header_and_types(spark, frame, tmp_path):
    sinks.write_sorted(frame([], "a string, b bigint"), str(tmp_path / "e.csv"), ["a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "e.csv")).columns == ["a", "b"]
    (tmp_path / "t.tsv").write_text("CELL\tFEATURE\tcount\ttotalWeight\tunique_UMI\n")
    stat = tables.read_tag_stat(spark, str(tmp_path / "t.tsv"), "S")
    assert stat.count() == 0 and dict(stat.dtypes)["unique_UMI"] == "bigint"


def test_reports_wrapped_unwrapped_and_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "parseReport": {"total": 10,\n "matched": 4}}')
    (tmp_path / "b.json").write_text('{"total": 3}')
    (tmp_path / "c.json").write_text("{")
    assert rows(tables.read_parse_reports(spark, str(tmp_path / "a.json"), "S")) == {("S", 10, 4)}
    assert rows(tables.read_parse_reports(spark, str(tmp_path / "b.json"), "S")) == {("S", 3, 0)}
    assert rows(tables.read_refine_reports(spark, str(tmp_path / "c.json"), "S")) == set()
    (tmp_path / "r.json").write_text('{"steps": [{"tagName": "CELL", "inputCount": 5, "outputCount": 4}]}')
    assert rows(tables.read_refine_reports(spark, str(tmp_path / "r.json"), "S")) == {("S", "CELL", 5, 4)}


def test_blank_read_figures_are_absent(spark, tmp_path):
    (tmp_path / "q.csv").write_text("sampleId,readsTotal,matchedFraction\n S ,10,\n")
    row = tables.read_read_qc(spark, str(tmp_path / "q.csv")).first()
    assert (row.sampleId, row.readsTotal, row.matchedFraction, row.cellsDetected) == ("S", 10.0, None, None)


def test_ids_in_lists_are_whole_tokens(frame):
    df = frame([("X-1, X-10, X-2",)], "s string")
    assert K.translate_joined_lists(df, ["s"], {"X-1": "A", "X-10": "B"}).first().s == "A, B, X-2"


def test_keys_are_translated_or_kept(frame):
    df, mapping = frame([("a", 1), ("b", 2)], "k string, v bigint"), frame([("a", "z")], "from string, to string")
    assert rows(K.translate_keys(df, "k", mapping)) == {("z", 1), ("b", 2)}
    assert rows(K.invert_map(mapping)) == {("z", "a")}
    with pytest.raises(Exception, match="not invertible"):
        K.invert_map(frame([("a", "z"), ("b", "z")], "from string, to string")).collect()
