"""Wide text files with headers of their own."""

import pytest

from countgrove.sources import tables as S


def _write(folder, **files):
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_files_with_other_samples_and_order(spark, tmp_path):
    path = _write(tmp_path, a="OTU\ts1\ts2\ttaxonomy\nf1\t3\t0\tk__A\nf2\t\tx\tk__B\nf3\t1\n\n",
                  b="taxonomy\ts3\tOTU\ts1\r\nk__A\t5\tf1\t7\r\n", c="OTU\ts9\nf1\t2.0\nf2\tNaN\n")
    got = S.read_wide_counts(spark, path)
    assert got.columns == ["feature", "lineage", "sample", "reads"]
    assert _rows(got) == sorted([
        ("f1", "k__A", "s1", 3), ("f3", None, "s1", 1), ("f1", "k__A", "s3", 5), ("f1", "k__A", "s1", 7), ("f1", None, "s9", 2)], key=str)
    assert _rows(S.read_wide_counts(spark, f"{path}/c")) == [("f1", "s9", 2)]
    assert _rows(S.read_wide_counts(spark, path, keep="^s3$")) == [("f1", "k__A", "s3", 5)]


def test_quoted_cells_hold_the_separator(spark, tmp_path):
    path = _write(tmp_path, a='"OTU","s,1","taxonomy"\n"f""1","2","k__A,p__\\"B"\n f2 ,3,\n')
    assert _rows(S.read_wide_counts(spark, path, sep=",")) == [(" f2 ", "", "s,1", 3), ('f"1', 'k__A,p__"B', "s,1", 2)]


def test_preambles_are_told_by_place(spark, tmp_path):
    head = "# run\n#OTU ID\tx\n"
    path = _write(tmp_path, a=head + "#OTU ID\ts1\ts2\nf1\t1\t2\n# run\t4\t5\n#OTU ID\t8\t9\n", b=head + "s2\t#OTU ID\n6\tf1\n")
    assert _rows(S.read_counts_with_preamble(spark, path, skip=2)) == [
        ("# run", "s1", 4), ("# run", "s2", 5), ("#OTU ID", "s1", 8), ("#OTU ID", "s2", 9), ("f1", "s1", 1),
        ("f1", "s2", 2), ("f1", "s2", 6)]
    with pytest.raises(ValueError, match="no header"):
        S.read_counts_with_preamble(spark, path, skip=9)
    with pytest.raises(ValueError, match="no column"):
        S.read_counts_with_preamble(spark, path, skip=0)


def test_files_in_several_splits(spark, tmp_path):
    body = "".join(f"f{i}\t{i}\t{i + 1}\n" for i in range(1, 20001))
    path = _write(tmp_path, a="OTU\ts1\ts2\n" + body, b="OTU\ts2\ts1\n" + body)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = S.read_wide_counts(spark, path)
        assert got.count() == 80000
        assert {(r["sample"], r["sum(reads)"]) for r in got.groupBy("sample").sum("reads").collect()} == {
            (s, 2 * sum(range(1, 20001)) + 20000) for s in ("s1", "s2")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_matrix_of_many_columns(spark, tmp_path):
    names = [f"c{i}" for i in range(3000)]
    path = _write(tmp_path, a="\t".join(["id", *names]) + "\n" + "\t".join(["7", *map(str, range(2999)), "NA"]) + "\n")
    got = S.read_matrix(spark, path, "id", id_type="int")
    assert got.dtypes == [("id", "int"), ("column", "string"), ("value", "double")]
    values = {r["column"]: r["value"] for r in got.collect()}
    assert len(values) == 3000 and values["c2999"] is None and values["c2998"] == 2998.0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "c1500" not in plan
