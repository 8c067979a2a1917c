import pytest
from pyspark.sql import functions as F

from partita.operators import counts, encode
from partita.sources import tables


def _example(spark):
    rows = spark.createDataFrame([(1, "0", "1", "2", "5"), (2, "2", "3", "4", "2"), (3, "1", "2", "0", "3")], "id long, a string, b string, c string, d string")
    return tables.from_table(rows, "id", ["a", "b", "c", "d"], miss=("0",))


def test_worked_example(spark):
    data = encode.encode(_example(spark))
    rows = data.attributes.orderBy("attr_id").collect()
    assert "".join(r.value for r in rows) == "1212324235"
    assert [r.site_key for r in rows] == [1, 1, 2, 2, 2, 3, 3, 4, 4, 4]
    ones = {u: set() for u in (1, 2, 3)}
    for r in data.ones.collect():
        ones[r.unit_id].add(r.attr_id)
    assert ones == {1: {3, 6, 10}, 2: {2, 5, 7, 8}, 3: {1, 4, 9}}


def test_decode_gives_the_values_back(spark):
    data = encode.encode(_example(spark))
    got = {(r.unit_id, r.pos): r.value for r in encode.decode(data).collect()}
    want = {(r.unit_id, r.pos): r.value or "" for r in _example(spark).collect()}
    assert got == want


def test_relabel_keeps_the_order_of_labels(spark):
    labels = spark.createDataFrame(list(enumerate([1.0, 1.0, 3.0, 1.0, -2.0, 4.0, 3.0])), "unit_id long, label double")
    assert [r.cluster for r in counts.relabel(labels).orderBy("unit_id").collect()] == [2, 2, 3, 2, 1, 4, 3]
    joined = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 2.0)], "unit_id long, label double")
    assert [r.cluster for r in counts.relabel(joined).orderBy("unit_id").collect()] == [1, 1, 2]


def test_missing_values_and_case(spark):
    cells = spark.createDataFrame([(1, 1, " A "), (2, 1, "na"), (3, 1, ""), (4, 1, None)], "unit_id long, pos int, value string")
    assert [r.value for r in encode.normalise(cells, ("NA",)).orderBy("unit_id").collect()] == ["a", None, None, None]


def test_validate_names_units(spark):
    cells = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (2, 1, "a"), (2, 2, "?"), (3, 1, "a")], "unit_id long, pos int, value string")
    found = {(r.problem, r.unit_id) for r in encode.validate(cells, letters=encode.SEQUENCE_LETTERS).collect()}
    assert found == {("length", 3), ("letters", 2)}
    with pytest.raises(ValueError, match="unit 2"):
        encode.require_valid(cells, letters=encode.SEQUENCE_LETTERS)


def test_validate_takes_the_smallest_of_equally_common_lengths(spark):
    cells = spark.createDataFrame([(u, k, "a") for u, n in ((1, 3), (2, 2), (3, 3), (4, 2), (5, 1)) for k in range(n)], "unit_id long, pos int, value string")
    assert {(r.unit_id, r.detail) for r in encode.validate(cells).collect()} == {(1, "3 cells, others have 2"), (3, "3 cells, others have 2"), (5, "1 cells, others have 2")}


def test_fasta_and_csv(spark, tmp_path):
    (tmp_path / "x.fa").write_text("\n>one\nAC-T\n  >two \nac\n\nGT\n>three\nTTTT\n")
    cells, units = tables.read_fasta(spark, str(tmp_path / "x.fa"), miss=("-",))
    assert [(r.unit_id, r.uid) for r in units.orderBy("unit_id").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    got = {}
    for r in cells.orderBy("unit_id", "pos").collect():
        got[r.unit_id] = got.get(r.unit_id, "") + (r.value or ".")
    assert got == {1: "ac.t", 2: "acgt", 3: "tttt"}
    (tmp_path / "dos.fa").write_bytes(b"\r\n>>one\r\nAC-T\t\r\n>two\r\n\tac\r\n\r\nGT\r\n>>three \r\nTTTT\r\n")
    cells, units = tables.read_fasta(spark, str(tmp_path / "dos.fa"), miss=("-",))
    assert [r.uid for r in units.orderBy("unit_id").collect()] == [">one", "two", ">three"]
    assert "".join(r.value or "." for r in cells.orderBy("unit_id", "pos").collect()) == "ac.tacgttttt"
    (tmp_path / "bad.fa").write_text("ACGT\n")
    with pytest.raises(ValueError):
        tables.read_fasta(spark, str(tmp_path / "bad.fa"))
    (tmp_path / "x.csv").write_text('u1, A ,"b,c"\nu2,x,NA\n')
    cells, units = tables.read_csv(spark, str(tmp_path / "x.csv"), ids=True, miss=("NA",))
    assert [r.value for r in cells.orderBy("unit_id", "pos").collect()] == ["a", "b,c", "x", None]
    assert [r.uid for r in units.orderBy("unit_id").collect()] == ["u1", "u2"]


def test_partition_files(spark, tmp_path):
    part = spark.range(1, 500).select(F.col("id").alias("unit_id"), (F.col("id") % 7 + 1).cast("int").alias("cluster"))
    tables.write_partition(part, str(tmp_path / "p"))
    back = counts.relabel(tables.read_partition(spark, str(tmp_path / "p"), 499))
    assert sorted((r.unit_id, r.cluster) for r in back.collect()) == sorted((r.unit_id, r.cluster) for r in part.collect())
    with pytest.raises(ValueError):
        tables.read_partition(spark, str(tmp_path / "p"), 3)


def test_alphabet_of_numbers_and_words(spark):
    number = spark.createDataFrame([(1, "10", 1), (1, "9", 1), (2, None, 1)], "pos int, value string, n long")
    assert [r.value for r in encode.alphabet(number).orderBy("code").collect()] == ["9", "10"]
    word = spark.createDataFrame([(1, "10", 1), (1, "9", 1), (2, "x", 1)], "pos int, value string, n long")
    assert [r.value for r in encode.alphabet(word).orderBy("code").collect()] == ["10", "9", "x"]
