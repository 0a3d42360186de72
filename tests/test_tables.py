"""Readers of the published layouts on hand-written files: comments, bad fields, ragged rows, repeated keys, empty files."""

import pytest

from latticework.sources import tables


@pytest.fixture
def made(tmp_path):
    def make(text, name="table.txt"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return make


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_skip_comments_and_keep_bad_fields_as_nulls(spark, made):
    at = made("# L rho n\n 10\t0.5  3\n\n10 x 4 9\n12 0.25\n")
    assert _rows(tables.read_columns(spark, at, {"l": "int", "rho": "double", "n": "long"})) == [(10, 0.5, 3), (10, None, 4), (12, 0.25, None)]
    assert _rows(tables.read_columns(spark, made("", "none.txt"), {"l": "int"})) == []


def test_comma_rows_that_do_not_parse_go(spark, made):
    at = made("L, rho\n1, 0.5\n2, n/a\n3\n 4 , 1e-3\n")
    assert sorted(_rows(tables.read_csv(spark, at, {"l": "int", "rho": "double"}))) == [(1, 0.5), (4, 0.001)]


def test_samples_are_ragged_and_filtered_by_key(spark, made):
    at = made("10 0.5 1 2 3\n20 0.5\n30 0.5 nan 4\n")
    got = {r["l"]: r["samples"] for r in tables.read_samples(spark, at, {"l": "int", "rho": "double"}).collect()}
    assert got[10] == [1, 2, 3] and got[20] == [] and got[30][1] == 4
    assert [r["l"] for r in tables.read_samples(spark, at, {"l": "int"}, tables.F.col("l") > 15).collect()] == [20, 30]


def test_parameters_have_kinds_and_the_last_of_a_key(spark, made):
    at = made("# run\nL = 300\nrho=1e-2\nL=400\nflag=True\nnote=a=b\nno value\n")
    assert sorted(_rows(tables.read_parameters(spark, at))) == [("L", "400", "int", None), ("flag", "True", "bool", None), ("note", "a=b", "str", None), ("rho", "1e-2", "float", None)]
    lists = made("L_list=[60, 70,80]\nnone = []\npair=(1,2)\nopen=[1\n", "lists.txt")
    assert sorted(_rows(tables.read_parameters(spark, lists))) == [("L_list", "[60, 70,80]", "list", ["60", "70", "80"]), ("none", "[]", "list", []), ("open", "[1", "str", None), ("pair", "(1,2)", "list", ["1", "2"])]


def test_cache_takes_the_last_valid_time(spark, made):
    at = made("2 10 10 0.5 3.0\n2 10 10 0.500000 4.0\n2 10 10 0.5 -1\n2 10 10 0.5 inf\n2 10 10 0.6 nan\n3 10\n")
    assert _rows(tables.read_times(spark, at)) == [(2, 10, 10, "0.500000", 4.0)]


def test_blocks_paths_and_grids(spark, made):
    block = "Current Z = {}\nAverage number of clusters: {}\nAverage number of clusters by size: {}\nAverage portion of clusters by size: {}\n\n"
    text = block.format("0.50000", "2.00000", "1.00000 2.00000 ", "0.25000 0.75000 ") + "Current Z = 0.7\nAverage number of clusters: 3\n\n" + block.format("1", "x", "3", "1")
    assert _rows(tables.read_blocks(spark, made(text))) == [(0.5, 2.0, [1.0, 2.0], [0.25, 0.75]), (1.0, None, [3.0], [1.0])]
    paths = spark.createDataFrame([("/a/d=2-L=1600-W=8/rho=0.140/main_seed.txt",), ("/b/rho=0.14.txt",), (None,)], "path string")
    assert _rows(tables.with_path_parameters(paths, ["L", "rho"]).select("L", "rho")) == [("1600", "0.140000"), (None, "0.140000"), (None, None)]
    assert _rows(tables.read_grid(spark, made("0 1\n1 0\n", "grid.txt"))) == [(0, 0, 0), (1, 0, 1), (0, 1, 1), (1, 1, 0)]


def test_blocks_of_a_file_in_many_splits(spark, made):
    """Each split of a large file begins at a block of its own."""
    block = "Current Z = {0}\nAverage number of clusters: {0}.5\nAverage number of clusters by size: 1 2\nAverage portion of clusters by size: 0.5 0.5\n\n"
    at = made("".join(block.format(i) for i in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
        read = tables.read_blocks(spark, at)
        assert read.rdd.getNumPartitions() > 3
        assert sorted(r["z"] for r in read.collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_configurations(spark, made):
    """As the programs write them: a record a graph, a matrix a configuration, an empty line after each and one after the record."""
    text = "Z = 0.1\nT = 0.25\nIt is the 3nd graph with scale = 4\nNumber of elements in canon_config: 2\n0 1 \n1 0 \n\n2 3 \n3 0 \n\n\nZ = 0.2\nT = 0.5\nIt is the 0nd graph with scale = 1\nNumber of elements in canon_config: 0\n\n"
    want = [(0.1, 0.25, 3, 2, 0, [[0, 1], [1, 0]]), (0.1, 0.25, 3, 2, 1, [[2, 3], [3, 0]]), (0.2, 0.5, 0, 0, None, None)]
    assert sorted(_rows(tables.read_configurations(spark, made(text))), key=lambda r: (r[0], r[4] or 0)) == want
    assert _rows(tables.read_configurations(spark, made("no record\n", "none.txt"))) == []


def test_couplings(spark, made):
    at = made("1 2 3 4 5\n\n0.5 1 1 1 1\n-1 0 0 0 2\n0 0 1\n9 9 9 9 9\n")
    spins = {0: 1, 1: -1, 2: -1, 3: 1}
    rows = [(1, 2, 3, 4, 5), (0.5, 1, 1, 1, 1), (-1, 0, 0, 0, 2), (0, 0, 1)]
    want = 0.0
    for i, row in enumerate(rows):
        r, c = divmod(i, 2)
        want -= row[0] * spins[i]
        for j, (a, b) in zip(row[1:], ((r - 1, c), (r, c + 1), (r + 1, c), (r, c - 1))):
            want -= 0.5 * j * spins[i] * spins[a % 2 * 2 + b % 2]
    got = tables.coupled_energy(tables.read_couplings(spark, at, 2), spark.createDataFrame(list(spins.items()), "site long, s int"))
    assert [r["energy"] for r in got.collect()] == [want]


def test_a_later_append_wins(spark, tmp_path):
    for trial in range(4):
        at = f"{tmp_path}/cache{trial}"
        for tau in (3.0, 4.0, 5.0):
            tables.write_columns(spark.createDataFrame([(2, 10, 10, 0.5, tau), (2, 20, 10, 0.5, None)], "d int, l int, w int, rho double, tau double"), at, ["d", "l", "w", "rho", "tau"])
        assert _rows(tables.read_times(spark, at)) == [(2, 10, 10, "0.500000", 5.0)]
        assert [r["value"] for r in spark.read.text(at).collect() if r["value"].startswith("#")] == ["# d l w rho tau"]


def test_null_samples_keep_their_place(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (1, 2, 7.0)], "k int, i int, v double")
    tables.write_samples(rows, f"{tmp_path}/s", ["k"], "i", "v")
    (got,) = tables.read_samples(spark, f"{tmp_path}/s", {"k": "int"}).collect()
    assert got["samples"][0] == 5 and got["samples"][1] != got["samples"][1] and got["samples"][2] == 7
