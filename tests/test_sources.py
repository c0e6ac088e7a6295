import pytest

from fathom.operators.graph import Graph
from fathom.sources import adjacency as adj
from fathom.sources import perflog as pl


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_adjacency_round_trip(spark, tmp_path):
    p = write(tmp_path / "g.graph", "% note\n5 4 0\n2 3 \n1 3\n1 2 4\n3\n\n")
    assert adj.read_header(spark, p) == (5, 4)
    g = adj.read_graph(spark, p)
    assert g.edges.count() == 8 and {r.id: r.deg for r in g.degrees().collect()}[5] == 0
    adj.write_adjacency(g, 5, f"{tmp_path}/out")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert lines == ["5 4 0", "2 3", "1 3", "1 2 4", "3", ""]
    with pytest.raises(ValueError):
        adj.read_graph(spark, write(tmp_path / "bad.graph", "2 1\n7\n1\n"))


def test_dialects(spark, tmp_path):
    nine = write(tmp_path / "x-sv" / "a.log", "SV\tBranch-based\t0\t0.5\t1\t2\t3\t4\t5\n")
    r = pl.read_log(spark, nine, "x", "a").first()
    assert (r.Time, r.Mispredictions, r.Edges, r.Graph, r.Iteration) == (0.5, 1, 5, "a", 0)
    eight = write(tmp_path / "e.log", "BFS/TD Branch-avoiding\t1\t0.5\t1\t2\t3\t4\t5\n")
    r = pl.read_log(spark, eight).first()
    assert (r.Algorithm, r.Implementation, r.Vertices) == ("BFS/TD", "Branch-avoiding", 4)
    six = pl.read_log(spark, write(tmp_path / "s.log", "SV Branch-based\t1\t0.5\t1\t2\t3\n"))
    assert "Edges" not in six.columns and six.first().Instructions == 3
    head = write(tmp_path / "y-sv" / "a.log", "Algorithm\tImplementation\tItetarion\tTime\tCycles\tStall.RS\tEdges\nSV\tBranch-based\t2\t5e8\t7\t8\t9\n")
    r = pl.read_log(spark, head, "y", "a").first()
    assert (r.Iteration, r.Time, r.Stall_RS) == (2, 0.5, 8)
    both = pl.read_logs(spark, str(tmp_path), ["x", "y", "none"], ["sv"], ["a", "b"])
    rows = {r.Architecture: r for r in both.collect()}
    assert rows["x"].Cycles == 0 and rows["y"].Mispredictions == 0 and len(rows) == 2
    assert set(pl.read_logs(spark, str(tmp_path), ["x", "y"], ["sv"], ["a"], common=True).columns) == {*pl.KEYS, "Time", "Edges"}
    assert pl.read_log(spark, f"{tmp_path}/none.log", missing="skip") is None
    with pytest.raises(FileNotFoundError):
        pl.read_log(spark, f"{tmp_path}/none.log")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("SV", "b", 1, 2.0), ("SV", "b", 0, 1.0)], "Algorithm string, Implementation string, Iteration long, Time double")
    pl.write_log(df, f"{tmp_path}/log")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/log").collect()][1:] == ["SV\tb\t0\t1.0", "SV\tb\t1\t2.0"]
    ph = spark.createDataFrame([("dependency", 0), ("dependency", 1), ("traversal", 1), ("traversal", 0)], "phase string, level long")
    pl.write_phases(ph, f"{tmp_path}/ph")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/ph").collect()][1:] == ["traversal,0", "traversal,1", "dependency,1", "dependency,0"]
    pl.write_names(spark, ["A", "B"], f"{tmp_path}/names")
    assert pl.read_names(spark, f"{tmp_path}/names") == ["A", "B"]
    assert pl.header_columns({"Cycles": True, "X": False}, ["A"], ["Z"]) == ["A", "Cycles", "Z"]
    with pytest.raises(ValueError):
        pl.union_same([df, ph])


def test_results(spark, tmp_path):
    p = write(tmp_path / "r.csv", "g, C, 5, 8, 8, 3, 1.0, 2.0, 3.0, 2.0, 3.0\ng, Python, 5, 8, 8, 3, 2.0, 1.0, 3.0, 2.0, 3.0\n\n")
    rows = pl.read_results(spark, p).collect()
    assert [(r.lang, r.time_bb, r.time_ba) for r in rows] == [("C", 1.0, 2.0), ("Python", 1.0, 2.0)]
    assert pl.result_lines(pl.read_results(spark, p)).first()[0].split(", ")[0].strip() == "g"


def test_degree_of_read_graph(spark, tmp_path):
    g = Graph.from_pairs(adj.read_adjacency(spark, write(tmp_path / "u.graph", "2 1\n2\n1")))
    assert g.edges.count() == 2


def test_adjacency_is_read_in_blocks(spark, tmp_path):
    """A file was one row of one task, which a large graph's text does not fit."""
    from pyspark.sql import functions as F

    lists = {v: [w for w in range(1, 301) if w != v and (v * w) % 7 == 1] for v in range(1, 301)}
    lines = ["% a note", f"300 {sum(map(len, lists.values())) // 2} 0"]
    for v, ws in lists.items():
        lines += ["%" + "x" * (v % 90)] * (v % 3 == 0) + ["  " * (v % 2) + "\t".join(map(str, ws)) + "\r" * (v % 5 == 0)]
    one = write(tmp_path / "many" / "a.graph", "\n".join(lines))
    write(tmp_path / "many" / "b.graph", "% b\n2 1\n2\n1\n")
    want = [(v, w) for v, ws in lists.items() for w in ws]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        pairs = adj.read_adjacency(spark, one)
        assert sorted(map(tuple, pairs.collect())) == want
        assert adj.numbered_lines(spark, one).agg(F.min("number"), F.max("number"), F.count_distinct("number")).first() == (0, 300, 301)
        assert spark.read.text(one).rdd.getNumPartitions() > 1
        assert sorted(map(tuple, adj.read_adjacency(spark, str(tmp_path / "many")).collect())) == sorted([*want, (1, 2), (2, 1)])
        assert adj.read_graph(spark, one).edges.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
