import pytest

from tidemill.plans import pipeline as P
from tidemill.sources import sinks, tables


def keep_whole(df, subset=None):
    return df.na.drop(subset=subset)


def test_files_and_catalog(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "a int, b string").write.csv(str(tmp_path / "in"), header=True)
    catalog = tmp_path / "c.yml"
    catalog.write_text("whole:\n  function: {module: tests.test_pipeline, name: keep_whole, kwargs: {subset: [b]}}\n  input: {type: FileSource, path: '{}/in', reader: read_csv}\n  output: {type: FileSink, path: '{}/out', writer: to_parquet}\n")
    P.Catalog(str(tmp_path), ("tests",)).load(str(catalog)).run(spark, "whole")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(AttributeError):
        P.Catalog().run(spark, "whole")
    with pytest.raises(ValueError):
        P.Catalog(str(tmp_path)).load(str(catalog)).task("whole")


def test_store(spark):
    store = tables.FrameStore(spark)
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "one double, two double")
    name = store.put(df, store.new_id())
    assert store.get(name).collect() == df.collect()
    with pytest.raises(ValueError):
        store.put(df, name, overwrite=False)


def test_graph_order_and_names():
    a, b, c, d = (P.Task(lambda: None, name=n) for n in "abcd")
    a.then(b), a.then(c), b.then(d), c.then(d)
    g = P.Graph([d, c, b, a])
    order = [t.name for t in g.ordered()]
    assert order[0] == "a" and order[-1] == "d" and g.roots() == [a]
    assert [t.name for t in P.breadth_first(d)] == ["d", "b", "c", "a"] and len(P.shells([a])) == 3
    assert '"a" -> "b"' in g.dot()
    d.then(a)
    with pytest.raises(ValueError):
        g.ordered()
    assert P.with_paths({"p": "{}/x", "n": 1, "l": ["{}"], "b": True, "o": "{k}"}, "/r") == {"p": "/r/x", "n": 1, "l": ["/r"], "b": True, "o": "{k}"}
    assert P.pod_name("Load_Data", "DAG") == "dag-load-data"
    names = sinks.NameGenerator()
    assert names.name(10) == names.name(10) and names.name(9) != names.name(10)


def test_database_options():
    db = tables.Database("u", "p", "h", 5433, "d")
    assert db.url == "jdbc:postgresql://h:5433/d"
    assert sinks.DatabaseSink('a"b.c', db).options()["dbtable"] == '"a""b"."c"'
