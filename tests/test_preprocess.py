import pytest
from pyspark.sql import functions as F

from cohortry.operators import preprocess as P
from cohortry.operators import quality as Q
from cohortry.session import scratch_dir
from cohortry.sources import contracts, readers


def data(spark):
    rows = [(1, 10.0, "b", None), (2, None, "a", None), (3, 30.0, None, None), (4, 40.0, "a", None), (4, 40.0, "a", None)]
    return spark.createDataFrame(rows, "id int, v double, s string, n double")


def test_imputation_edges(spark):
    df = data(spark)
    assert P.fit_imputer(df, ["v", "n"], "median").fill == {"v": 35.0, "n": 0.0}
    assert P.fit_imputer(df, ["v", "s", "n"], "most_frequent").fill == {"v": 40.0, "s": "a", "n": 0.0}
    assert P.fit_imputer(df.filter("id < 3"), ["s"], "most_frequent").fill == {"s": "a"}  # tie: smallest
    assert P.fit_imputer(df.filter("id > 9"), ["v", "s"], "median" if False else "most_frequent").fill == {"v": 0.0, "s": "missing"}
    with pytest.raises(ValueError):
        P.fit_imputer(df, ["v"], "nearest")


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_constant_column_scales_to_zero(spark, method):
    df = spark.createDataFrame([(7.3,)] * 4, "v double")
    assert {r["v"] for r in P.fit_scaler(df, ["v"], method).transform(df).collect()} == {0.0}


def test_ordinal_unknown_and_null(spark):
    df = data(spark)
    codes = P.ordinal_codes(df, "s")
    assert {(r["value"], r["code"]) for r in codes.collect()} == {("a", 0), ("b", 1)}
    new = spark.createDataFrame([("b",), ("zz",), (None,)], "s string")
    assert sorted(r["c"] for r in P.apply_ordinal(new, "s", codes, "c").collect()) == [-1, -1, 1]


@pytest.mark.parametrize("encoding", ["onehot", "ordinal"])
def test_round_trip(spark, encoding):
    df = data(spark).drop("n")
    pre = P.Preprocessor(encoding=encoding).fit(df, ["id"])
    path = scratch_dir(spark)
    pre.save(spark, path)
    back = P.Preprocessor.load(spark, path)
    got = back.inverse(back.transform(df)).orderBy("id").select("id", F.round("v", 9).alias("v"), "s").collect()
    assert [tuple(r) for r in got] == [(1, 10.0, "b"), (2, 35.0, "a"), (3, 30.0, "a"), (4, 40.0, "a"), (4, 40.0, "a")]


def test_preprocessor_missing_column_warns(spark):
    df = data(spark).drop("n")
    pre = P.Preprocessor().fit(df, ["id"])
    with pytest.warns(UserWarning):
        assert pre.transform(df.drop("v")).count() == 5
    with pytest.raises(ValueError):
        P.Preprocessor().fit(df.select(F.array("v").alias("x")))


def test_quality(spark):
    df = data(spark)
    assert Q.duplicate_rows(df).first()[0] == 1
    assert Q.audit_table(df, "t").first()["status"] == "schema_warning"
    assert Q.audit_table(df.filter("id > 9"), "t").first()["status"] == "empty"
    twice = df.select("id", "v", F.col("v"))
    assert [r["repeated_name"] for r in Q.audit_columns(twice).orderBy("column").collect()] == [False, True, True]
    with pytest.raises(Q.FeatureMismatch):
        Q.require_features(df, ["v", "w"])
    with pytest.raises(ValueError):
        Q.target_distribution(df)


def test_readers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.csv"))
    p = tmp_path / "x.xlsx"
    p.write_text("a")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(p))
    with pytest.raises(KeyError):
        contracts.resolve("nothing")


def test_sectioned_lookup(spark, tmp_path):
    p = tmp_path / "ids.csv"
    p.write_text('kind_id,description\n1,Emergency\n2, "Urgent, soon"\n5,NULL\nNULL,x\n,\nsource_id,description\n7,\nx,y\n')
    got = {(r["column"], r["code"], r["description"]) for r in readers.read_sectioned_lookup(spark, str(p)).collect()}
    assert got == {("kind_id", 1, "Emergency"), ("kind_id", 2, "Urgent, soon"), ("kind_id", 5, "Unknown"), ("source_id", 7, "Unknown")}


def test_file_tree(spark, tmp_path):
    for f in ("Train/Basal Cell/a.JPG", "Train/Basal Cell/deep/b.png", "Train/nevus/c.txt", ".hidden/x/y.png", "stray.png"):
        q = tmp_path / "root" / f
        q.parent.mkdir(parents=True, exist_ok=True)
        q.write_bytes(b"0")
    got = {(r["split"], r["lesion_label"], r["lesion_label_clean"]) for r in readers.scan_labelled_files(spark, str(tmp_path / "root")).collect()}
    assert got == {("train", "Basal Cell", "basal_cell")}
