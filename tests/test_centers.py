import pytest
from pyspark.sql import functions as F

from centrum.operators import centers as ce, splits as sp
from centrum.plans import views as V


@pytest.fixture(scope="module")
def rows(spark, folder):
    return V.planted_rows(spark, folder).select("row_key", "center_id", "label", "l_linestatus").persist()


@pytest.mark.parametrize("alpha", [0.05, 0.7, 10.0])
@pytest.mark.parametrize("floor", [0, 10, 10**6])
def test_dirichlet_counts_add_up(spark, rows, alpha, floor):
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    shares = ce.dirichlet_shares(sizes, "label", 7, alpha)
    out = ce.slice_counts(sizes, shares, "label", 7, floor).collect()
    total = {r["label"]: r["n_class"] for r in sizes.collect()}
    for label, n in total.items():
        part = sorted((r["center_id"], r["lo"], r["hi"], r["n_rows"]) for r in out if r["label"] == label)
        assert sum(p[3] for p in part) == n
        assert all(p[3] >= min(floor, n // 7) for p in part)
        assert part[0][1] == 0 and part[-1][2] == n and all(a[2] == b[1] for a, b in zip(part, part[1:]))


def test_each_row_goes_to_exactly_one_center(rows):
    out = ce.dirichlet_centers(rows.drop("center_id"), "row_key", "label", 5, alpha=0.5).persist()
    assert out.count() == rows.count() == out.select("row_key").distinct().count()
    assert {r["center_id"] for r in out.select("center_id").distinct().collect()} == set(range(5))
    again = ce.dirichlet_centers(rows.drop("center_id").repartition(13), "row_key", "label", 5, alpha=0.5)
    assert out.select("row_key", "center_id").exceptAll(again.select("row_key", "center_id")).isEmpty()


@pytest.mark.parametrize("alpha", [None, 0, -1.0])
def test_no_alpha_means_equal_centers(rows, alpha):
    out = ce.dirichlet_centers(rows.drop("center_id"), "row_key", "label", 7, alpha=alpha)
    sizes = sorted(r["count"] for r in out.groupBy("center_id").count().collect())
    assert len(sizes) == 7 and sizes[-1] - sizes[0] <= 1


def test_more_centers_than_rows(spark):
    df = spark.createDataFrame([(str(i),) for i in range(3)], "k string")
    assert sorted(r["center_id"] for r in ce.iid_centers(df, "k", 5).collect()) == [0, 1, 2]
    assert sorted(r["center_id"] for r in ce.equal_split(df, "k", 5).collect()) == [0, 1, 2]


def test_attribute_is_checked(rows):
    assert ce.partition_column(["a", "b"], 1) == "b"
    for wrong in (2, -1, "c"):
        with pytest.raises(ValueError):
            ce.partition_column(["a", "b"], wrong)


def test_empty_center_is_an_error(rows):
    assert ce.select_center(rows, None) is rows
    with pytest.raises(ValueError):
        ce.select_center(rows, 99)


def test_reference_center_prefers_the_first_on_ties(spark):
    sizes = spark.createDataFrame([(0, 0), (2, 9), (1, 9)], "center_id int, n_rows bigint")
    assert ce.reference_center(sizes).first()["center_id"] == 1
    assert ce.reference_center(sizes, "random").count() == 1
    with pytest.raises(ValueError):
        ce.reference_center(sizes, "smallest")


def test_split_shares(rows):
    for split in (sp.train_val_test, sp.one_pass_train_val_test):
        n = {r["split"]: r["count"] for r in split(rows, "row_key").groupBy("split").count().collect()}
        total = sum(n.values())
        assert total == rows.count()
        assert n["test"] / total == pytest.approx(0.2, abs=0.01) and n["val"] / total == pytest.approx(0.16, abs=0.01)


def test_centers_with_none_one_and_five_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0)] + [(f"b{i}", 2, 1.0) for i in range(5)], "k string, center_id int, label double")
    out = sp.stratified_split(df, "k", 0.6)
    n = {(r["center_id"], r["split"]): r["count"] for r in out.groupBy("center_id", "split").count().collect()}
    assert n == {(1, "train"): 1, (2, "train"): 2, (2, "test"): 3}


def test_kfold_keeps_the_other_folds(rows):
    out = ce.kfold_centers(rows.drop("center_id"), "row_key", 4)
    assert out.where("fold = center_id").isEmpty() and out.count() == 3 * rows.count()


def test_hash_sample_share(rows):
    assert ce.hash_sample(rows, "row_key", 1.0) is rows
    assert ce.hash_sample(rows, "row_key", 0.25).count() / rows.count() == pytest.approx(0.25, abs=0.03)


def test_rows_without_class_or_code_stay(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_key"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("c"))
    for dealt in (ce.dirichlet_centers(rows, "row_key", "c", 4, alpha=0.5), ce.natural_code_centers(rows, "c")):
        assert dealt.count() == 1000 == dealt.select("row_key").distinct().count()
        assert dealt.where("c is null").count() == 100
    assert ce.natural_code_centers(rows, "c").where("c is null").select("center_id").distinct().first()[0] == 3


def test_shares_that_would_lose_rows_are_refused(spark):
    rows = spark.range(60).select(F.col("id").alias("row_key"), (F.col("id") % 3).alias("c"))
    absent = [(c, k, 0.5) for c in (0, 1) for k in (0, 1)]
    short = [(c, k, 0.4) for c in (0, 1, 2) for k in (0, 1)]
    for shares in (absent, short):
        with pytest.raises(ValueError, match="shares"):
            ce.dirichlet_centers(rows, "row_key", "c", 2, shares=spark.createDataFrame(shares, "c long, center_id int, share double"))
