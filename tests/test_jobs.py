import json

import pytest
from conftest import PEOPLE, TREES
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from kveil import run_anonymize, run_examine, run_explore
from kveil.operators.generalize import k_anonymize, verify_k
from kveil.operators.mining import kmeans
from kveil.operators.features import encode
from kveil.plans import examine
from kveil.session import cut_lineage, ensure_checkpoint_dir, settle
from kveil.sources import load_model, load_spec, preview, read_csv, read_text, save_model, write_csv, write_text
from kveil.sources.config import JobSpec, category, numeric, read_attributes, read_config


def attrs(*pairs):
    return [{"attrName": n, "dataType": t} for n, t in pairs]


def tree_json(nested):
    out = {}
    for attr, rows in TREES.items():
        nodes = [{"value": v, "parent": p, "level": str(level), "position": "null"} for v, p, level in rows]
        out[attr] = {"tree": "binary-tree", "generalization": nodes} if nested else nodes
    return out


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "people.csv"
    lines = ["name,age,race,sex,workclass,income"]
    lines += [f"n{r[0]},{','.join(map(str, r[1:6]))}" for r in PEOPLE]
    path.write_text("\n".join(lines))
    return str(path)


def job(tmp_path, csv_path, nested=False, **more):
    body = {
        "k": 3,
        "num_sample_datas": 9,
        "input_path": csv_path,
        "output_path": f"{tmp_path}/out/",
        "identifier": attrs(("name", "category")),
        "sensitive_identifier": attrs(("income", "category")),
        "quasi_identifier": attrs(("age", "numeric"), ("race", "category"), ("sex", "category"), ("workclass", "category")),
        "domain_generalization_hierarchy": tree_json(nested),
    } | more
    path = tmp_path / "job.json"
    path.write_text(json.dumps({k: v for k, v in body.items() if v is not None}, indent=2))
    return str(path)


@pytest.mark.parametrize("nested", [False, True])
def test_job_file(spark, tmp_path, csv_path, nested):
    spec = load_spec(spark, job(tmp_path, csv_path, nested))
    assert (spec.k, spec.cap, spec.input_path2, spec.model_name) == (3, 9, None, None)
    assert [a.name for a in spec.roles.selected] == ["age", "race", "sex", "workclass", "income"]
    assert spec.roles.numeric_quasi == ("age",)
    assert spec.dgh.count() == 25 and spec.dgh.where("value = 'White'").first().level == 3


def test_absent_lists_are_empty(spark, tmp_path, csv_path):
    path = job(tmp_path, csv_path, sensitive_identifier=None, domain_generalization_hierarchy=None, num_sample_datas=None)
    spec = load_spec(spark, path)
    assert spec.roles.sensitive == () and spec.cap is None and spec.dgh.count() == 0
    assert read_attributes(read_config(spark, path), "selected_column").count() == 0


def test_anonymize_job(spark, tmp_path, csv_path):
    out = run_anonymize(spark, job(tmp_path, csv_path), single_file=True)
    normal, clusters, anonymous = (read_csv(spark, p) for p in out.values())
    assert normal.columns == ["id", "age", "race", "sex", "workclass", "income"]
    assert [int(r.age) for r in normal.orderBy(normal.id.cast("int")).collect()] == [r[1] for r in PEOPLE]
    assert clusters.columns[-1] == "Cluster" and clusters.groupBy("Cluster").count().count() == 3
    assert verify_k(anonymous, ["age", "race", "sex", "workclass"]).first()[:] == (3, 9, 3)
    income = {r.id: r.income for r in normal.collect()}
    assert {r.id: r.income for r in anonymous.collect()} == income


def test_cap_limits_the_rows(spark, tmp_path, csv_path):
    out = run_anonymize(spark, job(tmp_path, csv_path, num_sample_datas=7))
    assert read_csv(spark, out["k-anonymity"]).count() == 7


@pytest.mark.parametrize("model, folder, score", [("k_means", "k-means", "silhouette-score"), ("naive_bayes", "naive-bayes", "accuracy-score")])
def test_examine_job(spark, tmp_path, people, roles, hierarchy, model, folder, score):
    before, after = f"{tmp_path}/before", f"{tmp_path}/after"
    write_csv(people.drop("Cluster"), before)
    write_csv(k_anonymize(people, roles, hierarchy), after)
    path = tmp_path / "job.json"
    body = {
        "input_path": before,
        "input_path2": after,
        "output_path": f"{tmp_path}/out/",
        "model_name": model,
        "selected_column": attrs(("age", "numeric"), ("race", "category"), ("sex", "category"), ("income", "category")),
        "k_means": {"k": 2},
        "naive_bayes": {"label": "income", "training_set": 0.7, "test_set": 0.3},
    }
    path.write_text(json.dumps(body))
    out = run_examine(spark, str(path), key="id", single_file=True)
    assert set(out) == {"normal-table", "anonymize-table", score}
    assert all(f"/{folder}/" in p for p in out.values())
    scores = {r.Info: float(r.score) for r in read_csv(spark, out[score]).collect()}
    assert scores["Difference"] == pytest.approx(abs(scores["Normal table"] - scores["Anonymize table"]))
    anonymized = read_csv(spark, out["anonymize-table"])
    # ranges stay labels; reading them as numbers would leave only NULLs
    assert anonymized.where("age like '[%-%]'").count() == anonymized.count() > 0
    body |= {"input_path2": None}
    path.write_text(json.dumps({k: v for k, v in body.items() if v is not None}))
    assert set(run_examine(spark, str(path), key="id")) == {"normal-table", score}


def test_examined_tables_are_dealt_out_and_predicted_once(spark):
    """Every pass over the predictions encoded the table anew, in one task where it came from one."""
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "1b")
    try:
        spec = JobSpec(model_name="k_means", kmeans_k=2, selected=(numeric("age"), category("race")))
        rows = spark.range(3000).select(
            F.col("id").cast("int"), (F.col("id") % 7).cast("int").alias("age"), F.concat(F.lit("r"), F.col("id") % 3).alias("race")
        )
        made = examine(rows.coalesce(1), None, spec, key="id")
        assert "UDF" not in made.normal._jdf.queryExecution().toString()
        assert len(made.normal.inputFiles()) > 1
        got = made.normal.select("id", "age", "race").collect()
        assert sorted(map(tuple, got)) == [(i, i % 7, f"r{i % 3}") for i in range(3000)]
        without = made.normal.columns.copy()
        without.remove("id")
        assert examine(rows.coalesce(1).drop("id"), None, spec).normal.columns == without
    finally:
        spark.conf.unset(size)


def test_examine_needs_a_key_for_its_cap(spark, tmp_path, csv_path):
    body = {"input_path": csv_path, "output_path": str(tmp_path), "model_name": "k_means", "num_sample_datas": 5}
    path = tmp_path / "job.json"
    path.write_text(json.dumps(body | {"selected_column": attrs(("age", "numeric")), "k_means": {"k": 2}}))
    with pytest.raises(ValueError, match="key column"):
        run_examine(spark, str(path))


def test_explore_job(spark, tmp_path, csv_path):
    path = tmp_path / "job.json"
    body = {"input_path": csv_path, "output_path": f"{tmp_path}/out", "selected_column": attrs(("age", "numeric"), ("sex", "category"))}
    path.write_text(json.dumps(body))
    out = run_explore(spark, str(path))
    assert {r.sex for r in read_csv(spark, out["sex"]).collect()} == {"Male", "Female"}
    assert {int(r.age) for r in read_csv(spark, out["age"]).collect()} == {r[1] for r in PEOPLE}


def test_tables_and_models(spark, tmp_path, people):
    write_csv(people, f"{tmp_path}/c", sep="|", header=False)
    back = read_csv(spark, f"{tmp_path}/c", schema=people.schema, header=False, sep="|")
    assert set(back.collect()) == set(people.collect())
    write_text(people.select("id", "age"), f"{tmp_path}/t")
    assert {r.value for r in read_text(spark, f"{tmp_path}/t").collect()} == {f"{r[0]},{r[1]}" for r in PEOPLE}
    assert [r.id for r in preview(people, ["id"], 3).collect()] == [1, 2, 3]
    model, found = kmeans(encode(people, ["age"]), 2, seed=1)
    save_model(model, f"{tmp_path}/m")
    again = load_model(KMeansModel, f"{tmp_path}/m").transform(encode(people, ["age"]))
    assert {(r.id, r.prediction) for r in found.collect()} == {(r.id, r.prediction) for r in again.collect()}


def test_small_tables_settle_and_large_ones_are_written(spark):
    df = spark.range(50)
    assert settle(df)[1] == 50
    large, size = settle(df, max_rows=10)
    assert size is None and large.count() == 50
    assert cut_lineage(df).inputFiles()[0].split("kveil-")[0].rstrip("/").endswith(
        ensure_checkpoint_dir(spark).rstrip("/").split("/")[-1]
    )


def test_job_folder_owns_what_a_job_writes(spark, people, tmp_path):
    from kveil.session import cut_lineage, job_folder, work_folder

    outside = work_folder(spark)
    with job_folder(spark, "mine") as path:
        assert work_folder(spark) == path and path.startswith(outside)
        inside = cut_lineage(people)
        assert all(f.split(":")[-1].lstrip("/").startswith(path.split(":")[-1].lstrip("/")) for f in inside.inputFiles())
    assert work_folder(spark) == outside and inside.count() == people.count()
