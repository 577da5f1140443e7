"""Memory checks, stage log, legacy vector files, arrival of files."""

import csv
import json
import logging

import pytest

from corvane import api, log, runtime
from corvane.config import Settings
from corvane.errors import ConfigurationError, ResourceError, SchemaError
from corvane.operators import vectors
from corvane.plans import materialize
from corvane.sources import legacy
from corvane.streaming import arrival


def test_sizes_and_floors(spark):
    assert [runtime.megabytes(x) for x in ("4g", "512m", "2048k", "7")] == [4096, 512, 2, 7]
    with pytest.raises(ResourceError):
        runtime.megabytes("much")
    s = Settings()
    assert runtime.needed_mb(s, "train") > runtime.needed_mb(s, "index") > runtime.needed_mb(s, "preprocess")
    assert runtime.needed_mb(s, "train", limit=10) < runtime.needed_mb(s, "train")
    with pytest.raises(ResourceError):
        runtime.needed_mb(s, "dance")
    assert runtime.available_mb(spark) == 1024 and runtime.check_memory(spark, s, "preprocess")
    assert not runtime.check_memory(spark, Settings(vector_size=1000), "train")
    with pytest.raises(ResourceError):
        runtime.check_memory(spark, Settings(vector_size=1000), "train", strict=True)
    assert runtime.system_report(spark)["master"].startswith("local")


def test_stage_log(capsys):
    log.configure(as_json=True)
    with log.stage("one"):
        pass
    with pytest.raises(ValueError), log.stage("two"):
        raise ValueError
    lines = [json.loads(x) for x in capsys.readouterr().err.strip().splitlines()]
    assert [(x["stage"], x["failed"]) for x in lines] == [("one", False), ("two", True)] and all(x["driver_mb"] > 0 for x in lines)
    logging.getLogger("corvane").handlers.clear()


def test_vector_columns(spark, tmp_path):
    rows = [(3, [1.0, 2.5]), (10, [0.0, -1.0]), (7, [4.0])]
    legacy.write_vector_columns(spark.createDataFrame(rows, "doc_id bigint, v array<double>"), f"file://{tmp_path}/v")
    assert sorted(tuple(r) for r in legacy.read_vector_columns(spark, f"file://{tmp_path}/v").collect()) == sorted(rows)
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(SchemaError):
        legacy.read_vector_columns(spark, f"file://{tmp_path}/x.csv")
    none = vectors.or_zero(spark.createDataFrame([(1, None)], "doc_id bigint, v array<double>"), 3)
    assert none.first()["v"] == [0.0] * 3


def test_scratch_needs_a_shared_folder(spark, monkeypatch, tmp_path):
    """Off one machine a temporary folder won't do; the context's checkpoint folder counts."""
    class Context:
        master, applicationId, kept = "spark://host:7077", "app", None
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d=None: d)}))
        getCheckpointDir = classmethod(lambda cls: cls.kept)

    session = type("S", (), {"sparkContext": Context, "conf": type("R", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(ConfigurationError):
        materialize.shared_dir(session)
    Context.kept = "hdfs://shared/x/"
    assert materialize.shared_dir(session) == "hdfs://shared/x"
    table = materialize.materialize(spark.range(3), "some")
    assert table.count() == 3
    materialize.discard(table)
    materialize.discard(spark.range(1))
    assert materialize.materialize(spark.range(3).filter("id > 5"), "none").count() == 0


def test_arriving_files_are_trained_and_indexed(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, ids):
        with open(tmp_path / "in" / name, "w", newline="") as f:
            csv.writer(f).writerows([["Date added", "Trial ID", "Title", "Brief title", "Abstract", "Publication date", "Phase"], *[["2020-01-01", f"NCT{i:08d}", f"t {i}", "", "lung injury in adults", "2020-02-02", ""] for i in ids]])

    s = Settings(corpus=f"{tmp_path}/in", root=f"file://{tmp_path}/out", model="skipgram", vector_size=4, epochs=1, min_count=1)
    made = []
    for name, ids in (("a.csv", range(4)), ("b.csv", range(4, 9))):
        put(name, ids)
        arrival.on_arrival(spark, s, checkpoint=f"{tmp_path}/check", done=made.append).awaitTermination()
    arrival.on_arrival(spark, s, checkpoint=f"{tmp_path}/check", done=made.append).awaitTermination()
    assert [m["rows"] for m in made] == [4, 9]
    with api.load_engine(spark, s) as engine:
        assert engine.size == 9 and engine.search("nct00000008").first()["trial_id"] == "NCT00000008"
