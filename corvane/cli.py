"""Command line: doctor, preprocess, train, index build, index info, search, evaluate."""

from __future__ import annotations

import argparse
import json
import sys

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane import api, log
from corvane.config import FIELDS, MODELS, POOLINGS, Settings
from corvane.operators import evaluate
from corvane.errors import CorvaneError
from corvane.runtime import check_memory, system_report
from corvane.session import session
from corvane.sources import corpus, store


def positive(text: str) -> int:
    """A whole number of 1 or more, as an argument."""
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text!r} is not a whole number of 1 or more")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("--corpus", help="CSV export, a file or a folder")
    p.add_argument("--root", help="folder of all artefacts")
    p.add_argument("--log-json", action="store_true", help="log as JSON lines")
    sub = p.add_subparsers(dest="command", required=True)
    choices = {"model": MODELS, "field": FIELDS, "pooling": POOLINGS}

    def command(parent, name: str, *options: str) -> argparse.ArgumentParser:
        c = parent.add_parser(name)
        for o in options:
            if o in choices:
                c.add_argument(f"--{o}", choices=choices[o])
            elif o == "limit":
                c.add_argument("--limit", type=positive)
            else:
                c.add_argument(f"--{o}", action="store_true")
        return c

    command(sub, "doctor", "full")
    command(sub, "preprocess", "field", "limit", "force")
    command(sub, "train", "model", "field", "limit", "force")
    index = sub.add_parser("index").add_subparsers(dest="action", required=True)
    command(index, "build", "model", "field", "limit", "pooling")
    command(index, "info", "model", "field", "pooling")
    s = command(sub, "search", "model", "field", "limit", "pooling", "json")
    s.add_argument("query")
    s.add_argument("--top", "-k", type=positive, dest="top_n")
    s.add_argument("--union", action=argparse.BooleanOptionalAction)
    e = command(sub, "evaluate", "model", "field", "limit", "pooling", "no-baseline", "both")
    e.add_argument("--eval-file", required=True)
    e.add_argument("--timed", type=positive, default=20, help="queries asked one by one for latencies")
    e.add_argument("--report", help="folder for the means as JSON")
    return p


def _doctor(spark, settings: Settings, full: bool) -> int:
    found = api.check_artefacts(spark, settings).collect()  # a handful of findings
    for r in found:
        print(r["severity"], r["code"], r["subject"])
    if full:
        for name, value in system_report(spark).items():
            print(name, value)
        for step in ("preprocess", "train", "index", "search"):
            print(step, "memory", "enough" if check_memory(spark, settings, step) else "short")
        if store.exists(spark, settings.root):
            for r in store.sizes(spark, settings.root).orderBy("folder").collect():  # a row per folder
                print(r["folder"], r["files"], "files", r["bytes"], "bytes")
        if store.exists(spark, settings.corpus):
            bad = api.load_rejects(spark, settings).groupBy("reason").count().collect()  # a row per reason
            print("rejected records:", {r["reason"]: r["count"] for r in bad})
    return int(any(r["severity"] == "ERROR" for r in found))


def _evaluate(spark, settings: Settings, a) -> int:
    numbered = Window.orderBy("query_text")  # judged queries are a short list
    judged = corpus.read_judgements(spark, a.eval_file).withColumn("query_id", F.row_number().over(numbered))
    models = MODELS if a.both else (settings.model,)
    engines = [api.load_engine(spark, replace(settings, model=m), limit=a.limit) for m in models]
    means = api.run_evaluation(engines, judged, baseline=not a.no_baseline, timed=a.timed, report=a.report)
    means = spark.createDataFrame(means.collect(), means.schema)  # a row per method and k, computed once
    means.show(50, truncate=False)
    best = evaluate.best_method(means).first()
    p95 = means.filter(F.col("method") == best["method"]).agg(F.max("p95")).first()[0]
    gate = evaluate.check_targets(means.filter((F.col("method") == best["method"]) & (F.col("k") == 10)), p95).collect()
    for r in gate:
        print(r["target"], r["value"], "wanted", r["wanted"], "met" if r["met"] else "missed")
    return int(not all(r["met"] for r in gate))


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    given = {k: getattr(a, k, None) for k in ("corpus", "root", "model", "field", "pooling", "top_n", "union")}
    limit = getattr(a, "limit", None)
    try:
        settings = Settings.from_env(**given)
        log.configure(as_json=a.log_json)
        spark = spark or session("corvane")
        if a.command == "doctor":
            return _doctor(spark, settings, a.full)
        if a.command == "preprocess":
            print(api.run_preprocessing(spark, settings, limit=limit, force=a.force).count(), "documents")
        elif a.command == "train":
            print(json.dumps(api.train_model(spark, settings, limit=limit, force=a.force)))
        elif a.command == "index" and a.action == "build":
            print(json.dumps(api.build_index(spark, settings, limit=limit)))
        elif a.command == "index":
            print(json.dumps(store.read_json(spark, f"{settings.index_path()}/manifest.json")))
        elif a.command == "search":
            api.verify_or_warn(spark, settings)
            engine = api.load_engine(spark, settings, limit=limit)
            hits = engine.search(a.query)
            rows = hits.collect()  # top-k rows
            if a.json:
                print(json.dumps([r.asDict() for r in rows], ensure_ascii=False))
            elif rows:
                spark.createDataFrame(rows, hits.schema).drop("abstract", "query_id").show(len(rows), truncate=80)
            else:
                print(engine.reasons(a.query, hits).first()["reason"])
        elif a.command == "evaluate":
            return _evaluate(spark, settings, a)
    except CorvaneError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
