"""Whole documents judged where they lie: the results of the joins over leaf tables, with one shuffle of the rows they are made of."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataline.operators import align, judge, metrics
from strataline.plans import bindings as B
from strataline.plans import reference_queries as queries
from strataline.session import checkpoint_dir

NAMES = ["array_greedy_match", "error_type_breakdown", "file_metrics", "judge_leaf_left", "precision_pivot", "unexpected_anti", "array_scores", "error_type_totals", "incorrect_examples", "overall_metrics", "section_error_types", "details_full", "failed_patterns", "section_metrics"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders with many, no and unknown lines, twice in the table, with ties, texts to level and without a key."""
    at = str(tmp_path_factory.mktemp("together"))
    rng = random.Random(3)
    day = lambda: datetime.datetime(1995, 1, 1) + datetime.timedelta(days=rng.randint(0, 4))
    keys = [*range(1, 400), 7, 7, 12, None, -5]
    orders = [(k, rng.randint(1, 9), rng.choice(["O", "F", "( )", "P:1"]), round(rng.random() * 50, 2), day(), rng.choice(["1-URGENT", "5-LOW", "4-NOT SPECIFIED"])) for k in keys]
    lines = [(k, rng.randint(1, 5), rng.randint(1, 3), n if rng.random() < 0.9 else 1, float(rng.randint(1, 4)), float(rng.randint(1, 9)), 0.1, 0.0, rng.choice("RAN"), "O", day()) for k in [*range(1, 390), -5, 900, 901] for n in range(1, rng.randint(0, 6) + (60 if k == 40 else 0) + 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{at}/lineitem.parquet")
    return at, len(orders) + len(lines)


@pytest.fixture(scope="module")
def joins(spark, folder):
    """(truth, predictions, details, files) as the leaf tables give them."""
    truth, pred = (judge.with_norm(x, ascii_only=True).cache() for x in B.truth_and_pred(spark, folder[0]))
    labels = pred.select(queries.paths.strip_indices(judge.field_path(F.col("idx"), F.col("rel"))).alias("label")).distinct()
    files = pred.where("doc is not null").select(*B.RUN, "doc").distinct().withColumn("retry_count", (F.col("doc") % 3).cast("int"))
    d = judge.details(truth, pred, B.RUN, labels).cache()
    d.count()
    return truth, pred, d, files


def expected(joins, name):
    truth, pred, d, files = joins
    wrong = d.where("status = 'incorrect'")
    lines = truth.join(pred.where("idx is not null").select(*B.RUN, "doc").distinct(), "doc")
    return {
        "array_greedy_match": lambda: judge.alignment(truth, pred, B.RUN),
        "array_scores": lambda: align.overlap_scores(lines, pred, ["doc", *B.RUN]),
        "judge_leaf_left": lambda: judge.truth_pass(truth, pred, judge.alignment(truth, pred, B.RUN), B.RUN).drop("pass", "fno", "error_type"),
        "unexpected_anti": lambda: judge.prediction_pass(truth, pred, B.RUN).select(*B.RUN, "doc", "idx", "rel", "llm_value"),
        "details_full": lambda: d,
        "file_metrics": lambda: metrics.metrics(d, [*B.RUN, "doc"]),
        "overall_metrics": lambda: metrics.overall(d, files, B.RUN),
        "section_metrics": lambda: metrics.sections(d, B.RUN),
        "section_error_types": lambda: wrong.groupBy(*B.RUN, "section", "error_type").agg(F.count("*").alias("n")),
        "error_type_totals": lambda: wrong.groupBy(*B.RUN, "error_type").agg(F.count("*").alias("n")),
        "precision_pivot": lambda: metrics.precision_pivot(d, B.RUN, B.RUN_NAMES),
        "failed_patterns": lambda: metrics.failed_patterns(d, B.RUN, queries._DROP),
        "error_type_breakdown": lambda: metrics.error_breakdown(d, files),
        "incorrect_examples": lambda: wrong.select(*B.RUN, F.col("doc").alias("file"), "pass", "field", "error_type", "xml", "llm_value"),
    }[name]()


def written(spark):
    """Bytes shuffled so far and bytes of checkpoints."""
    kept = Path(checkpoint_dir(spark).removeprefix("file:"))
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() + sum(p.stat().st_size for p in kept.rglob("part-*"))


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("name", NAMES)
def test_one_shuffle_of_rows(spark, folder, joins, name):
    """Shuffled is what the orders and lines take, not their leaves in every run; the rows are those of the joins."""
    want = rows(expected(joins, name))
    before = written(spark)
    df = queries.QUERIES[name](spark, folder[0])
    got = rows(df)
    assert written(spark) - before < 150 * folder[1]
    assert len(want) > 1 and got == want


def test_documents_with_more_pairs_than_are_held(spark, folder, monkeypatch):
    """Runs one after the other, and scores counted by truth elements, say the same."""
    import pyarrow as pa

    from strataline.operators import together

    t = pa.Table.from_batches(B.documents(spark, folder[0]).toArrow().to_batches())

    def found():
        got = []
        for leaves in B.leaves_of(t):
            j = together.Judged(leaves)
            scores = [x for b in j.scores() for x in zip(*map(list, b), strict=True)]
            first = j.p_first
            got += [("score", *leaves.runs[g % j.n_runs], g // j.n_runs, a, p - first[g], n) for g, a, p, n in scores]
            got += [("pair", *leaves.runs[g % j.n_runs], g // j.n_runs, a, p - first[g]) for g, a, p in zip(*j.matches(), strict=True)]
        return sorted(map(repr, got))

    whole = found()
    monkeypatch.setattr(together, "PAIRS", 200)
    assert found() == whole
    monkeypatch.setattr(B, "_AT_ONCE", 10)
    assert found() == whole and len(whole) > 1000
