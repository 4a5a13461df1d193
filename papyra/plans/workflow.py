"""The configured step sequence as one chain of DataFrames.

Steps are looked up by name; an unknown step logs a warning and is skipped,
as in the reference's workflow runner. Each step consumes the previous
step's output from ``state``; with ``persist`` (the default) a step's output
table is written once to the shared checkpoint folder, as the reference
writes its processed files, so later steps read it instead of re-deriving it.
"""

from __future__ import annotations

import hashlib
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("papyra.workflow")


def _keep(state, p, name, df):
    from papyra.session import materialize
    if p.get("run_dir"):
        from papyra.sources.commits import commit
        state[name] = commit(df, f"{p['run_dir']}/{name}", name, p["_fingerprint"], again=p["_again"])
    else:
        state[name] = materialize(df, f"step-{name}") if p.get("persist", True) else df


def _extract(spark, state, p):
    from papyra.operators.extract import page_articles
    from papyra.sources.readers import read_table
    _keep(state, p, "page_articles",
          page_articles(read_table(spark, p["sf_dir"], "pages", "page_id", "url", "html")))


def _prepare(spark, state, p):
    """Kept samples and omitted articles from one pass over the articles."""
    from papyra.operators.clean import assessed_samples
    from papyra.plans.views import articles
    a = state.get("articles")
    if a is None:
        a = articles(spark, p["sf_dir"])
    _keep(state, p, "assessed", assessed_samples(a, p.get("ws_mode", "parity"), p.get("drop_zero_idx", True)))
    _prepared(spark, state, p)


def _prepared(spark, state, p):
    done = state["assessed"]
    state["samples"] = done.where("omit_reason IS NULL").drop("omit_reason")
    state["omitted"] = done.where("omit_reason IS NOT NULL").drop("x")
    state["omissions"] = (done.groupBy(F.coalesce("omit_reason", F.lit("kept")).alias("reason"))
                          .agg(F.count(F.lit(1)).alias("n")))


def _split(spark, state, p):
    from papyra.operators.dataset import train_eval_split
    if "samples" not in state:
        _prepare(spark, state, p)
    _keep(state, p, "split", train_eval_split(state["samples"], seed=p.get("seed", 42),
                                              test_size=p.get("test_size", 0.1)))


def _tokenize(spark, state, p):
    from papyra.operators.dataset import tokenize, truncate, vocabulary
    from papyra.sources.readers import read_table
    if "split" not in state:
        _split(spark, state, p)
    _keep(state, p, "vocab", vocabulary(read_table(spark, p["sf_dir"], "documents", "text"), p.get("vocab_size")))
    tok = tokenize(state["split"].select("idx", "split", "split_rank", "x"), state["vocab"])
    # whole texts unless the caller asks for a cut
    _keep(state, p, "tokenized", truncate(tok, p["max_length"]) if p.get("max_length") else tok)


def _eval(spark, state, p):
    from papyra.plans.queries import evaluate
    if "split" not in state:
        _split(spark, state, p)
    results, summary = evaluate(spark, p["sf_dir"], state["split"])
    if p.get("run_dir"):
        _keep(state, p, "eval_results", results)
        _keep(state, p, "eval_summary", summary)
        state["eval_summary"] = state["eval_summary"].orderBy("model_pos")
    else:
        state["eval_results"], state["eval_summary"] = results, summary


STEPS = {"extract": _extract, "prepare": _prepare, "split": _split, "tokenize": _tokenize, "eval": _eval}
# what a step leaves, the tables that it reads, and what follows from its outputs without work
OUTPUTS = {"extract": ["page_articles"], "prepare": ["assessed"], "split": ["split"], "tokenize": ["vocab", "tokenized"],
           "eval": ["eval_results", "eval_summary"]}
INPUTS = {"extract": ["pages"], "prepare": ["documents"], "split": ["documents"], "tokenize": ["documents"],
          "eval": ["documents", "conversations", "embeddings"]}
DERIVED = {"prepare": _prepared}


def _fingerprint(spark: SparkSession, step: str, params: dict) -> str:
    from papyra.session import table_path
    from papyra.sources.commits import input_fingerprint
    own = {k: v for k, v in params.items() if k not in ("sf_dir", "run_dir", "regenerate", "persist") and k[0] != "_"}
    files = input_fingerprint(spark, [table_path(params["sf_dir"], t) for t in INPUTS[step]])
    return hashlib.md5(json.dumps([step, own, files], sort_keys=True, default=str).encode()).hexdigest()[:16]


def _resumed(spark: SparkSession, step: str, p: dict) -> dict[str, DataFrame] | None:
    """The committed outputs of a step, or None if one of them is not there."""
    from papyra.sources.commits import committed
    found = {name: committed(spark, f"{p['run_dir']}/{name}", name, p["_fingerprint"]) for name in OUTPUTS[step]}
    return None if None in found.values() else {name: spark.read.parquet(c["folder"]) for name, c in found.items()}


def run_steps(spark: SparkSession, steps: list[str], params: dict) -> dict[str, DataFrame]:
    from papyra.session import ship_package
    ship_package(spark)
    state: dict[str, DataFrame] = {}
    for step in steps:
        fn = STEPS.get(step)
        if fn is None:
            LOG.warning("Unknown workflow step: %s. Skipping.", step)
            continue
        p = dict(params)
        if p.get("run_dir"):
            regenerate = p.get("regenerate", False)
            p["_fingerprint"] = _fingerprint(spark, step, p)
            p["_again"] = regenerate if isinstance(regenerate, bool) else step in regenerate
            done = None if p["_again"] else _resumed(spark, step, p)
            if done is not None:
                LOG.info("Step %s is done already", step)
                state |= done
                DERIVED.get(step, lambda *a: None)(spark, state, p)
                continue
        LOG.info("Running step: %s", step)
        fn(spark, state, p)
    return state
