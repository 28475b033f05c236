"""Experiments from the command line (X07-X11): ``python -m marginalia.cli --help`` or through spark-submit."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace

from pyspark.sql import SparkSession

from marginalia.operators.evaluate import Evaluator
from marginalia.operators.mechanisms import AIM, MST, MWEM, KWay
from marginalia.operators.particles import ParticleInference, measured_constraint
from marginalia.operators.pgm import FactoredInference
from marginalia.plans.privacy import Budget
from marginalia.plans.schema import all_kway
from marginalia.sources.tables import Dataset, append_result, write_synthetic

#: Presets of mechanism and engine.
PRESETS = {"particles": ("kway", "particles"), "aim": ("aim", "graphical"), "mst": ("mst", "graphical")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Private synthetic rows of a coded table, and how far they are from it.")
    p.add_argument("--preset", choices=PRESETS)
    p.add_argument("--mechanism", choices=("kway", "mst", "mwem", "aim"), default="kway")
    p.add_argument("--engine", choices=("graphical", "particles"), default="graphical")
    p.add_argument("--data", required=True)
    p.add_argument("--domain", required=True)
    p.add_argument("--out")
    p.add_argument("--results")
    p.add_argument("--epsilon", type=float, default=2.5)
    p.add_argument("--delta", type=float, default=1e-5)
    p.add_argument("--unbounded", action="store_true")
    p.add_argument("--degree", type=int, default=2)
    p.add_argument("--num-marginals", type=int)
    p.add_argument("--records", type=int)
    p.add_argument("--iters", type=int, default=1000)
    p.add_argument("--lr", type=float)
    p.add_argument("--n-particles", type=int, default=100_000)
    p.add_argument("--batch-size", type=int, default=5)
    p.add_argument("--num-projections", type=int, default=10)
    p.add_argument("--p-mask", type=float, default=80.0)
    p.add_argument("--scale-reg", type=float, default=0.0)
    p.add_argument("--iters-proj", type=int, default=1750)
    p.add_argument("--num-projections-proj", type=int, default=200)
    p.add_argument("--rounds", type=int)
    p.add_argument("--max-model-mb", type=float, default=1000.0)
    p.add_argument("--warm-start", action="store_true")
    p.add_argument("--seed", type=int, help="for runs that repeat; a release leaves it out")
    p.add_argument("--constraint", help="JSON file of threshold queries: thetas (rows over the attributes), taus and sigma")
    p.add_argument("--constraint-epsilon", type=float, default=0.5)
    p.add_argument("--constraint-delta", type=float, default=2e-6)
    return p


def make(args: argparse.Namespace, domain):
    """Mechanism and engine; the particle engine goes with K-Way only, as the others need a model that answers marginals."""
    if args.preset:
        args.mechanism, args.engine = PRESETS[args.preset]
    if args.engine == "particles" and args.mechanism != "kway":
        raise ValueError("the particle engine works with the K-Way mechanism only")
    if args.scale_reg and not args.constraint:
        raise ValueError("--scale-reg weighs the queries of --constraint")
    seed = {} if args.seed is None else {"seed": args.seed}
    budget = Budget(args.epsilon, args.delta, not args.unbounded, **seed)
    mechanism = {"kway": lambda: KWay(budget), "mst": lambda: MST(budget), "mwem": lambda: MWEM(budget, args.rounds or 100, args.max_model_mb), "aim": lambda: AIM(budget, args.rounds, args.max_model_mb)}[args.mechanism]()
    if args.engine == "particles":
        return mechanism, ParticleInference(domain, args.n_particles, args.iters, args.lr or 0.1, args.batch_size, args.num_projections, args.p_mask, proj_iters=args.iters_proj, proj_directions=args.num_projections_proj, seed=budget.seed, scale_reg=args.scale_reg)
    return mechanism, FactoredInference(domain, args.iters, args.lr or 1.0, args.warm_start)


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    data = Dataset.load(spark, args.data, args.domain)
    workload = all_kway(data.domain, args.degree, args.num_marginals, args.seed or 0)
    mechanism, engine = make(args, data.domain)
    if args.constraint:  # X10: a budget of its own, besides that of the marginals
        if args.engine != "particles":
            raise ValueError("constraints work with the particle engine only")
        with open(args.constraint) as f:
            asked = json.load(f)
        own = replace(mechanism.budget, epsilon=args.constraint_epsilon, delta=args.constraint_delta, seed=mechanism.budget.seed + 1)
        engine.constraint = measured_constraint(data.df, data.domain, asked["thetas"], asked["taus"], own, asked.get("sigma", 5.0))
    began = time.time()
    synth = mechanism.run(data.df, data.domain, engine, workload, args.records)
    if args.out:
        write_synthetic(synth, args.out)
        synth = spark.read.csv(args.out, header=True, schema=synth.schema)
    metrics, _ = Evaluator(data.df, synth, data.domain, workload).evaluate()
    row = {k: v for k, v in vars(args).items() if v is not None} | {"time": time.time() - began, "loss": float(getattr(engine, "final_loss", 0.0))} | metrics
    if args.results:
        append_result(spark, row, args.results)
    print(row)
    return row


if __name__ == "__main__":
    main()
