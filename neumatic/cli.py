"""python -m neumatic.cli run|evaluate|embed SETTINGS.yml, or generate CHANTS.csv FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from neumatic.plans import experiment
from neumatic.sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("action", choices=["run", "evaluate", "embed", "generate"])
    parser.add_argument("path")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--seed", type=int, default=0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("neumatic").getOrCreate()
    if args.action == "generate":
        experiment.generate_datasets(tables.read_chants(spark, args.path), args.folder, args.seed)
        return
    settings = tables.read_settings(args.path)
    tables.start_log(settings.get("experiment_name", "experiment"), settings["results_dir"], **settings)
    {"run": experiment.run, "evaluate": experiment.evaluate, "embed": experiment.run_embeddings}[args.action](spark, **{k: v for k, v in settings.items() if k not in ("experiment_name", "description", *(["experiment_type", "n_iter", "n_splits", "random_state"] if args.action == "embed" else []))})


if __name__ == "__main__":
    main()
