"""python -m quarryline --stage all --dataset_name NAME --corpus_path ... --questions_path ..."""

import logging

from pyspark.sql import SparkSession

from quarryline.plans.options import parse
from quarryline.plans.stages import Run

if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    chosen = parse()
    Run(SparkSession.builder.appName("quarryline").getOrCreate(), chosen).stage(chosen.stage)
