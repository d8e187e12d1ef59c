"""The cube as a job with arguments: ``-input -output -year [-type normal] [-reducers 1]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.cube import MODES, cube
from ..operators.normalize import normalize
from ..sources.tables import read_containers, write_facet_text

# Names of the cube's modes on the command line.
TYPES = {"normal": "normal", "explicitDate": "explicit_month", "wildcardDate": "wildcard_month"}


def arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cube", exit_on_error=False)
    parser.add_argument("-input", required=True, help="paths of containers, separated by commas")
    parser.add_argument("-output", required=True, help="folder of the delimited text")
    parser.add_argument("-year", required=True, type=int)
    parser.add_argument("-type", default="normal", choices=sorted(TYPES))
    parser.add_argument("-reducers", default=1, type=int, help="number of output files")
    return parser.parse_args(args)


def run(spark: SparkSession, args: list[str]) -> str:
    """Reads containers, writes the cube's cells as text, returns the folder."""
    a = arguments(args)
    mode = TYPES[a.type]
    assert mode in MODES
    facets = cube(normalize(read_containers(spark, a.input), a.year), mode)
    write_facet_text(facets.repartition(a.reducers), a.output)
    return a.output
