"""python -m martingrid: price one specification and print the result as JSON."""

from __future__ import annotations

import argparse
import dataclasses
import re

from pyspark.sql import SparkSession

from martingrid.functions.parse import DOUBLE_FORM, U64_FORM
from martingrid.operators.simulate import RunSpec, price
from martingrid.sources.documents import json_result
from martingrid.sources.runs import run_durable


def strict_int(text: str) -> int:
    if not re.fullmatch(U64_FORM, text) or int(text) >= 1 << 64:
        raise argparse.ArgumentTypeError("digits only, below 2^64")
    return int(text)


def strict_float(text: str) -> float:
    if not re.fullmatch(DOUBLE_FORM, text) or abs(float(text)) == float("inf"):
        raise argparse.ArgumentTypeError("a finite number in plain or exponent form")
    return float(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="martingrid", description="Monte Carlo price of a call")
    for f in dataclasses.fields(RunSpec):
        name = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(name, action="store_true")
        else:
            p.add_argument(name, type={"int": strict_int, "float": strict_float}.get(f.type, str), default=f.default)
    p.add_argument("--folder", help="keep the run there, and go on with it")
    return p


def main(arguments: list[str] | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    folder = given.pop("folder")
    spec = RunSpec(**given)
    spark = SparkSession.builder.appName("martingrid").getOrCreate()
    result = run_durable(spark, spec, folder) if folder else price(spark, spec)
    print(json_result(result).first()["document"])


if __name__ == "__main__":
    main()
