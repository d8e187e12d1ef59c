"""Functions that scripts know by name, as column expressions, and the registration of a user's own.

The typed variants of a name (INTABS, LONGSUM, STRINGMAX, ...) are the one function of any type.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def index_of(text: Column, found: str, start: int = 0) -> Column:
    """Place from 0 at or after ``start``, -1 if there is none."""
    return (F.locate(found, text, start + 1) - 1).cast("long")


def last_index_of(text: Column, found: str) -> Column:
    """Place from 0 of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(text), found[::-1])
    return F.when(back > 0, F.char_length(text) - back - len(found) + 1).otherwise(-1).cast("long")


def lc_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def uc_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def regex_extract(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def regex_extract_all(text: Column, pattern: str) -> Column:
    """All groups of a match of the whole text, null without one."""
    whole = f"^(?:{pattern})$"
    groups = [F.regexp_extract(text, whole, i + 1) for i in range(re.compile(pattern).groups)]
    return F.when(text.rlike(whole), F.array(*groups))


def substring(text: Column, start: int, stop: int) -> Column:
    """From place ``start`` up to but without ``stop``, from 0."""
    return F.substring(text, start + 1, max(0, stop - start))


def tokenize(text: Column) -> Column:
    """Words between white space, quotes, commas, brackets and asterisks."""
    return F.array_remove(F.split(text, r'[\s",()*]+'), "")


def arity(*columns: Column) -> Column:
    return F.lit(len(columns))


def is_empty(bag: Column) -> Column:
    return F.size(bag) == 0


def diff(left: Column, right: Column) -> Column:
    """Members of one bag that the other lacks, in both ways."""
    return F.concat(F.array_except(left, right), F.array_except(right, left))


def invoke(class_name: str, method: str, *args: Column) -> Column:
    """A static Java method of simple types, its result as text."""
    return F.java_method(F.lit(class_name), F.lit(method), *args)


#: Script names whose function Spark has under a name of its own, and those above.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ABS": F.abs, "ACOS": F.acos, "ASIN": F.asin, "ATAN": F.atan, "CBRT": F.cbrt, "CEIL": F.ceil, "COS": F.cos, "COSH": F.cosh, "EXP": F.exp, "FLOOR": F.floor, "LOG": F.ln, "LOG10": F.log10, "RANDOM": F.rand,
    "ROUND": F.round, "SIN": F.sin, "SINH": F.sinh, "SQRT": F.sqrt, "TAN": F.tan, "TANH": F.tanh,
    "CONCAT": F.concat, "STRINGCONCAT": F.concat, "INDEXOF": index_of, "LAST_INDEX_OF": last_index_of, "LCFIRST": lc_first, "UCFIRST": uc_first, "LOWER": F.lower, "UPPER": F.upper,
    "REGEX_EXTRACT": regex_extract, "REGEX_EXTRACT_ALL": regex_extract_all, "REPLACE": F.regexp_replace, "STRSPLIT": F.split, "SUBSTRING": substring, "TOKENIZE": tokenize, "TRIM": F.trim,
    "SIZE": F.size, "MAPSIZE": F.size, "BAGSIZE": F.size, "STRINGSIZE": F.char_length, "TUPLESIZE": arity, "ARITY": arity, "CONSTANTSIZE": lambda _: F.lit(1),
    "TOBAG": F.array, "TOTUPLE": F.struct, "TOMAP": F.create_map, "ISEMPTY": is_empty, "DIFF": diff, "FLATTEN": F.explode,
    "COUNT": F.count, "COUNT_STAR": lambda: F.count(F.lit(1)), "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "STRINGMIN": F.min, "STRINGMAX": F.max, "COR": F.corr, "COV": F.covar_pop,
}


def register(spark: SparkSession, name: str, function: Callable, returns: str, deterministic: bool = True) -> None:
    """``DEFINE name``: a user's function of pandas columns, for SQL text of this session. It runs on Arrow batches."""
    made = F.pandas_udf(function, returns)
    spark.udf.register(name, made if deterministic else made.asNondeterministic())
