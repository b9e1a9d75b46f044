"""Generators of training labels as table functions, callable from SQL and from DataFrames.

The output's columns follow from the input table: ``analyze`` looks them up, asks Spark
for the rows of a recording together and in order where a generator looks at neighbours,
and names a missing column in an error::

    register(spark)
    SELECT * FROM compound_supervision(TABLE(conversations), 'conv_id', 'turn', 'text')
    SELECT * FROM counterfactuals(TABLE(benchmark), 'text', 'the', 'this', 'of', 'from')
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .text import CLAUSE


def _columns(table: AnalyzeArgument, *names: AnalyzeArgument) -> tuple[T.StructType, list[str]]:
    """The input's columns, and the names that the caller stated."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    stated = [n.value for n in names]
    there = table.dataType.fieldNames()
    for n in stated:
        if n not in there:
            raise ValueError(f"no column {n!r}; there are {there}")
    return table.dataType, stated


def _made(schema: T.StructType, names: list[str]) -> T.StructType:
    """The named columns as they are, then ``kind`` and ``made``."""
    return T.StructType([schema[n] for n in names] + [T.StructField("kind", T.StringType()), T.StructField("made", T.StringType())])


class CompoundSupervision:
    """Compound labels of each two neighbours in a recording: in order, turned, the first alone, and put in other words."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, label: AnalyzeArgument) -> AnalyzeResult:
        schema, (k, o, _) = _columns(table, key, order, label)
        return AnalyzeResult(_made(schema, [k, o]), partitionBy=[PartitioningColumn(k)], orderBy=[OrderingColumn(o)])

    def __init__(self):
        self.before = None

    def eval(self, row, key: str, order: str, label: str):
        if self.before is not None and row[label] is not None:
            a, b = self.before[label], row[label]
            both = [x for x in (a, b) if x is not None]
            for kind, text in (("original", ", then ".join(both)), ("reorder", ", then ".join(both[::-1])), ("drop_claim", a), ("paraphrase", " and afterwards ".join(both))):
                yield self.before[key], self.before[order], kind, text
        self.before = row


class Counterfactuals:
    """Altered labels of each row, as :func:`.text.counterfactuals` makes them: wrong verb, wrong object, a claim dropped, claims turned, a claim added."""

    @staticmethod
    def analyze(table: AnalyzeArgument, label: AnalyzeArgument, verb: AnalyzeArgument, other_verb: AnalyzeArgument, thing: AnalyzeArgument, other_thing: AnalyzeArgument) -> AnalyzeResult:
        schema, _ = _columns(table, label)
        return AnalyzeResult(_made(schema, [n for n in schema.fieldNames()]))

    def eval(self, row, label: str, verb: str, other_verb: str, thing: str, other_thing: str):
        text = row[label]
        if text is None:
            return
        clauses = [c for c in re.split(CLAUSE, text.strip(" ")) if c.strip(" ")]
        made = []
        if verb in text:
            made.append(("wrong_verb", text.replace(verb, other_verb)))
        if thing in text:
            made.append(("wrong_object", text.replace(thing, other_thing)))
        if len(clauses) > 1:
            made += [("drop_claim", ", ".join(clauses[:-1])), ("reorder", ", ".join(clauses[::-1]))]
        made.append(("add_claim", f"{text}, {other_verb} {other_thing}"))
        for kind, new in made:
            if new != text:
                yield (*row, kind, new)


compound_supervision = F.udtf(CompoundSupervision)
counterfactuals = F.udtf(Counterfactuals)


def register(spark: SparkSession) -> None:
    """Both under their names for SQL."""
    spark.udtf.register("compound_supervision", compound_supervision)
    spark.udtf.register("counterfactuals", counterfactuals)


def compounds_of(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """The DataFrame form of ``compound_supervision``."""
    return compound_supervision(rows.asTable(), F.lit(key), F.lit(order), F.lit(label))
