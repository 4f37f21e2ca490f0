"""Query trees as one scan and one aggregation over the postings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.heavy_keys import with_prefix
from palimpsest.plans.query import Group, Query, SearchConfig, Term, parse
from palimpsest.schemas import RESULT
from palimpsest.session import checkpointed

ONE_TASK = 200_000  # results that one task may number
MOST_COLUMNS = 100  # terms counted in columns of their own; beyond, the terms are joined


def can_match(term: Term, config: SearchConfig) -> bool:
    return term.exact or len(term.word) > config.min_char


def condition(term: Term) -> Column:
    """The words that a term stands for. The letter lets the scan skip partitions."""
    same = F.col("word") == term.word if term.exact else F.col("word").startswith(term.word)
    return (F.col("letter") == term.word[0]) & same


def _counts_in_columns(postings: DataFrame, terms: list[Term]) -> tuple[DataFrame, dict[Term, Column]]:
    wanted = reduce(Column.__or__, map(condition, terms))
    counts = [F.count_if(condition(t)).alias(f"n{i}") for i, t in enumerate(terms)]
    hits = postings.where(wanted).groupBy("path_id").agg(*counts)
    return hits, {t: F.col(f"n{i}") for i, t in enumerate(terms)}


def _counts_in_map(postings: DataFrame, terms: list[Term]) -> tuple[DataFrame, dict[Term, Column]]:
    """The same by a join with the terms; their number is bounded by the length of the query."""
    spark = postings.sparkSession
    asked = spark.createDataFrame([(i, t.word, t.exact, t.word[0]) for i, t in enumerate(terms)], "id int, term string, exact boolean, first string")
    met = (F.col("letter") == F.col("first")) & F.when(F.col("exact"), F.col("word") == F.col("term")).otherwise(F.col("word").startswith(F.col("term")))
    by_term = postings.join(F.broadcast(asked), met).groupBy("path_id", "id").agg(F.count(F.lit(1)).alias("n"))
    hits = by_term.groupBy("path_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("n"))
    return hits, {t: F.coalesce(F.try_element_at("n", F.lit(i)), F.lit(0)) for i, t in enumerate(terms)}


def _fold(group: Group, counts: dict[Term, Column]) -> tuple[Column, Column]:
    """(found, score) of a group; whatever is not found has score 0."""
    none = F.lit(0).cast("long")
    found, score = F.lit(False), none
    for operator, operand in group.steps:
        if isinstance(operand, Group):
            right, points = _fold(operand, counts)
        else:
            points = counts.get(operand, none)
            right = points > 0
        if operator == "AND":
            found, score = found & right, F.when(found & right, score + points).otherwise(none)
        elif operator == "NOT":
            found, score = found & ~right, F.when(right, none).otherwise(score)
        else:
            found, score = found | right, score + points
    return found, score


def no_results(postings: DataFrame) -> DataFrame:
    return postings.sparkSession.createDataFrame([], "path_id long, count long")


def search(postings: DataFrame, query: Query | str, config: SearchConfig = SearchConfig(), most_columns: int = MOST_COLUMNS) -> DataFrame:
    """(path_id, count) of the paths that a query finds, in no order.

    `postings` has letter, word and path_id, each pair of word and path once.
    A malformed query, and one without a term that can match, finds nothing.
    """
    parsed = parse(query, config) if isinstance(query, str) else query
    terms = [t for t in parsed.terms if can_match(t, config)] if parsed else []
    if not terms:
        return no_results(postings)
    hits, counts = (_counts_in_columns if len(terms) <= most_columns else _counts_in_map)(postings, terms)
    found, score = _fold(parsed.tree, counts)
    return hits.select("path_id", found.alias("found"), score.cast("long").alias("count")).where("found").select("path_id", "count")


def relational(postings: DataFrame, query: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The same by unions and joins of path sets, to hold the plan above against."""
    parsed = parse(query, config)
    if parsed is None:
        return no_results(postings)

    def of(operand: Term | Group) -> DataFrame:
        if isinstance(operand, Term):
            if not can_match(operand, config):
                return no_results(postings)
            return postings.where(condition(operand)).groupBy("path_id").agg(F.count(F.lit(1)).alias("count"))
        out = no_results(postings)
        for operator, right in operand.steps:
            r = of(right)
            if operator == "AND":
                both = out.join(r.withColumnRenamed("count", "more"), "path_id")
                out = both.select("path_id", (F.col("count") + F.col("more")).alias("count"))
            elif operator == "NOT":
                out = out.join(r, "path_id", "left_anti")
            else:
                out = out.unionByName(r).groupBy("path_id").agg(F.sum("count").alias("count"))
        return out

    return of(parsed.tree)


def ranked(found: DataFrame, paths: DataFrame, limit: int | None = None) -> DataFrame:
    """(rank, path_id, path, count): best first, from 0; equal counts in order of path_id.

    A path id without a path has an empty one. With a limit only that many
    rows are numbered. Up to ONE_TASK rows are numbered in one task; the ranks
    of more come from stitched partitions.
    """
    found = found.select("path_id", "count")
    if limit is not None:
        found = found.orderBy(F.desc("count"), "path_id").limit(limit)
        small = limit <= ONE_TASK
    else:
        found = checkpointed(found)  # counted and then numbered: the search runs once
        small = found.limit(ONE_TASK + 1).count() <= ONE_TASK
    if small:
        numbered = found.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("count"), "path_id")) - 1).cast("long"))
    else:
        numbered = with_prefix(found.withColumn("__down", -F.col("count")), [], ["__down", "path_id"])
    named = numbered.join(paths.select("path_id", "path"), "path_id", "left")
    return named.select("rank", "path_id", F.coalesce("path", F.lit("")).alias("path"), "count").select(*RESULT.names)


def result_lines(results: DataFrame, most: int | None = None) -> Iterator[str]:
    """The lines of a result page, all of them unless `most` is given.

    The driver takes in one partition of the ordered rows at a time.
    """
    rows, none = results.orderBy("rank"), True
    for r in (rows if most is None else rows.limit(most)).toLocalIterator():
        none = False
        # fixed values: the words of a result line and of an empty page
        yield f"\n {r['rank']}. {r['path']} with {r['count']} matches.\n"
    if none:
        yield "\nNo results found.\n"


def formatted(results: DataFrame, most: int | None = None) -> str:
    return "".join(result_lines(results, most))
