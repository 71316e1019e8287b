"""Word checks and name graphs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookups import is_small, small_broadcast


def check_last_word(df: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """df with flag, grade and word: is the last comma-separated token one of `words` (word)?"""
    known = words.select(F.trim("word").alias("_known")).where("_known <> ''").distinct()
    token = F.trim(F.element_at(F.split(text, ","), -1))
    joined = df.withColumn("_token", token).join(known, F.col("_token") == F.col("_known"), "left")
    hit = F.col("_known").isNotNull()
    return joined.select(*df.columns, hit.cast("int").alias("flag"), F.when(hit, F.lit("P0")).alias("grade"), F.col("_known").alias("word"))


def name_mentions(df: DataFrame, key: list[str], text: str, names: DataFrame) -> DataFrame:
    """(key, name): the names (name) among the words of each text, each once; a hash join by word."""
    found = df.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("name"))
    return found.join(names.select("name").distinct(), "name").select(*key, "name")


#: Letters of the pieces by which texts are indexed; shorter names are pieces themselves.
PIECE = 4


def _pieces(chars: str, n: int) -> Column:
    """All runs of n letters of an array of letters."""
    run = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
    return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), run)).otherwise(F.array().cast("array<string>"))


def names_inside(df: DataFrame, key: list[str], text: str, names: DataFrame) -> DataFrame:
    """(key, name): the names that each text holds anywhere, also inside a longer run of letters, each once.

    For texts without blanks between words. A name is looked for by its rarest
    piece of PIECE letters: pieces of the texts are counted first (those that
    names have), each name takes the one that fewest texts hold, and only the
    texts that hold it are searched for the name itself. Time is in proportion
    to the texts, whatever the names' lengths. key identifies a text, and no part
    of it may be null; null texts hold nothing. Names are broadcast if they are
    few, texts and their pieces never: compressed files of texts look small.
    """
    known = names.select("name").where("name <> ''").distinct().withColumn("letters", F.regexp_extract_all("name", F.lit("(?s)."), F.lit(0)))
    sizes = [n for n in range(1, PIECE + 1)]
    short = lambda n: F.size("letters") >= PIECE if n == PIECE else F.size("letters") == n
    of_name = known.select("name", F.explode(F.array_distinct(F.flatten(F.array(*[F.when(short(n), _pieces("letters", n)).otherwise(F.array().cast("array<string>")) for n in sizes])))).alias("piece"))
    wanted = small_broadcast(of_name.select("piece").distinct())
    lettered = df.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_text"), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)).alias("letters"))
    # The hint keeps Spark from broadcasting this side; a hint on the other one goes before it.
    held = lettered.select(*key, "_text", F.explode(F.array_distinct(F.flatten(F.array(*[_pieces("letters", n) for n in sizes])))).alias("piece")).hint("merge")
    counts = held.join(wanted, "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    # A name with a piece that no text holds is in no text.
    rarest = of_name.join(counts, "piece", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0").select("name", F.col("r.piece").alias("piece"))
    # Texts and names that share a piece: as many as the rarest pieces' counts, then the exact search.
    if is_small(known.select("name")):
        return held.join(F.broadcast(rarest), "piece").where(F.contains("_text", "name")).select(*key, "name").distinct()
    maybe = held.drop("_text").join(rarest, "piece").select(*key, "name").distinct()
    return maybe.join(df.select(*key, text).hint("merge"), key).where(F.contains(text, "name")).select(*key, "name").distinct()


def name_pairs(mentions: DataFrame, key: list[str]) -> DataFrame:
    """(a, b, weight): texts in which both names are, a before b.

    All pairs of a text's names are the measure itself; a text is a sentence,
    whose different names bound them.
    """
    left = mentions.select(*key, F.col("name").alias("a"))
    right = mentions.select(*key, F.col("name").alias("b"))
    return left.join(right, key).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def name_strength(pairs: DataFrame) -> DataFrame:
    """(name, degree, strength): partners of a name and the sum of its weights."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name"), "weight")
    return ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def relation_types(pairs: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(a, b, relation, n): sentences in which a keyword of the relation stands between the names a and b.

    pairs (a, b, sentence) has a row per sentence with both names. keywords is
    a short list, as it becomes part of the expression.
    """
    first, second = F.position(F.col("a"), F.col("sentence")), F.position(F.col("b"), F.col("sentence"))
    between = F.substring(F.col("sentence"), F.least(first, second), F.abs(first - second))
    said = pairs.where((first > 0) & (second > 0)).withColumn("_between", between)
    named = [F.when(reduce(or_, [F.contains(F.col("_between"), F.lit(w)) for w in words]), F.lit(relation)) for relation, words in keywords.items()]
    found = said.select("a", "b", F.explode(F.array_compact(F.array(*named))).alias("relation"))
    return found.groupBy("a", "b", "relation").agg(F.count(F.lit(1)).alias("n"))


def main_relation(found: DataFrame, order: list[str]) -> DataFrame:
    """(a, b, relation): the most frequent relation of each pair; of equal ones the first in `order`."""
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("relation"))
    return found.groupBy("a", "b").agg(F.max_by("relation", F.struct("n", -place)).alias("relation"))
