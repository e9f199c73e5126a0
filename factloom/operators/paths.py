"""Shortest dependency paths: parts of speech along a path, groups and labels of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import ancestors

NOUNS, VERBS = ["NOUN", "PROPN"], ["VERB", "AUX"]


def counts(path: Column) -> Column:
    """struct of counts over array<struct<token, pos, dep>>: nouns, verbs, adpositions, adjectives, subjects, objects."""
    n = lambda f: F.size(F.filter(path, f))
    return F.struct(
        n(lambda t: t["pos"].isin(NOUNS)).alias("nouns"), n(lambda t: t["pos"].isin(VERBS)).alias("verbs"), n(lambda t: t["pos"] == "ADP").alias("adpositions"),
        n(lambda t: t["pos"] == "ADJ").alias("adjectives"), n(lambda t: t["dep"].startswith("nsubj")).alias("subjects"), n(lambda t: t["dep"].endswith("obj")).alias("objects"),
    )


def without(path: Column, parts: list[str]) -> Column:
    """The path without tokens of some parts of speech; its ends stay."""
    last = F.size(path) - 1
    return F.filter(path, lambda t, i: (i == 0) | (i == last) | ~t["pos"].isin(parts))


def group(path: Column) -> Column:
    """verbal, amod, noun, adverbal or unknown."""
    c = counts(path)
    return (
        F.when(c["verbs"] > 0, "verbal")
        .when(F.exists(path, lambda t: t["dep"] == "amod"), "amod")
        .when((c["nouns"] >= 2) & (F.size(path) == c["nouns"] + c["adpositions"]), "noun")
        .when(F.exists(path, lambda t: t["dep"] == "advmod"), "adverbal")
        .otherwise("unknown")
    )


def valid(path: Column, most: int = 8) -> Column:
    """Two ends at least, no punctuation between, not longer than `most`."""
    return (F.size(path) >= 2) & (F.size(path) <= most) & ~F.exists(path, lambda t: t["pos"] == "PUNCT")


def relation_label(path: Column) -> Column:
    """The words between the ends, joined by a space."""
    return F.array_join(F.transform(F.slice(path, 2, F.greatest(F.size(path) - 2, F.lit(0))), lambda t: t["token"]), " ")


def nearest_verb(distances: DataFrame, token: str, verb: str, distance: str, farthest: bool = False) -> DataFrame:
    """The verb at the least (or largest) tree distance of each token, the first by name among equals."""
    order = [F.desc(distance) if farthest else F.col(distance), F.col(verb)]
    return distances.withColumn("_r", F.row_number().over(W.partitionBy(token).orderBy(*order))).where("_r = 1").drop("_r")


def subjects(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc, verb, subject): nsubj and nsubjpass children of verbs."""
    kids = edges.join(tokens.select("doc", F.col("token").alias("child"), F.col("dep")), ["doc", "child"]).where(F.col("dep").isin("nsubj", "nsubjpass"))
    verbs = tokens.where(F.col("pos").isin(VERBS)).select("doc", F.col("token").alias("parent"))
    return kids.join(verbs, ["doc", "parent"]).select("doc", F.col("parent").alias("verb"), F.col("child").alias("subject"))


def phrases(tokens: DataFrame, edges: DataFrame, pos: list[str], children: list[str] | None = None) -> DataFrame:
    """(doc, head, first, last, size): the phrase of each token with one of these parts of speech, that is the token and all that hangs below it: its least and
    largest token number and how many there are. With `children`, only heads with a direct dependant of one of these relations.

    tokens: (doc, token, pos, dep); edges: (doc, parent, child). A prepositional phrase has an ADP at its head, a verbal one a VERB or AUX with an object.
    """
    node = lambda c: F.struct(F.col("doc"), F.col(c).alias("token"))
    heads = tokens.where(F.col("pos").isin(pos)).select("doc", F.col("token").alias("head"))
    if children is not None:
        below = edges.join(tokens.where(F.col("dep").isin(children)).select("doc", F.col("token").alias("child")), ["doc", "child"])
        heads = heads.join(below.select("doc", F.col("parent").alias("head")), ["doc", "head"], "left_semi")
    up = ancestors(edges.select(node("parent").alias("parent"), node("child").alias("child")))
    under = up.select(F.col("ancestor.doc").alias("doc"), F.col("ancestor.token").alias("head"), F.col("child.token").alias("token"))
    whole = heads.join(under, ["doc", "head"]).unionByName(heads.withColumn("token", F.col("head")))
    return whole.groupBy("doc", "head").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count("*").alias("size"))
