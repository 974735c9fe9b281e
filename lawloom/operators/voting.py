"""Votes over several models' answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vote(question_id: Column, answers: list[Column]) -> Column:
    """One answer from several: essays the last model's; verdicts true only by strict majority; choices by plurality, ties and no votes to the earlier letter."""
    yes = sum((F.coalesce((a == "đúng").cast("int"), F.lit(0)) for a in answers), F.lit(0))
    no = sum((F.coalesce((a == "sai").cast("int"), F.lit(0)) for a in answers), F.lit(0))
    counts = [sum((F.coalesce((a == letter).cast("int"), F.lit(0)) for a in answers), F.lit(0)) for letter in "abcd"]
    most = F.greatest(*counts)
    choice = F.when(counts[0] == most, "A").when(counts[1] == most, "B").when(counts[2] == most, "C").otherwise("D")
    return F.when(question_id.contains("TL"), answers[-1]).when(question_id.contains("DS"), F.when(yes > no, "đúng").otherwise("sai")).otherwise(choice)
