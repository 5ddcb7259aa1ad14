"""Matching people of two lists by name and birthday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Lower case, without dots, apostrophes and doubled blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[.'’]", ""), r"\s+", " "))


def similar_names(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str, distance: int = 1) -> DataFrame:
    """(left_id, right_id, distance): names within an edit distance, found without comparing all pairs.

    The left name is cut into ``distance`` + 1 pieces: of two names within the
    distance, the right one holds one of the pieces unchanged, at most
    ``distance`` places off. Names meet on such a piece, its number and the
    left name's length, by an equality join, and are then compared in full.
    Names of no more characters than pieces, which would have empty pieces,
    meet on their lengths. Null names match nothing.
    """
    pieces = distance + 1

    def bounds(length: Column, k: int) -> tuple[Column, Column]:
        start = F.floor(length * k / pieces).cast("int")
        return start, F.floor(length * (k + 1) / pieces).cast("int") - start

    a = left.select(F.col(left_id).alias("_a"), plain_name(F.col(left_name)).alias("_x")).where("_x is not null")
    b = right.select(F.col(right_id).alias("_b"), plain_name(F.col(right_name)).alias("_y")).where("_y is not null")
    size = F.length("_x")
    own = [F.struct(size.alias("n"), F.lit(k).alias("k"), F.substring("_x", bounds(size, k)[0] + 1, bounds(size, k)[1]).alias("piece")) for k in range(pieces)]
    short = F.array(F.struct(size.alias("n"), F.lit(-1).alias("k"), F.lit("").alias("piece")))
    a = a.select("_a", "_x", F.explode(F.when(size > pieces, F.array(*own)).otherwise(short)).alias("at"))
    found = []
    for off in range(-distance, distance + 1):
        n = F.length("_y") + off
        for k in range(pieces):
            start, length = bounds(n, k)
            for shift in range(-distance, distance + 1):
                fits = (n > pieces) & (start + shift >= 0) & (start + shift + length <= F.length("_y"))
                found.append(F.when(fits, F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring("_y", start + shift + 1, length).alias("piece"))))
        found.append(F.when((n >= 0) & (n <= pieces), F.struct(n.alias("n"), F.lit(-1).alias("k"), F.lit("").alias("piece"))))
    b = b.select("_b", "_y", F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias("at"))
    pairs = a.join(b, "at").where(F.abs(F.length("_x") - F.length("_y")) <= distance)
    off = F.levenshtein("_x", "_y", distance)
    return pairs.withColumn("distance", off).where("distance >= 0").select(F.col("_a").alias(left_id), F.col("_b").alias(right_id), "distance").distinct()


def birthdays_agree(known: Column, listed: Column, days: int = 120) -> Column:
    """Dates within ``days``, with month and day the other way round in the same year, or of the same month and day."""
    swapped = F.when(F.dayofmonth(listed) <= 12, F.make_date(F.year(listed), F.dayofmonth(listed), F.month(listed)))
    near = F.abs(F.datediff(known, listed)) <= days
    same = (F.month(known) == F.month(listed)) & (F.dayofmonth(known) == F.dayofmonth(listed))
    return F.coalesce(near | (known == swapped) | same, F.lit(False))


def matched_people(
    people: DataFrame, listed: DataFrame, person: str, name: str, birthday: str, listed_id: str, listed_name: str, listed_birthday: str, bad: str = "1900-01-01", distance: int = 1, days: int = 120
) -> DataFrame:
    """(person, listed_id, distance, how): who of a list a person may be, by name and then by birthday.

    ``how`` is birthday where the dates agree (``birthdays_agree``), and only
    where the person's date is the placeholder ``bad`` and the list has just
    one such name. A null date agrees with none.
    """
    pairs = similar_names(people, listed, person, name, listed_id, listed_name, distance)
    alone = pairs.groupBy(person).agg(F.count(F.lit(1)).alias("_n"))
    dated = pairs.join(alone, person).join(people.select(person, F.col(birthday).cast("date").alias("_known")), person).join(listed.select(listed_id, F.col(listed_birthday).cast("date").alias("_listed")), listed_id)
    only = (F.col("_known") == F.lit(bad).cast("date")) & (F.col("_n") == 1)
    how = F.when(F.coalesce(only, F.lit(False)), "only").when(birthdays_agree(F.col("_known"), F.col("_listed"), days), "birthday")
    return dated.withColumn("how", how).where("how is not null").select(person, listed_id, "distance", "how")
