"""Scalar expressions of box-score data: parsing, cleaning, scaling, colours, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First month of a season.
SEASON_MONTH = 10


def minutes(text: Column) -> Column:
    """``MM:SS`` as minutes; null, or anything else, as 0."""
    parts = F.split(text, ":")
    return F.coalesce(F.try_element_at(parts, F.lit(1)).try_cast("double") + F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) / 60, F.lit(0.0))


def slug(*parts: Column) -> Column:
    """Parts joined by blanks, without dots, blanks and hyphens as underscores."""
    return F.regexp_replace(F.replace(F.concat_ws(" ", *parts), F.lit("."), F.lit("")), "[ -]", "_")


def clean_key(key: Column) -> Column:
    """Without plus signs and what stands in parentheses."""
    return F.regexp_replace(F.replace(key, F.lit("+"), F.lit("")), r"\(.*?\)", "")


def split_prefix(key: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """(prefix, rest) of a key by the first known prefix; (empty, key) without one."""
    pattern = f"^({'|'.join(prefixes)})_(.*)$"
    prefix = F.regexp_extract(key, pattern, 1)
    return prefix, F.when(prefix != "", F.regexp_extract(key, pattern, 2)).otherwise(key)


def padded_id(key: Column, width: int = 10) -> Column:
    return F.lpad(key.cast("string"), width, "0")


def positions(text: Column, codes: Column | None = None) -> Column:
    """The distinct positions F, C, G named in a text, and in an array of codes such as PG or SF; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    codes = F.coalesce(codes, F.array().cast("array<string>")) if codes is not None else F.array().cast("array<string>")
    has = lambda letter: F.exists(codes, lambda c: F.upper(c).endswith(letter))
    found = F.array(*[F.when(low.contains(word) | has(word[0].upper()), F.lit(word[0].upper())) for word in ("forward", "center", "guard")])
    kept = F.array_compact(found)
    return F.when(F.size(kept) > 0, kept)


def position_names(text: Column) -> Column:
    """``Point Guard and Shooting Guard`` as [PG, SG]; names not known are dropped."""
    names = {"point guard": "PG", "shooting guard": "SG", "small forward": "SF", "power forward": "PF", "center": "C"}
    parts = F.split(F.lower(text), r"\s+and\s+")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_compact(F.transform(parts, lambda p: F.try_element_at(table, F.trim(p))))


def matchup_code(code: Column, own: Column) -> tuple[Column, Column]:
    """``.../AWYHOM`` as ``AWY@HOM``, and the same with the own side marked by asterisks."""
    pair = F.substring_index(code, "/", -1)
    text = F.concat(F.substring(pair, 1, 3), F.lit("@"), F.substring(pair, 4, 3))
    return text, F.replace(text, own, F.concat(F.lit("**"), own, F.lit("**")))


def path_id(url: Column) -> Column:
    """The last part of a URL's path without its ending, such as a game's or player's id; null without any."""
    last = F.regexp_extract(url, r"^[^?#]*/([^/?#]+?)(?:\.[A-Za-z0-9]+)?(?:[?#].*)?$", 1)
    return F.nullif(last, F.lit(""))


def win_rate(record: Column) -> Column:
    """``W-L`` as the share of wins; null as 1, and so is a record without games."""
    won, lost = (F.split_part(record, F.lit("-"), F.lit(k)).try_cast("double") for k in (1, 2))
    return F.coalesce(F.try_divide(won, won + lost), F.lit(1.0))


def streak(text: Column) -> Column:
    """``Won n`` as n, ``Lost n`` as -n, else 0."""
    n = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.coalesce(F.when(text.startswith("Won"), n).when(text.startswith("Lost"), -n), F.lit(0))


def inches(height: Column) -> Column:
    """``ft-in`` as inches."""
    return F.split_part(height, F.lit("-"), F.lit(1)).try_cast("int") * 12 + F.split_part(height, F.lit("-"), F.lit(2)).try_cast("int")


def pounds(weight: Column) -> Column:
    return F.regexp_extract(weight, r"(\d+)", 1).try_cast("int")


def experience(text: Column) -> Column:
    """Years; a rookie (``R`` or ``Rookie``) has 0."""
    return F.when(F.lower(text).startswith("r"), 0).otherwise(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"))


def money(text: Column) -> Column:
    return F.regexp_replace(text, "[,$]", "").try_cast("double")


def status(name: Column) -> tuple[Column, Column]:
    """(name, status) of a name with a suffix GTD, O, NA or IR."""
    pattern = r"^(.*?)\s*(GTD|NA|IR|O)$"
    found = F.regexp_extract(name, pattern, 2)
    return F.when(found != "", F.regexp_extract(name, pattern, 1)).otherwise(name), F.nullif(found, F.lit(""))


def fraction(percent: Column) -> Column:
    """``+12.5%`` as 0.125."""
    return F.regexp_replace(percent, "[+%]", "").try_cast("double") / 100


def number(text: Column) -> Column:
    """A number, or null; NaN is null as well."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def clock(text: Column) -> Column:
    """A 12-hour clock time such as ``7:30 PM`` as minutes of the day; missing is 7 PM."""
    hour, minute, half = (F.regexp_extract(text, r"(\d{1,2}):(\d{2})\s*([AaPp])", k) for k in (1, 2, 3))
    found = F.pmod(hour.try_cast("int"), F.lit(12)) * 60 + minute.try_cast("int") + F.when(F.lower(half) == "p", 720).otherwise(0)
    return F.coalesce(found, F.lit(19 * 60))


def season(date: Column, first_month: int = SEASON_MONTH) -> Column:
    """The year in which the season of a date began."""
    return F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)


def season_start(date: Column, first_month: int = SEASON_MONTH) -> Column:
    return F.make_date(season(date, first_month), F.lit(first_month), F.lit(1))


def season_label(date: Column, first_month: int = SEASON_MONTH) -> Column:
    """``2014-15``."""
    year = season(date, first_month)
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0"))


def per_unit(stat: Column, amount: Column, unit: float = 36.0) -> Column:
    """``stat`` for each ``unit`` of ``amount``; null without any."""
    return F.try_divide(F.lit(float(unit)) * stat, amount)


def ratio_to_baseline(x: Column, base: Column) -> Column:
    """x / base, or 1 where the base is not positive."""
    return F.when(base > 0, F.try_divide(x, base)).otherwise(1.0)


def cityblock(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, d: acc + d)


def rank_weights(ranked: Column) -> Column:
    """Weights 1 / (place + 1)^2 of an array's places, from 0, made to sum to 1."""
    raw = F.transform(ranked, lambda _, i: 1 / F.pow(i + 1, F.lit(2)))
    return F.transform(raw, lambda w: w / F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x))


def one_hot(value: Column, known: list[str]) -> dict[str, Column]:
    """+1 where the value is the known one, else -1; a null is -1 throughout."""
    return {k: F.when(value == k, 1).otherwise(-1) for k in known}


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def colour(value: Column, low: Column, high: Column, lower_is_better: Column | bool = False) -> Column:
    """Red over yellow to green as the value goes from low to high, as ``#rrggbb``; without a range ``transparent``."""
    share = F.when(value <= low, 0.0).when(value >= high, 1.0).otherwise(F.try_divide(value - low, high - low))
    flip = lower_is_better if isinstance(lower_is_better, Column) else F.lit(lower_is_better)
    step = F.floor(F.when(flip, 1 - share).otherwise(share) * 510).cast("int")
    red, green = F.least(F.lit(255), 510 - step), F.least(F.lit(255), step)
    return F.when(step.isNotNull(), F.format_string("#%02x%02x00", red, green)).otherwise("transparent")


def digitize(x: Column, limit: float, classes: int) -> Column:
    """The class of a value clamped to +-limit: how many of classes - 1 even edges are at or below it."""
    edges = [-limit + 2 * limit * k / (classes - 2) for k in range(classes - 1)] if classes > 2 else [-limit]
    v = clamp(x, -limit, limit)
    return F.when(v.isNotNull(), reduce(lambda a, b: a + b, [F.when(v >= e, 1).otherwise(0) for e in edges]))


def linear_points(stats: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of stats; a missing one adds nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(stats[k], F.lit(0.0)) * w for k, w in weights.items()])
