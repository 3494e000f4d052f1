"""Classification and flags by thresholds, intervals, sets and ordered matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subject-area codes up to each threshold and their discipline, in rising order; 1000 itself is multidisciplinary.
DISCIPLINE_BOUNDS = [
    (1000, "multidisciplinary"),
    (1111, "life_sciences"),
    (1213, "social_sciences_and_humanities"),
    (1315, "life_sciences"),
    (1410, "social_sciences_and_humanities"),
    (1712, "physical_sciences"),
    (1804, "social_sciences_and_humanities"),
    (1913, "physical_sciences"),
    (2003, "social_sciences_and_humanities"),
    (2312, "physical_sciences"),
    (2406, "life_sciences"),
    (2614, "physical_sciences"),
    (2748, "health_sciences"),
    (2809, "life_sciences"),
    (2923, "health_sciences"),
    (3005, "life_sciences"),
    (3109, "physical_sciences"),
    (3322, "social_sciences_and_humanities"),
    (3616, "health_sciences"),
]

# Codes of psychology.
PSYCHOLOGY_CODES = (3200, 3207)

# Linking ISSNs of mega-journals.
MEGA_JOURNALS = [
    "24701343", "21583226", "20466390", "20446055", "23251026", "22115463", "21601836", "21693536", "20513305", "21678359",
    "19326203", "20545703", "21582440", "20452322", "20566700", "23915447", "22991093", "24058440", "21508925", "2050084X",
    "20461402",
]

# Pairs of classifications that agree.
AGREEING = [
    ("health_sciences", "Health Sciences"),
    ("life_sciences", "Health Sciences"),
    ("physical_sciences", "Natural Sciences and Engineering"),
    ("social_sciences_and_humanities", "Humanities"),
]


def bucket(value: Column, bounds: list[tuple[float, str]]) -> Column:
    """The label of the first bound that the value doesn't exceed; null above all bounds and for null."""
    out = F
    for bound, label in bounds:
        out = out.when(value <= bound, label)
    return out


def discipline(code: Column) -> Column:
    """Discipline of a subject-area code given as text or number; codes below 1000 or above all bounds, and junk, are null."""
    number = code.try_cast("int")
    return F.when(number >= 1000, bucket(number, DISCIPLINE_BOUNDS))


def in_interval(value: Column, low: float, high: float) -> Column:
    """Whether low <= value <= high; null for null."""
    return value.between(low, high)


def in_set(value: Column, members: list) -> Column:
    """Membership in a constant set; null is no member."""
    return F.coalesce(value.isin(*members), F.lit(False))


def first_match(tests: list[tuple[Column, str]]) -> Column:
    """Whether any column equals its literal; nulls match nothing."""
    out = F.lit(False)
    for column, literal in reversed(tests):
        out = F.when(column == literal, True).otherwise(out)
    return out


def open_access(doaj: Column, wos: Column, national: Column) -> Column:
    """Open access by any of three lists' own words (the second one's spelling included)."""
    return first_match([(doaj, "Yes"), (wos, "Unpaywall Open Acess"), (national, "DOAJ")])


def is_retracted(reason: Column, nature: Column) -> Column:
    return F.coalesce(reason, nature).isNotNull()


def corrected_date(article_date: Column, retraction_date: Column, original_date: Column) -> Column:
    """A retracted article's original date replaces its own; delays are not derived again."""
    return F.when(retraction_date.isNotNull(), original_date).otherwise(article_date)


def present(text: Column) -> Column:
    """Whether a text is there and not empty."""
    return F.coalesce(text != "", F.lit(False))


def agreement(left: Column, right: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """1 if the pair of classes is listed, else 0."""
    out = F.lit(False)
    for a, b in pairs or AGREEING:
        out = out | ((left == a) & (right == b))
    return F.coalesce(out, F.lit(False)).cast("int")


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding with halves to the even neighbour."""
    return F.bround(value, digits)


def log10(value: Column) -> Column:
    return F.log10(value)
