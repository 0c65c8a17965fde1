"""Scalar scoring expressions (Column -> Column); all run inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number as Python's float() reads it (digits, optional fraction and exponent).
NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_years(text) -> Column:
    """Leading number of an experience string ("6 years" -> 6.0); null when the first
    whitespace-separated token is not a number ("5+ years", "5-10 years", "")."""
    tok = F.regexp_extract(_c(text), r"^\s*(\S+)", 1)
    return F.when(tok.rlike(NUMERIC), tok.try_cast("double"))


def experience_match_pct(applicant_years, required_years) -> Column:
    """100 if the applicant meets the requirement, else applicant/required*100; 50 when
    either side is unparseable.  Inputs are parsed years (doubles, null = unparseable)."""
    a, r = _c(applicant_years), _c(required_years)
    return (F.when(a.isNull() | r.isNull(), F.lit(50.0))
             .when(a >= r, F.lit(100.0))
             .otherwise(F.coalesce(F.try_divide(a, r) * 100.0, F.lit(0.0))))


def as_skill_list(skills, sep: str = ",") -> Column:
    """A comma string or an array of skills, normalised to trimmed lower-case elements.
    An empty string yields one empty skill, as a plain split does."""
    s = _c(skills)
    return F.transform(s, lambda x: F.lower(F.trim(x))) if sep is None else F.transform(
        F.split(s, sep, -1), lambda x: F.lower(F.trim(x)))


def skill_match_pct(applicant_skills: Column, job_skills: Column) -> Column:
    """Share of job skills (duplicates counted) that contain, or are contained in, any
    applicant skill, times 100; 100 for an empty job list.  Both inputs are arrays of
    normalised skills (see :func:`as_skill_list`)."""
    a, j = applicant_skills, job_skills
    hit = F.size(F.filter(j, lambda s: F.exists(a, lambda t: F.contains(s, t) | F.contains(t, s))))
    return F.when(F.size(j) == 0, F.lit(100.0)).otherwise(hit / F.size(j) * 100.0)


def levenshtein_ratio(a, b) -> Column:
    """max(0, 1 - distance / max(len)); null when both are empty."""
    a, b = _c(a), _c(b)
    return F.greatest(F.lit(0.0), 1.0 - F.try_divide(F.levenshtein(a, b).cast("double"),
                                                     F.greatest(F.length(a), F.length(b)).cast("double")))


def dot(a, b) -> Column:
    """Unnormalised dot product of two numeric arrays, in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def binary_softmax(yes_logit, no_logit) -> Column:
    """P(yes) of a two-class softmax: e^y / (e^y + e^n) = 1 / (1 + e^(n - y))."""
    return 1.0 / (1.0 + F.exp(_c(no_logit) - _c(yes_logit)))
