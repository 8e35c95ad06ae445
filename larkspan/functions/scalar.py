"""Scalar column functions: all are expressions inside whole-stage codegen."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# text


def normalise(c: Column | str) -> Column:
    """Lower case, the word "nos" and the marks , ; ( ) out, blanks collapsed; null becomes empty."""
    x = F.trim(F.lower(F.coalesce(col(c), F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bnos\b", ""), r"[,;()]", " "), r"\s+", " "))


def first_class(c: Column | str, classes: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """The first class, in the mapping's order, of which some keyword is in the text."""
    x = col(c)
    tests = [(functools.reduce(Column.__or__, [x.contains(w) for w in words]), name) for name, words in classes.items()]
    return functools.reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(other))


def stage(c: Column | str) -> Column:
    """Tumour stage I to IV by prefix; "missing" for stage X and unknown; null for anything else."""
    x = F.upper(F.trim(col(c)))
    ladder = [("STAGE X", "missing"), ("STAGE IV", "IV"), ("STAGE III", "III"), ("STAGE II", "II"), ("STAGE I", "I"), ("UNKNOWN", "missing")]
    return functools.reduce(lambda rest, t: F.when(x.startswith(t[0]), t[1]).otherwise(rest), reversed(ladder), F.lit(None).cast("string"))


def consistency(subtype: Column | str, disease: Column | str) -> Column:
    return F.when(normalise(disease).contains("squamous") & (col(subtype) != "squamous"), "conflict").otherwise("ok")


def validity(diagnosis: Column | str, subtype: Column | str) -> Column:
    d = F.lower(F.trim(F.coalesce(col(diagnosis), F.lit(""))))
    return F.when(d.isin("", "unknown", "not reported"), "invalid").when(col(subtype) == "other", "ambiguous").otherwise("valid")


def sample_barcode(c: Column | str) -> Column:
    """First four dash-separated parts, the fourth cut to two characters."""
    p = F.split(col(c), "-")
    return F.when(F.size(p) >= 4, F.concat_ws("-", F.slice(p, 1, 3), F.substring(F.element_at(p, 4), 1, 2))).otherwise(col(c))


def subject(c: Column | str) -> Column:
    """First two dash-separated parts."""
    return F.substring_index(col(c), "-", 2)


def without_version(c: Column | str) -> Column:
    """A gene id without its version and pseudoautosomal mark."""
    return F.regexp_replace(F.regexp_replace(col(c), r"_PAR_Y$", ""), r"\.\d+$", "")


def last_token(c: Column | str, sep: str = " ") -> Column:
    return F.element_at(F.split(col(c), re.escape(sep)), -1)


def padded(c: Column | str, n: int, mark: str = " ", left: bool = True) -> Column:
    return (F.lpad if left else F.rpad)(col(c).cast("string"), n, mark)


def location(c: Column | str) -> Column:
    """Struct of chromosome, start and end of chr:start-end; nulls where it is none."""
    rx = r"^(?:chr)?([^:]+):(\d+)-(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(col(c), rx, i), F.lit(""))
    return F.struct(part(1).alias("chr"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


def roman(c: Column | str) -> Column:
    """A whole number from 1 to 3999 in Roman numerals."""
    marks = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    out, rest = [], col(c).cast("int")
    for n, m in marks:
        out.append(F.repeat(F.lit(m), F.floor(rest / n).cast("int")))
        rest = rest % n
    return F.when(col(c).between(1, 3999), F.concat(*out))


def month_number(c: Column | str) -> Column:
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(F.trim(col(c)), 1, 3))).cast("int"), F.lit(0))


def hex_to_rgb(c: Column | str) -> Column:
    h = F.regexp_replace(col(c), "^#", "")
    return F.array(*[F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") for i in range(3)])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(x.cast("long")), 2, "0") for x in (r, g, b)]))


def break_lines(c: Column | str, width: int) -> Column:
    """Line ends instead of blanks, so that no line is longer than ``width`` unless one word is."""
    return F.rtrim(F.regexp_replace(col(c), rf"(\S{{{width},}}|.{{1,{width}}})(?:\s+|$)", "$1\n"), F.lit("\n"))


def replaced(c: Column | str, pairs: Mapping[str, str]) -> Column:
    return functools.reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), col(c))


def starts_with_word(c: Column | str, word: str) -> Column:
    return col(c).rlike(rf"^{re.escape(word)}\b")


def is_curie(c: Column | str) -> Column:
    """prefix:local identifiers."""
    return F.coalesce(col(c).rlike(r"^[A-Za-z][A-Za-z0-9_.]*:[A-Za-z0-9_.\-]+$"), F.lit(False))


def any_like(c: Column | str, terms: Sequence[str]) -> Column:
    """Whether the text, lower-cased and never null, contains one of the terms; an array counts joined."""
    x = F.lower(F.coalesce(col(c), F.lit("")))
    return functools.reduce(Column.__or__, [x.contains(t.lower()) for t in terms])


# numbers


def as_float(c: Column | str) -> Column:
    return col(c).try_cast("double")


def as_int(c: Column | str) -> Column:
    return col(c).try_cast("int")


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def lfc_bin(c: Column | str) -> Column:
    """Label of a log fold change."""
    x = col(c)
    steps = [(x.isNull(), "none"), (x >= 3, "up_3"), (x >= 2, "up_2"), (x >= 1, "up_1"), (x >= 0.4, "+weak"), (x <= -3, "down_3"), (x <= -2, "down_2"), (x <= -1, "down_1"), (x <= -0.4, "-weak")]
    return functools.reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(steps), F.lit("~zero"))


def direction(c: Column | str, cut: float, up: str = "up", down: str = "dw", none: str = "--") -> Column:
    return F.when(col(c) > cut, up).when(col(c) < -cut, down).otherwise(none)


def pair_label(last: Column | str, first: Column | str, cut: float = 0.4) -> Column:
    """Directions of two values, last one first."""
    return F.concat_ws("/", direction(last, cut), direction(first, cut))


def modulated(last: Column | str, first: Column | str, cut: float = 0.4) -> Column:
    d = F.coalesce(col(last), F.lit(0.0)) - F.coalesce(col(first), F.lit(0.0))
    return F.when(d >= cut, "upmodulated").when(d <= -cut, "downmodulated").otherwise("not modulated")


def stars(p: Column | str, threshold: float = 0.05, none: str = "NS") -> Column:
    """Significance marks; a threshold above 0.05 uses fixed steps, others fractions of it."""
    x = col(p)
    steps = [0.05, 0.01, 0.001] if threshold > 0.05 else [threshold / 5, threshold / 50, threshold / 500]
    out = F.when(x < 0, "??").when(x >= threshold, none)
    for i, s in enumerate(steps):
        out = out.when(x > s, "*" * (i + 1))
    return out.otherwise("****")


def star_list(p: Column | str, threshold: float = 0.05) -> Column:
    """The shorter ladder, of three marks at most."""
    x = col(p)
    return F.when(x >= threshold, "NS").when(x > threshold / 5, "*").when(x > threshold / 50, "**").when(x.isNotNull(), "***").otherwise("???")


def choose2(n: Column | str) -> Column:
    return (col(n) * (col(n) - 1) / 2).cast("long")


def poisson(k: Column | str, mean: Column | str) -> Column:
    """Probability of k under a Poisson law; the factorial is summed in logs."""
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(col(k), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.exp(col(k) * F.log(col(mean)) - col(mean) - logs)


def variation(mean: Column | str, std: Column | str) -> Column:
    return F.when(col(mean) != 0, col(std) / F.abs(col(mean)))


def fisher_z(r: Column | str) -> Column:
    return F.atanh(clip(r, -0.999999, 0.999999))


# dates


def is_date(c: Column | str) -> Column:
    """Whether the text is a day written as yyyy-mm-dd."""
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & col(c).try_cast("date").isNotNull(), F.lit(False))


def semester(month: Column | str) -> Column:
    return F.when(col(month).between(1, 6), 1).when(col(month).between(7, 12), 2)


# arrays, structs, hashes


def sorted_unique(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(col(c))))


def first_known(items: Column | str, keys: Sequence[str]) -> Column:
    """Over an array of structs: the first that is not null or empty of the first item's keys in turn, then of the next items."""
    pick = lambda x: F.coalesce(*[F.nullif(F.trim(x[k]), F.lit("")) for k in keys])
    return F.get(F.array_compact(F.transform(col(items), pick)), F.lit(0))


def content_hash(payload: Column) -> Column:
    """sha256 of a canonical text."""
    return F.sha2(payload.cast("binary"), 256)


def short_hash(payload: Column) -> Column:
    return F.substring(F.sha1(payload.cast("binary")), 1, 12)


# evidence


def information_ceiling(r: Column | str) -> Column:
    return 1 / (1 - clip(r, 0.0, 1 - 1e-9))


def attenuated_lr(lr: Column | str, reliability: Column | str) -> Column:
    """A likelihood ratio bounded by its source's reliability, alike for and against; null unless positive."""
    r, x = clip(reliability, 0.0, 1 - 1e-9), col(lr)
    return F.when(x >= 1, x / (r + (1 - r) * x)).when(x > 0, r * x + (1 - r))


def lr_from_test(power: Column | str, alpha: Column | str, detected: Column | str) -> Column:
    p, a = clip(power, 1e-6, 1 - 1e-6), clip(alpha, 1e-6, 1 - 1e-6)
    return F.when(col(detected), p / a).otherwise((1 - p) / (1 - a))


def binary_entropy(p: Column | str) -> Column:
    x = clip(p, 1e-12, 1 - 1e-12)
    return -(x * F.log2(x) + (1 - x) * F.log2(1 - x))


def information_gain(p: Column | str, sensitivity: Column | str, specificity: Column | str) -> Column:
    """Expected bits that a test tells about a claim of probability p."""
    q, se, sp = col(p), col(sensitivity), col(specificity)
    pos = q * se + (1 - q) * (1 - sp)
    neg = 1 - pos
    after = pos * binary_entropy(q * se / pos) + neg * binary_entropy(q * (1 - se) / neg)
    return F.when((pos <= 1e-12) | (neg <= 1e-12), F.lit(0.0)).otherwise(F.greatest(binary_entropy(q) - after, F.lit(0.0)))
