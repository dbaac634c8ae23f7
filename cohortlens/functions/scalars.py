"""Column expressions that the operators are made of. No Python runs on the executors, except Arrow functions over the lines of texts (``lines.py``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lines
from .tables import CLAIM_EPSILON, SALIENT, SEVERITY

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: Column) -> Column:
    """A decimal number in text as double, else NULL; suffixes such as 1d are no numbers."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def normalize_gt(gt: Column) -> Column:
    """Alleles in string order joined by '/'; NULL if nothing is called."""
    t = F.replace(F.trim(gt), F.lit("|"), F.lit("/"))
    alleles = F.array_sort(F.split(t, "/"))
    blank = F.forall(alleles, lambda a: a.isin("", "."))
    return F.when(t.isNull() | (t == "") | blank, F.lit(None)).otherwise(F.array_join(alleles, "/"))


def biallelic_snv(ref: Column, alt: Column) -> Column:
    return ref.isin("A", "C", "G", "T") & alt.isin("A", "C", "G", "T")


def transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def chrom_is(chrom: Column, letter: str) -> Column:
    return F.regexp_replace(F.lower(chrom), "^chr", "") == letter.lower()


def _field(keys: Column, values: Column, name: str) -> Column:
    """The value of a FORMAT key in a sample column, NULL if absent."""
    at = F.array_position(F.split(keys, ":"), name)
    return F.when(at > 0, F.get(F.split(values, ":"), (at - 1).cast("int")))


def vaf_mutect(keys: Column, values: Column) -> Column:
    """AF if it is a number, else AD[1] / DP with DP above 0."""
    af = number(F.get(F.split(_field(keys, values, "AF"), ","), F.lit(0)))
    ad, dp = number(F.get(F.split(_field(keys, values, "AD"), ","), F.lit(1))), number(_field(keys, values, "DP"))
    return F.coalesce(af, F.when(dp > 0, ad / dp))


def _tier1(keys: Column, values: Column, name: str) -> Column:
    return number(F.get(F.split(_field(keys, values, name), ","), F.lit(0)))


def vaf_strelka_snv(keys: Column, values: Column, ref: Column, alt: Column) -> Column:
    def tier(base):
        out = F.lit(None).cast("double")
        for x in "ACGT":
            out = F.when(base == x, _tier1(keys, values, f"{x}U")).otherwise(out)
        return out

    r, a = tier(ref), tier(alt)
    return F.when(r + a > 0, a / (r + a))


def vaf_strelka_indel(keys: Column, values: Column) -> Column:
    r, a = _tier1(keys, values, "TAR"), _tier1(keys, values, "TIR")
    return F.when(r + a > 0, a / (r + a))


def variant_terms(value: Column, index: Column) -> Column:
    """All consequence terms of an annotation: transcripts by ',', subfields by '|', terms by '&', lower-cased."""
    cells = F.transform(F.split(value, ","), lambda t: F.coalesce(F.get(F.split(t, "[|]"), index), F.lit("")))
    terms = F.flatten(F.transform(cells, lambda c: F.split(c, "&")))
    return F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def severity_rank(term: Column) -> Column:
    """Rank of a consequence term, least severe 0; unknown terms rank 1."""
    ranks = F.create_map(*[x for i, t in enumerate(SEVERITY) for x in (F.lit(t), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, term), F.lit(1))


def most_severe(terms: Column) -> Column:
    """The first term of the highest rank, NULL without terms. ``terms`` stands once, as Spark computes it again for each mention."""
    return F.array_max(F.transform(terms, lambda t, i: F.struct(severity_rank(t).alias("r"), (-i).alias("i"), t.alias("t"))))["t"]


def symbol(value: Column, index: Column) -> Column:
    """Gene symbol of the first transcript, lower-cased; '' and '.' are NULL."""
    s = F.lower(F.trim(F.get(F.split(F.get(F.split(value, ","), F.lit(0)), "[|]"), index)))
    return F.when(~s.isin("", "."), s)


def band_status(value: Column, fail_below: Column, warn_below: Column, warn_above: Column, fail_above: Column) -> Column:
    """fail, warn or pass by strict comparison of the raw value, fail first; NULL and NaN are unverified."""
    return (
        F.when(value.isNull() | F.isnan(value), "unverified")
        .when((value < fail_below) | (value > fail_above), "fail")
        .when((value < warn_below) | (value > warn_above), "warn")
        .otherwise("pass")
    )


def expected_range(fail_below: Column, warn_below: Column, warn_above: Column, fail_above: Column) -> Column:
    """The band within which a check passes, as text; NULL without bounds."""
    lo, hi = (F.coalesce(*x).cast("decimal(18,2)") for x in ((warn_below, fail_below), (warn_above, fail_above)))
    return (
        F.when(lo.isNotNull() & hi.isNotNull(), F.format_string("[%s, %s]", lo.cast("string"), hi.cast("string")))
        .when(lo.isNotNull(), F.format_string(">= %s", lo.cast("string")))
        .when(hi.isNotNull(), F.format_string("<= %s", hi.cast("string")))
    )


def band_less(*bounds: Column) -> Column:
    return F.coalesce(*bounds).isNull()


def unit_refused(unit: Column, value: Column) -> Column:
    """A fraction outside 0..1 is refused, never rescaled."""
    return F.coalesce((unit == "fraction") & ~value.between(0, 1), F.lit(False))


def duration_sec(text: Column) -> Column:
    """Sum of numbers with units ms, s, m, h, d; blank and '-' are 0."""
    pattern = F.lit(r"([0-9]*\.?[0-9]+)\s*(ms|s|m|h|d)")
    parts = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("u"))
    factor = lambda u: F.when(u == "ms", 0.001).when(u == "s", 1.0).when(u == "m", 60.0).when(u == "h", 3600.0).otherwise(86400.0)
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"].try_cast("double") * factor(p["u"])), F.lit(0.0))


def size_mb(text: Column) -> Column:
    """The first number with its unit in MB (1024-based); blank and '-' are 0."""
    n = F.regexp_extract(text, r"([0-9]*\.?[0-9]+)\s*([KMGT]?B)", 1)
    u = F.regexp_extract(text, r"([0-9]*\.?[0-9]+)\s*([KMGT]?B)", 2)
    factor = F.when(u == "B", 1 / 1048576).when(u == "KB", 1 / 1024).when(u == "MB", 1.0).when(u == "GB", 1024.0).otherwise(1048576.0)
    return F.coalesce(F.when(n != "", n.try_cast("double") * factor), F.lit(0.0))


def pct_cpu(text: Column) -> Column:
    return F.coalesce(number(F.regexp_replace(text, "%", "")), F.lit(0.0))


def task_failed(status: Column, exit_code: Column) -> Column:
    """FAILED, or an exit code other than 0; a missing exit code is no failure."""
    return F.coalesce(F.upper(status) == "FAILED", F.lit(False)) | F.coalesce(exit_code != 0, F.lit(False))


def relative_delta(a: Column, reference: Column) -> Column:
    return F.when(reference == 0, F.abs(a)).otherwise(F.abs(a - reference) / F.abs(reference))


def claim_status(claimed: Column, observed: Column, tolerance: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (
        F.when(~finite(observed) | ~finite(claimed), "unverified")
        .when(F.abs(observed - claimed) <= CLAIM_EPSILON, "reproduced")
        .when(relative_delta(observed, claimed) <= tolerance, "within_tolerance")
        .otherwise("diverged")
    )


def concordance_status(value: Column, shared: Column, floor: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | shared.isNull() | (shared < floor), "unverified").when(value < 0.90, "warn").otherwise("pass")


def source_kind(source: Column) -> Column:
    return F.split_part(source, F.lit(":"), F.lit(1))


def normalized_log(text: Column) -> Column:
    """Lower-cased lines without what differs between runs; only salient lines if any."""
    return lines.normalized(F.lower(text), SALIENT)


def signature(text: Column) -> Column:
    return F.substring(F.sha2(normalized_log(text), 256), 1, 16)


def missing_module(text: Column) -> Column:
    top = F.regexp_extract(text, r"No module named ['\"]([A-Za-z0-9_\-]+)[.A-Za-z0-9_\-]*['\"]", 1)
    return F.when(top != "", top)


def canonical_sha(*columns: str) -> Column:
    """Digest of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
