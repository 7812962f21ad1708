"""Column functions over sequences, headers and weights (inventory C)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1_000_000
#: IUPAC codes and their complements.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IUPAC, IUPAC_COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


def upper_dna(seq: Column) -> Column:
    return F.translate(seq, "acgt", "ACGT")


@F.arrow_udf(T.DoubleType())
def log2(x: pa.Array) -> pa.Array:
    """The logarithm as the C library has it, of what is above 0: Spark's is a quotient of two rounded ones, and off in the last
    place for a third of all values."""
    return pa.array([math.log2(v) if v is not None and v > 0 else None for v in x.to_pylist()], pa.float64())


def places(x: Column, n: int) -> Column:
    """A finite double to n decimals: its product with 10^n to the nearest whole number, halves away from 0, as C and SQL engines
    round; Spark's round() takes halves of the shortest decimal."""
    return F.round(x * F.lit(10.0**n)) / F.lit(10.0**n)


def runs(seq: Column, k: int) -> Column:
    """Maximal unambiguous runs of at least k bases."""
    return F.filter(F.regexp_extract_all(upper_dna(seq), F.lit("([ACGT]+)"), 1), lambda r: F.length(r) >= k)


def packed(kmer: Column) -> Column:
    """Two bits a base, for up to 31 bases; order and equality are kept."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpacked(code: Column, k: int) -> Column:
    """The bases of a packed k-mer; of a longer one, which index.kmers packs as 16 bytes."""
    if k <= 31:
        return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    digits = F.regexp_extract_all(F.hex(code), F.lit("(.)"), 1)
    pairs = F.array_join(F.transform(digits, lambda h: F.lpad(F.conv(h, 16, 4), 2, "0")), "")
    return F.translate(F.right(pairs, F.lit(k)), "0123", "ACGT")


def reverse_complement(bases: Column) -> Column:
    """IUPAC, upper case; any other letter raises."""
    up = F.translate(bases, LETTERS.lower(), LETTERS)
    return F.when(up.rlike(f"^[{IUPAC}]*$"), F.reverse(F.translate(up, IUPAC, IUPAC_COMPLEMENT))).otherwise(F.raise_error(F.concat(F.lit("not a nucleotide sequence: "), bases)))


def locus_sequence(bases: Column, start: Column, end: Column, strand: Column) -> Column:
    """1-based inclusive substring, reverse-complemented on the minus strand; beyond the contig raises."""
    cut = F.when((start >= 1) & (end >= start) & (end <= F.length(bases)), F.substring(bases, start.cast("int"), (end - start + 1).cast("int"))).otherwise(F.raise_error(F.lit("interval is beyond its contig")))
    return F.when(strand == "-", reverse_complement(cut)).otherwise(F.translate(cut, LETTERS.lower(), LETTERS))


def first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^\s*(\S+)", 1)


def micro_units(text: Column) -> Column:
    """A plain decimal in millionths, the seventh digit rounded half up; anything else gives null."""
    clean = F.regexp_replace(text, r"^\+", "")
    whole = F.coalesce(F.nullif(F.regexp_extract(clean, r"^(\d*)", 1), F.lit("")), F.lit("0")).cast("decimal(20,0)")
    part = F.rpad(F.regexp_extract(clean, r"^\d*\.(\d*)$", 1), 7, "0")
    value = whole * SCALE + F.substring(part, 1, 6).cast("decimal(20,0)") + F.when(F.substring(part, 7, 1) >= "5", 1).otherwise(0)
    return F.when(text.rlike(r"^\+?(\d+\.?\d*|\.\d+)$"), value.cast("long"))


def decimal_text(micro: Column) -> Column:
    """Millionths as the shortest exact decimal."""
    text = F.concat((micro / F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,6)").cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def round_ratio(n: Column, d: Column | int) -> Column:
    """n / d to the nearest integer, ties up, for n >= 0."""
    d = F.lit(d) if isinstance(d, int) else d
    return _div(n + _div(d, F.lit(2)), d)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def whole(a: Column, b: Column) -> Column:
    """a / b without the rest, for decimals that a BIGINT can't hold (a >= 0, b > 0)."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def header_weight(header: Column, length: Column, assembly_k: int, mode: str = "unitigs") -> Column:
    """The weight of a record, in units of scale(mode): of a read 1; else micro-units from mean tags (ka, km) or a total (KC).

    Mean tags win over a total.  Means that differ, two totals, values that are no plain number (a total: no whole one, or
    above 2^64 - 1), a total on a sequence shorter than assembly_k, and (mode unitigs) no tag at all raise; without a tag,
    mode auto weighs 1.
    """
    if mode == "reads":
        return F.lit(1).cast("long")
    tags = F.split(header, r"[ \t\n\f\r]+")
    value = lambda t: F.substring(t, F.lit(6), F.length(t))
    mean = micro_units(value(F.try_element_at(F.filter(tags, lambda t: t.rlike("^k[am]:[fi]:")), F.lit(1))))
    total = F.regexp_replace(value(F.try_element_at(F.filter(tags, lambda t: t.startswith("KC:i:")), F.lit(1))), r"^\+", "").try_cast("decimal(20,0)")
    places = (length - assembly_k + 1).cast("decimal(20,0)")
    error = weight_error(header, length, assembly_k, mode)
    return (
        F.when(error.isNotNull(), F.raise_error(F.concat(error, F.lit(" in header "), header)).cast("long"))
        .when(mean.isNotNull(), mean)
        .when(total.isNotNull(), _div(total * SCALE + _div(places, F.lit(2).cast("decimal(20,0)")), places).cast("long"))
        .otherwise(F.lit(SCALE).cast("long"))
    )


def weight_error(header: Column, length: Column, assembly_k: int, mode: str = "unitigs") -> Column:
    """Why header_weight would raise, or null."""
    if mode == "reads":
        return F.lit(None).cast("string")
    tags = F.split(header, r"[ \t\n\f\r]+")
    means = F.array_distinct(F.transform(F.filter(tags, lambda t: t.rlike("^k[am]:[fi]:")), lambda t: micro_units(F.substring(t, F.lit(6), F.length(t)))))
    totals = F.transform(F.filter(tags, lambda t: t.startswith("KC:i:")), lambda t: F.regexp_extract(F.substring(t, F.lit(6), F.length(t)), r"^\+?([0-9]+)$", 1).try_cast("decimal(38,0)"))
    return (
        F.when((F.size(means) > 1) | F.exists(means, lambda m: m.isNull()), F.lit("bad or conflicting abundance"))
        .when((F.size(totals) > 1) | F.exists(totals, lambda t: t.isNull() | (t > F.lit("18446744073709551615").cast("decimal(38,0)"))), F.lit("bad or repeated KC:i"))
        .when((F.size(means) == 0) & (F.size(totals) == 1) & (length < assembly_k), F.lit("KC:i on a sequence that is too short"))
        .when((F.size(means) == 0) & (F.size(totals) == 0) & F.lit(mode == "unitigs"), F.lit("no abundance"))
    )


def scale(mode: str) -> int:
    """Units of one observation in the weights of a mode."""
    return 1 if mode == "reads" else SCALE


def percent_escape(value: Column) -> Column:
    """Everything but [A-Za-z0-9._-] as %XX of its UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(value.cast("binary")), F.lit("(..)"), 1)
    keep = lambda h: F.decode(F.unhex(h), "ISO-8859-1")
    return F.array_join(F.transform(pairs, lambda h: F.when(keep(h).rlike(r"^[A-Za-z0-9._\-]$"), keep(h)).otherwise(F.concat(F.lit("%"), h))), "")


def natural_key(name: Column) -> Column:
    """Sorts names ignoring case and accents, with runs of digits by their number, of any length: an array of parts, of which
    text is compared by Spark's collation UNICODE_CI_AI, and a run of digits by how many it has without leading zeros, then by
    these.  Names that differ only in case, accents or leading zeros are equal."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    plain = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    number = lambda p: F.concat(F.lpad(F.length(plain(p)).cast("string"), 10, "0"), plain(p))
    keyed = lambda p: F.collate(F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p), "UNICODE_CI_AI")
    return F.transform(parts, keyed)


def exon_name(number: Column, contig: Column, start: Column, end: Column, strand: Column, exon_ids: Column, gene_ids: Column) -> Column:
    """The header of an exon record, with its sorted ids where there are any."""
    ids = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f" {label}="), F.array_join(F.transform(F.array_sort(c), percent_escape), ","))).otherwise("")
    head = F.format_string("exon_%06d|%s:%d-%d:%s", number, percent_escape(contig), start, end, strand)
    return F.concat(head, ids("exon_ids", exon_ids), ids("gene_ids", gene_ids))


def six_decimals(n: Column, d: Column) -> Column:
    """n / d in six decimals, half up, without floating point; null over zero.  For n >= 0 below 10^31."""
    n, d = n.cast("decimal(38,0)"), d.cast("decimal(20,0)")
    d = F.when(d != 0, d).cast("decimal(38,0)")
    micro = whole((n * SCALE * 2).cast("decimal(38,0)") + d, (d * 2).cast("decimal(38,0)"))
    return (micro / F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,6)")


#: Suffixes of shortened numbers, by powers of a thousand.
UNITS = ["", "K", "M", "G", "T"]


def short_number(value: Column) -> Column:
    """Whole numbers: below 1,000 as they are, then in three digits with K, M, G or T; from 1,000T on with more places, grouped."""
    v = value.cast("decimal(38,0)")
    digits, power = _three_digits(v)
    unit = F.least(F.floor(power / 3), F.lit(4))
    places = (power - unit * 3 + 1).cast("int")
    long = _grouped(F.concat(digits, F.repeat(F.lit("0"), F.greatest(places - 3, F.lit(0)))))
    mantissa = F.when(places >= 3, long).otherwise(F.concat(F.substring(digits, F.lit(1), places), F.lit("."), F.substring(digits, places + 1, F.lit(3))))
    return F.when(v < 1000, v.cast("string")).otherwise(F.concat(mantissa, F.element_at(F.array(*map(F.lit, UNITS)), (unit + 1).cast("int"))))


def _grouped(digits: Column) -> Column:
    """Whole digits in threes."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ",")


def _three_digits(v: Column) -> tuple[Column, Column]:
    """The first three digits of a whole number, halves up, as text, and the power of ten of the first."""
    digits = F.length(v.cast("string"))
    unit = F.concat(F.lit("1"), F.repeat(F.lit("0"), F.greatest(digits - 3, F.lit(0)))).cast("decimal(38,0)")
    up = F.lit("1").cast("decimal(38,0)") * F.when(digits < 2, 100).when(digits < 3, 10).otherwise(1)
    first = whole((v * up * 2).cast("decimal(38,0)") + unit, (unit * 2).cast("decimal(38,0)"))
    over = first >= 1000
    return F.lpad(F.when(over, F.lit(100)).otherwise(first).cast("string"), 3, "0"), digits - 1 + over.cast("int")


def scientific(value: Column) -> Column:
    """Whole numbers in three digits and an exponent, halves up, exact for large ones."""
    digits, power = _three_digits(value.cast("decimal(38,0)"))
    return F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit("e+"), power.cast("string"))


def scientific_real(value: Column) -> Column:
    """Numbers with fractions in three digits and an exponent, halves of the shortest decimal up."""
    return F.regexp_replace(F.format_string("%.2e", value.cast("double")), r"e([+-])0+(?=\d)", "e$1")


def _significant(value: Column, digits: int) -> Column:
    """A number rounded to so many significant digits, without an exponent or zeros at its end."""
    text = F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def real_number(value: Column) -> Column:
    """Numbers with fractions in at most six significant digits, whole digits in threes; for sizes from 1e-17 to 1e19."""
    text = _significant(value, 6)
    return F.concat(_grouped(F.regexp_extract(text, r"^(-?\d+)", 1)), F.regexp_extract(text, r"(\.\d+)?$", 0))


def short_real(value: Column) -> Column:
    """Numbers with fractions: from 1,000 on in at most three significant digits with K, M, G or T, below as real_number()."""
    v = value.cast("double")
    unit = F.least(F.floor(F.log10(F.greatest(v, F.lit(1000.0))) / 3), F.lit(4))
    part = _significant(v / F.pow(F.lit(1000.0), unit), 3)
    return F.when(v >= 1000, F.concat(part, F.element_at(F.array(*map(F.lit, UNITS)), (unit + 1).cast("int")))).otherwise(real_number(v))


def percentage(share: Column) -> Column:
    """A share as text: two decimals, or three digits and an exponent below 0.01 %; a missing one as a dash."""
    p = share * 100
    return F.when(p.isNull(), F.lit("–")).when((p > 0) & (p < 0.01), F.format_string("%.2e%%", p)).otherwise(F.format_string("%.2f%%", p))


def csv_cell(text: Column) -> Column:
    """Quoted, with quotes doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def percentiles(text: str, most: int = 32) -> list[str]:
    """A list of distinct percentages in order, from 0 to 100 with at most six decimals; anything else raises."""
    import re
    from decimal import Decimal

    found: dict[Decimal, str] = {}
    for part in filter(None, re.split(r"[,\s]+", text.strip())):
        if not re.fullmatch(r"\d{1,3}(\.\d{1,6})?", part) or Decimal(part) > 100:
            raise ValueError(f"not a percentile: {part}")
        found.setdefault(Decimal(part), f"{Decimal(part).normalize():f}")
    if not found or len(found) > most:
        raise ValueError(f"from 1 to {most} percentiles are needed")
    return [found[k] for k in sorted(found)]
