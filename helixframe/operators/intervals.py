"""Genomic intervals: dedupe, merge, transcript paths, sequences, junction contexts, checks (inventory D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequence import exon_name, locus_sequence, percent_escape

LOCUS = ["contig", "start", "end", "strand"]


def dedupe(exons: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """One row an interval, with the sorted sets of the ids it was given."""
    return exons.groupBy(*keys).agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ids))


def dedupe_sets(exons: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """As dedupe(), where each row has arrays of ids."""
    return exons.groupBy(*keys).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ids))


def merge(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 1 << 16) -> DataFrame:
    """Overlapping intervals (start <= running end) of a key as one; adjacent ones stay apart.

    Starts fall into ranges of `width`.  The running end is found within each range, from the largest end of the ranges
    before it; so are islands numbered.  Only one row a range meets the others of its key, not its intervals.
    """
    rows = intervals.select(*keys, start, end).distinct().withColumn("_bin", F.floor(F.col(start) / width))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*keys, "_bin").agg(F.max(end).alias("_e")).withColumn("_carry", F.coalesce(F.max("_e").over(before), F.lit(-(1 << 62)))).drop("_e")
    local = Window.partitionBy(*keys, "_bin").orderBy(start, end)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_bin") == F.col("_b")]
    named = lambda df, *more: df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bin").alias("_b"), *more)
    drop = [f"_k{i}" for i in range(len(keys))] + ["_b"]
    seen = F.greatest("_carry", F.coalesce(F.max(end).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(1 << 62))))
    flagged = rows.join(named(ahead, "_carry"), same).drop(*drop).withColumn("_new", (F.col(start) > seen).cast("long"))
    flagged = flagged.withColumn("_local", F.sum("_new").over(upto))
    base = flagged.groupBy(*keys, "_bin").agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    whole = flagged.join(named(base, "_base"), same).drop(*drop)
    return whole.groupBy(*keys, (F.col("_local") + F.col("_base")).alias("_island")).agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gene_union(exons: DataFrame, gene: str = "gene") -> DataFrame:
    """(contig, gene, strand, start, end): each gene's merged exons; an exon without a gene raises."""
    named = F.when(F.col(gene).isNull() | (F.col(gene).cast("string") == ""), F.raise_error(F.lit("an exon has no gene")).cast(exons.schema[gene].dataType)).otherwise(F.col(gene))
    return merge(exons.withColumn(gene, named), ["contig", gene, "strand"])


def paths(exons: DataFrame, transcript: list[str], strict: bool = False) -> DataFrame:
    """Each transcript's distinct exons in reading order (reversed on the minus strand); `overlapping` tells if any two
    overlap, which raises if strict."""
    order = Window.partitionBy(*transcript).orderBy("start", "end")
    rows = exons.select(*transcript, "start", "end", "strand").distinct().withColumn("_over", F.col("start") <= F.lag("end").over(order))
    got = rows.groupBy(*transcript, "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("path"), F.coalesce(F.bool_or("_over"), F.lit(False)).alias("overlapping"))
    got = got.withColumn("path", F.when(F.col("strand") == "-", F.reverse("path")).otherwise(F.col("path")))
    if strict:
        bad = F.raise_error(F.concat(F.lit("overlapping exons within transcript "), F.concat_ws("/", *(F.col(c).cast("string") for c in transcript)))).cast("string")
        # the check is part of the path, so that no plan leaves it out
        got = got.withColumn("path", F.when(F.col("overlapping"), F.array(F.struct(bad.cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).cast(got.schema["path"].dataType)).otherwise(F.col("path")))
    return got


#: Bases of a block of a contig.
BLOCK = 1 << 16


def blocks_of(genome: DataFrame, width: int = BLOCK) -> DataFrame:
    """(contig, place, block, bases) of a genome whose contigs are whole strings (contig, bases, place); read_genome gives these
    rows itself, so that no contig is ever one string."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("bases") / width) - 1, F.lit(0)))
    rows = genome.select("contig", "place", "bases", F.explode(starts).alias("_i"))
    return rows.select("contig", "place", F.col("_i").cast("long").alias("block"), F.substring("bases", F.col("_i").cast("int") * width + 1, F.lit(width)).alias("bases"))


def extract(intervals: DataFrame, genome: DataFrame, width: int = BLOCK) -> DataFrame:
    """Interval rows with their sequence, from a genome in blocks of `width` bases (contig, block, bases), or of whole
    contigs, which are cut into blocks first.

    An interval is joined with the one to few blocks that it touches, of which only the bases inside go on, and these are put
    together in order; equal intervals are read once.  A contig that the genome lacks, and an interval beyond its contig, raise.
    """
    if "block" not in genome.columns:
        genome = blocks_of(genome if "place" in genome.columns else genome.withColumn("place", F.lit(0).cast("long")), width)
    lengths = genome.groupBy(F.col("contig").alias("_c")).agg(F.sum(F.length("bases").cast("long")).alias("_length"))
    wanted = intervals.select(*LOCUS).distinct().join(lengths, F.col("contig") == F.col("_c"), "left")
    inside = (F.col("start") >= 1) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("_length"))
    bad = F.when(F.col("_length").isNull(), F.concat(F.lit("contig is not in the genome: "), F.col("contig").cast("string"))).when(~F.coalesce(inside, F.lit(False)), F.lit("interval is beyond its contig"))
    # what is wrong with a locus is part of where it is looked for, so that no plan leaves the check out
    first = F.when(bad.isNotNull(), F.raise_error(bad).cast("long")).otherwise(F.floor((F.col("start") - 1) / width))
    touched = wanted.withColumn("_block", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / width))))
    some = genome.select(F.col("contig").alias("_g"), F.col("block").alias("_b"), "bases")
    low = F.greatest(F.col("start") - F.col("_block") * width, F.lit(1))
    high = F.least(F.col("end") - F.col("_block") * width, F.lit(width))
    parts = touched.join(some, (F.col("contig") == F.col("_g")) & (F.col("_block") == F.col("_b")), "left")
    parts = parts.select(*LOCUS, "_block", F.substring("bases", low.cast("int"), (high - low + 1).cast("int")).alias("_part"))
    whole = parts.groupBy(*LOCUS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_part"))), lambda x: x["_part"]), "").alias("_bases"))
    full = F.when(F.length("_bases") == F.col("end") - F.col("start") + 1, F.col("_bases")).otherwise(F.raise_error(F.lit("a block of the genome is missing")))
    seqs = whole.select(*(F.col(c).alias(f"_{c}") for c in LOCUS), locus_sequence(full, F.lit(1), F.length("_bases"), F.col("strand")).alias("seq"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LOCUS]
    return intervals.join(seqs, same, "left").drop(*(f"_{c}" for c in LOCUS))


def missing_contigs(intervals: DataFrame, genome: DataFrame, most: int = 10) -> list:
    """The first contigs, in order, that intervals name and the genome lacks."""
    return [r[0] for r in intervals.select("contig").distinct().join(genome.select("contig").distinct(), "contig", "left_anti").orderBy("contig").limit(most).collect()]


def spliced(transcript_paths: DataFrame, exon_sequences: DataFrame, transcript: list[str]) -> DataFrame:
    """transcript_paths with `seqs` (an exon's sequence each, in reading order) and `seq`, the whole; exon_sequences has
    contig, start, end, strand and seq."""
    steps = transcript_paths.select(*transcript, "contig", "strand", F.posexplode("path").alias("_i", "_x")).select(*transcript, "contig", "strand", "_i", "_x.start", "_x.end")
    each = steps.join(exon_sequences.select(*LOCUS, "seq").distinct(), LOCUS)
    got = each.groupBy(*transcript).agg(F.array_sort(F.collect_list(F.struct("_i", "seq"))).alias("_s"))
    return transcript_paths.join(got.select(*transcript, F.transform("_s", lambda x: x["seq"]).alias("seqs")), transcript).withColumn("seq", F.array_join("seqs", ""))


def boundary(left: Column, right: Column, strand: Column) -> Column:
    """(donor, acceptor) of two exons in reading order."""
    plus = strand == "+"
    return F.struct(F.when(plus, left["end"]).otherwise(left["start"]).alias("donor"), F.when(plus, right["start"]).otherwise(right["end"]).alias("acceptor"))


def annotated_contexts(transcripts: DataFrame, k: int, gene: str = "gene") -> DataFrame:
    """(gene, donor, acceptor, strand, context) of each exon boundary of a transcript (`path` and `seqs` in reading order): up
    to k-1 bases of the spliced transcript on either side, if they make a k-mer; one row for equal contexts of a gene's
    boundary."""
    return _boundaries(transcripts, k, gene).where(F.length("context") >= k).distinct()


def _boundaries(transcripts: DataFrame, k: int, gene: str) -> DataFrame:
    offsets = F.transform(F.sequence(F.lit(1), F.size("seqs") - 1), lambda i: F.struct(i.alias("boundary"), F.aggregate(F.slice("seqs", F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s)).alias("at")))
    rows = transcripts.where(F.size("seqs") > 1).select("*", F.array_join("seqs", "").alias("_whole"), F.explode(offsets).alias("_b"))
    low = F.greatest(F.lit(1), F.col("_b.at") - (k - 2))
    high = F.least(F.length("_whole"), F.col("_b.at") + k - 1)
    context = F.substring(F.col("_whole"), low, high - low + 1)
    edge = boundary(F.element_at("path", F.col("_b.boundary")), F.element_at("path", F.col("_b.boundary") + 1), F.col("strand"))
    return rows.select(F.col(gene), edge["donor"].alias("donor"), edge["acceptor"].alias("acceptor"), "strand", context.alias("context"))


def exon_counts(merged: DataFrame, limit: int = 50, gene: str = "gene") -> DataFrame:
    """(gene, exons, above_limit): of each gene, the merged exons, and whether exon_pairs leaves it out at this limit."""
    return merged.groupBy(gene).agg(F.count("*").alias("exons")).withColumn("above_limit", F.col("exons") > limit)


def _pairs(merged: DataFrame, k: int, limit: int, gene: str) -> DataFrame:
    """exon_pairs with the strand: a gene of at most `limit` exons is one row with a list of their flanks, which is paired with
    itself there, so the exons are shuffled once."""
    flanks = F.struct("start", "end", F.left("seq", F.lit(k - 1)).alias("head"), F.right("seq", F.lit(k - 1)).alias("tail"), "strand")
    counted = merged.select(gene, flanks.alias("x")).withColumn("_at", F.row_number().over(Window.partitionBy(gene).orderBy(F.col("x.start"), F.col("x.end")))).where(F.col("_at") <= limit + 1)
    lists = counted.groupBy(gene).agg(F.collect_list("x").alias("xs")).where(F.size("xs") <= limit)
    left = lists.select(gene, "xs", F.explode("xs").alias("l"))
    both = left.select(gene, "l", F.explode("xs").alias("r")).where("l.end < r.start or r.end < l.start")
    out = both.select(gene, F.col("l.start").alias("l_start"), F.col("l.end").alias("l_end"), F.col("r.start").alias("r_start"), F.col("r.end").alias("r_end"), F.concat("l.tail", "r.head").alias("context"), F.col("l.strand").alias("strand"))
    return out.where(F.length("context") >= k)


def exon_pairs(merged: DataFrame, k: int, limit: int = 50, gene: str = "gene") -> DataFrame:
    """All ordered pairs of disjoint merged exons of genes with at most `limit` of them: last k-1 bases of one, first k-1 of the other."""
    rows = merged if "strand" in merged.columns else merged.withColumn("strand", F.lit("+"))
    return _pairs(rows, k, limit, gene).drop("strand")


def all_contexts(transcripts: DataFrame, merged: DataFrame, k: int, limit: int = 50, gene: str = "gene") -> DataFrame:
    """(gene, donor, acceptor, strand, context, source): annotated contexts, then those of all pairs that are not among them.

    Both kinds are one union, and one aggregate keeps the annotated of equal ones.
    """
    known = _boundaries(transcripts, k, gene).where(F.length("context") >= k).withColumn("_all", F.lit(0))
    pairs = _pairs(merged, k, limit, gene)
    edge = boundary(F.struct(F.col("l_start").alias("start"), F.col("l_end").alias("end")), F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end")), F.col("strand"))
    more = pairs.select(gene, edge["donor"].alias("donor"), edge["acceptor"].alias("acceptor"), "strand", "context", F.lit(1).alias("_all"))
    both = known.unionByName(more).groupBy(gene, "donor", "acceptor", "context", "strand").agg(F.min("_all").alias("_all"))
    return both.select(gene, "donor", "acceptor", "strand", "context", F.when(F.col("_all") == 0, "annotated").otherwise("all").alias("source"))


def junction_statistics(transcripts: DataFrame, merged: DataFrame, k: int, limit: int | None = 50, gene: str = "gene") -> DataFrame:
    """One row a gene: annotated_junctions, additional_pairs, sequence_records, expanded, above_limit (limit None: annotated only)."""
    edges = _boundaries(transcripts, k, gene).select(gene, "donor", "acceptor").distinct()
    if limit is None:
        contexts, added = annotated_contexts(transcripts, k, gene), edges.where("false")
        counts = merged.groupBy(gene).agg(F.lit(False).alias("expanded"), F.lit(False).alias("above_limit"))
    else:
        contexts = all_contexts(transcripts, merged, k, limit, gene)
        rows = merged.join(exon_counts(merged, limit, gene).where("not above_limit").select(gene), gene)
        side = lambda t: rows.select(gene, F.struct("start", "end").alias(t), *([F.col("strand")] if t == "l" else []))
        pairs = side("l").join(side("r"), gene).where("l.end < r.start or r.end < l.start")
        edge = boundary(F.col("l"), F.col("r"), F.col("strand"))
        added = pairs.select(gene, edge["donor"].alias("donor"), edge["acceptor"].alias("acceptor")).distinct().join(edges, [gene, "donor", "acceptor"], "left_anti")
        counts = exon_counts(merged, limit, gene).select(gene, (~F.col("above_limit")).alias("expanded"), "above_limit")
    number = lambda df, name: df.groupBy(gene).agg(F.count("*").alias(name))
    out = counts.join(number(edges, "annotated_junctions"), gene, "left").join(number(added, "additional_pairs"), gene, "left").join(number(contexts, "sequence_records"), gene, "left")
    return out.na.fill(0, ["annotated_junctions", "additional_pairs", "sequence_records"])


def annotation_problems(exons: DataFrame) -> DataFrame:
    """(problem, name) of exon rows (contig, strand, gene_ids, transcript_ids): exons without exactly one gene and one
    transcript, transcripts of several genes, genes or transcripts on several contigs or strands."""
    one = (F.size("gene_ids") == 1) & (F.size("transcript_ids") == 1)
    place = F.concat_ws(":", F.col("contig").cast("string"), "strand")
    bad = exons.where(~F.coalesce(one, F.lit(False))).select(F.lit("exon without one gene and one transcript").alias("problem"), F.concat_ws(":", F.col("contig").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")).alias("name")).distinct()
    rows = exons.where(one).select(F.try_element_at("gene_ids", F.lit(1)).alias("g"), F.try_element_at("transcript_ids", F.lit(1)).alias("t"), place.alias("p"))
    split = lambda key, value, label: rows.groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a <> b").select(F.lit(label).alias("problem"), F.col(key).cast("string").alias("name"))
    return bad.unionByName(split("t", "g", "transcript in several genes")).unionByName(split("g", "p", "gene on several contigs or strands")).unionByName(split("t", "p", "transcript on several contigs or strands"))


def check_annotation(exons: DataFrame, most: int = 10) -> None:
    found = annotation_problems(exons).orderBy("problem", "name").limit(most).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.name}" for r in found))


def check_options(level: str, annotation: bool, junctions: str = "none", isoforms: bool = False, max_exons: int = 50) -> None:
    """Junctions need an annotation and genes; isoforms go with neither genes nor junctions."""
    if level not in ("exon", "gene") or junctions not in ("none", "annotated", "all") or max_exons < 1:
        raise ValueError("unknown level or kind of junctions, or no exons allowed")
    if junctions != "none" and (level != "gene" or not annotation):
        raise ValueError("junctions need an annotation at gene level")
    if isoforms and (level == "gene" or junctions != "none" or not annotation):
        raise ValueError("isoforms need an annotation, without genes or junctions")


def numbered_exons(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """Exon rows (contig, start, end, strand, exon_ids, gene_ids) with `exon_id` from 1, in the order of the genome's contigs,
    then start, end and strand (plus first), and `exon_name`.

    Numbers run on from one contig to the next by the contigs' counts; within a contig they are made of ranges of starts.
    """
    width = 1 << 16
    rows = dedupe_sets(exons, LOCUS, ["exon_ids", "gene_ids"]).join(genome.select("contig", "place").distinct(), "contig").withColumn("_bin", F.floor(F.col("start") / width))
    sizes = rows.groupBy("place", "_bin").agg(F.count("*").alias("_n"))
    contigs = sizes.groupBy("place").agg(F.sum("_n").alias("_n"))
    # a genome's contigs are a short list; the ranges of one contig meet only each other
    lead = contigs.withColumn("_lead", F.coalesce(F.sum("_n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("place").alias("_p"), "_lead")
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy("place").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n").withColumnRenamed("place", "_q").withColumnRenamed("_bin", "_b")
    local = F.row_number().over(Window.partitionBy("place", "_bin").orderBy("start", "end", F.col("strand") != "+"))
    got = rows.withColumn("_local", local).join(lead, F.col("place") == F.col("_p")).join(ahead, (F.col("place") == F.col("_q")) & (F.col("_bin") == F.col("_b")))
    number = (F.col("_lead") + F.col("_ahead") + F.col("_local")).cast("long")
    return got.select(number.alias("exon_id"), *LOCUS, "exon_ids", "gene_ids", exon_name(number, F.col("contig"), F.col("start"), F.col("end"), F.col("strand"), F.col("exon_ids"), F.col("gene_ids")).alias("exon_name"))


def fasta(rows: DataFrame, header: str, seq: str = "seq") -> DataFrame:
    """(value): one header line and one sequence line a record, to be written as text."""
    return rows.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value"))


def gene_records(union: DataFrame) -> DataFrame:
    """Merged exons of genes (gene, seq) as records headed by the gene's escaped name."""
    return fasta(union.withColumn("_h", percent_escape(F.col("gene").cast("string"))), "_h")


def junction_records(contexts: DataFrame, gene: str = "gene") -> DataFrame:
    """Contexts as records with their boundary and source."""
    head = F.concat(percent_escape(F.col(gene).cast("string")), F.format_string(" kind=junction donor=%d acceptor=%d strand=%s source=%s", "donor", "acceptor", "strand", "source"))
    return fasta(contexts.withColumn("_h", head), "_h", "context")
