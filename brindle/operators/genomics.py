"""Mutations of a virus's genes, read quality and batches of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions of resistance mutations by gene, and those of the RT
# gene that concern the first of its two drug classes.
RESISTANCE_POSITIONS = {
    "PR": [30, 32, 33, 46, 47, 48, 50, 54, 76, 82, 84, 88, 90],
    "RT": [41, 65, 67, 69, 70, 74, 75, 100, 101, 103, 106, 108, 115, 138, 151, 179, 181, 184, 188, 190, 210, 215, 219, 221, 225, 227, 230],
    "IN": [51, 66, 92, 118, 121, 140, 143, 148, 155, 263],
}
NRTI_POSITIONS = [41, 65, 67, 69, 70, 74, 75, 115, 151, 184, 210, 215, 219]


def mutation(gene: Column, position: Column, ref: Column, alt: Column) -> Column:
    """Struct (is_drm, is_apobec, drug_class, notation) of an amino acid change."""
    listed = [(gene == g) & position.isin(*at) for g, at in RESISTANCE_POSITIONS.items()]
    drug = F.when(gene == "PR", "PI").when(gene == "RT", F.when(position.isin(*NRTI_POSITIONS), "NRTI").otherwise("NNRTI")).when(gene == "IN", "INSTI")
    return F.struct(
        F.coalesce(F.greatest(*listed), F.lit(False)).alias("is_drm"),
        F.coalesce((ref == "G") & alt.isin("A", "R", "E"), F.lit(False)).alias("is_apobec"),
        drug.alias("drug_class"),
        F.concat(ref, position.cast("string"), alt).alias("notation"),
    )


def mutations(variants: DataFrame, regions: str = "PR+RT+IN") -> DataFrame:
    """``variants(gene, position, ref_aa, alt_aa, ...)`` of the regions, classified."""
    found = variants.filter(F.col("gene").isin(*regions.split("+"))).withColumn("_m", mutation(*map(F.col, ("gene", "position", "ref_aa", "alt_aa"))))
    return found.select("*", "_m.*").drop("_m")


def mutation_counts(classified: DataFrame, key: str) -> DataFrame:
    return classified.groupBy(key).agg(F.count(F.lit(1)).alias("mutations"), F.count_if("is_drm").alias("drm_count"), F.count_if("is_apobec").alias("apobec_count"))


def read_verdict(mean_quality: Column, bases: Column, reference_length: Column, least_quality: int = 30, least_depth: int = 100) -> Column:
    """Struct (coverage_depth, passed, message): whole depth is bases over the
    reference's length, 0 without one; both have to reach their least."""
    depth = F.coalesce(F.floor(F.try_divide(bases, reference_length)), F.lit(0)).cast("int")
    poor, thin = mean_quality < least_quality, depth < least_depth
    reasons = F.concat_ws(
        "; ",
        F.when(poor, F.concat(F.lit("low quality ("), F.format_string("%.1f", mean_quality), F.lit(f" < {least_quality})"))),
        F.when(thin, F.concat(F.lit("low depth ("), depth.cast("string"), F.lit(f" < {least_depth})"))),
    )
    return F.struct(depth.alias("coverage_depth"), (~poor & ~thin).alias("passed"), F.when(reasons == "", "QC passed").otherwise(reasons).alias("message"))


def batch_report(results: DataFrame, batch: str) -> DataFrame:
    """Per batch, samples, completed ones, and those with a resistance level
    other than susceptible."""
    level = F.coalesce("resistance_level", F.lit(""))
    return results.groupBy(batch).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("status") == "completed").alias("passed"), F.count_if(~level.isin("", "susceptible")).alias("resistant"))
